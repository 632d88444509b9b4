"""Token ids and counts of whole texts, one tokenizers call per distinct space-delimited unit.

No pre-token of the vocabularies used here reaches across a space with a character on either side that is no white
space: the byte-level pattern starts a new pre-token before such a space, and the word-end vocabulary drops white
space. So the ids of a text are the ids of its units, cut at such spaces, joined. A unit is encoded once per worker and
kept in a table of bounded size; ids are then gathered with numpy. Texts with white space of any kind on both sides of
a space, and texts with a special string of the vocabulary (which ends a run of white space), are encoded whole.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that a pattern's white space may be.
WHITE = pa.array([chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
#: Marks that make one pre-token with each other after a word.
MARKS = "!#$%&*+,-./:;=?@)]}"
#: A string of characters below U+0180.
LATIN = "^[\\x00-\\x{17F}]*$"
#: Units that a worker keeps; past this the table starts anew.
KEPT_UNITS = 500_000
#: Bytes of text that are split at a time; a longer text is split alone.
CHUNK_BYTES = 16 << 20


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def units(texts: pa.Array, special: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Texts cut at their spaces: a code for each unit, where each text's units begin, the distinct units by code, and
    which texts must be taken whole instead (those with two spaces in a row count as one empty unit)."""
    odd = pc.match_substring(texts, "  ")
    lists = pc.split_pattern(pc.if_else(odd, pa.scalar("", texts.type), texts), " ")
    coded = lists.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    first = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()
    empty = pc.equal(pc.binary_length(names), 0)
    white = [pc.or_(empty, pc.is_in(pc.utf8_slice_codeunits(names, *at), WHITE)).to_numpy(zero_copy_only=False) for at in ((0, 1), (-1, None))]
    marked = np.zeros(len(names), bool)
    for s in special:
        marked |= pc.match_substring(names, s).to_numpy(zero_copy_only=False)
    # A unit that begins with white space after one that ends with it; a text's first unit has none before it.
    wrong = marked[codes]
    wrong[1:] |= white[0][codes[1:]] & white[1][codes[:-1]] & ~np.isin(np.arange(1, len(codes)), first)
    whole = odd.to_numpy(zero_copy_only=False)
    if len(first):
        whole = whole | np.logical_or.reduceat(wrong, first)
    return codes, first, names, whole


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Runs of rows of at most so many bytes together, or one longer row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(texts):
        past = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        past = max(past, at + 1)
        yield texts.slice(at, past - at)
        at = past


def joined(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s:s+n] for each start s and length n, one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.cumsum(lengths) - lengths
    places = np.repeat((starts - at).astype(kind), lengths)
    places += np.arange(total, dtype=kind)
    return values[places]


@functools.lru_cache(maxsize=1)
def encoder(path: str, kept: int = KEPT_UNITS, chunk: int = CHUNK_BYTES) -> Encoder:
    """The worker's encoder: Spark's Python workers outlive tasks, and so do the units that they know."""
    return Encoder(path, kept, chunk)


class Encoder:
    """Whole texts to ids, in batches.

    spaced: whether the vocabulary keeps the space before a word. Words of Latin letters, perhaps with one mark
    after them, are one pre-token (and one for the mark) under either pattern, so they go straight to the library's
    merges; any other unit goes through all of the library.
    """

    def __init__(self, path: str, kept: int = KEPT_UNITS, chunk: int = CHUNK_BYTES):
        self.tokenizer, self.kept, self.chunk = load(path), kept, chunk
        self.special = special_strings(self.tokenizer)
        #: Ids of units after a space, of words without one and of runs of marks: three tables, for a unit may hold any character.
        self.known, self.bare, self.marks = {}, {}, {}
        self.model = self.tokenizer.model
        self.spaced = self.tokenizer.normalizer is None
        self.line = self.direct("\n")
        #: Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.table = {b: chr(256 + k) for k, b in enumerate(rest)}

    def direct(self, unit: str) -> bytes:
        return array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()

    def word(self, word: str, spaced: bool) -> bytes:
        """Ids of a word of Latin letters, perhaps with a space before it."""
        named = word
        if not self.spaced:
            named = word.lower()
            if not named.isalpha():  # a lower case of two characters may be cut between them
                return self.direct(word)
        if not named.isascii():
            named = named.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.model.tokenize("\u0120" + named if self.spaced and spaced else named)]).tobytes()

    def simple(self, unit: str, spaced: bool) -> bytes | None:
        """Ids of a word and the marks after it, which are two pre-tokens; None if the unit is anything else."""
        word = unit.rstrip(MARKS)
        if not word.isalpha() or not (word.isascii() or max(word) < "\u0180"):
            return None
        table = self.known if spaced else self.bare
        got = table.get(word)
        if got is None:
            got = table[word] = self.word(word, spaced)
        if len(word) == len(unit):
            return got
        marks = unit[len(word) :]
        after = self.marks.get(marks)
        if after is None:
            after = self.marks[marks] = self.direct(marks)
        return got + after

    def later(self, unit: str) -> bytes:
        """Ids of a space and a unit. Words and runs of marks are kept, and so are units that need all of the library."""
        if (got := self.simple(unit, True)) is not None:
            return got
        head, line, tail = unit.partition("\n")
        if line and (a := self.simple(head, True)) is not None and (b := self.simple(tail, False)) is not None:
            return a + self.line + b
        got = self.known[unit] = self.direct(f" {unit}")
        return got

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each run of rows: all ids, and how many each row has. A null or empty text has none."""
        for part in chunks(texts, self.chunk):
            if len(self.known) + len(self.bare) + len(self.marks) > self.kept:
                for table in (self.known, self.bare, self.marks):
                    table.clear()
            yield self._encode(pc.fill_null(part, ""))

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes, first, names, whole = units(texts, self.special)
        # A text's first unit has no space before it; one that is taken whole counts as a first unit, its others as none.
        later = np.ones(len(codes), bool)
        later[first] = False
        if whole.any():
            later &= ~np.repeat(whole, np.diff([*first, len(codes)]))
        used = np.zeros(len(names), bool)
        used[codes[later]] = True
        head, tail, parts = self.parts(names, np.flatnonzero(used))
        # Further codes: one that stands for nothing, and the first units.
        more, firsts, rank = [0], {}, []
        whole_texts = iter(texts.filter(pa.array(whole)).to_pylist())
        first_names = names.take(pa.array(codes[first])).to_pylist()
        for is_whole, name in zip(whole.tolist(), first_names):
            if is_whole or name not in firsts:
                at = len(names) + len(more)
                more.append(len(parts))
                parts.append(self.direct(next(whole_texts) if is_whole else name))
                if not is_whole:
                    firsts[name] = at
            rank.append(at if is_whole else firsts[name])
        codes[~later] = len(names)
        codes[first] = rank
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        values, starts = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        # Two parts make a unit, units make the texts.
        pieces = np.stack([np.append(head, more), np.append(tail, np.zeros(len(more), np.int64))], axis=1).ravel()
        values, sizes = joined(values, starts[pieces], sizes[pieces]), sizes[pieces].reshape(-1, 2).sum(axis=1)
        lengths = sizes[codes]
        counts = np.add.reduceat(lengths, first) if len(first) else lengths
        return joined(values, (np.cumsum(sizes) - sizes)[codes], lengths), counts

    def parts(self, names: pa.Array, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Ids of the used units after a space, in two parts each: for each unit two places in a list of ids, of which
        the first is empty. Words of Latin letters and the marks after them are found without a step for each unit."""
        head, tail, parts = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), [b""]
        own = names.take(pa.array(used))
        words = pc.utf8_rtrim(own, characters=MARKS)
        n_word, n_unit = (pc.binary_length(x).to_numpy() for x in (words, own))
        plain = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        wide = np.flatnonzero(plain & (n_word != pc.utf8_length(words).to_numpy()))
        plain[wide] = pc.match_substring_regex(words.take(pa.array(wide)), LATIN).to_numpy(zero_copy_only=False)
        coded = words.filter(pa.array(plain)).dictionary_encode()
        head[used[plain]] = coded.indices.to_numpy() + 1
        get, known = self.known.get, self.known
        for word in coded.dictionary.to_pylist():
            if (got := get(word)) is None:
                got = known[word] = self.word(word, True)
            parts.append(got)
        marked, found = plain & (n_unit > n_word), {}
        at = [found.setdefault(u[-n:], len(found)) for u, n in zip(own.filter(pa.array(marked)).to_pylist(), (n_unit - n_word)[marked].tolist())]
        tail[used[marked]] = np.array(at, np.int64) + len(parts)
        for marks in found:
            if (got := self.marks.get(marks)) is None:
                got = self.marks[marks] = self.direct(marks)
            parts.append(got)
        head[used[~plain]] = np.arange(len(parts), len(parts) + int((~plain).sum()))
        parts += [get(unit) or self.later(unit) for unit in own.filter(pa.array(~plain)).to_pylist()]
        return head, tail, parts
