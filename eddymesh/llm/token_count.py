"""Token counts without ids: pieces are counted once per distinct pre-token and joined to the documents.

1. Pre-token frequencies over all texts (partial sums in each task, then one shuffle), and the pieces of each distinct
   pre-token by the tokenizers library: the lexicon, a written table.
2. Its HEAD most frequent rows go to every worker (a fixed number); a document's frequencies of those are joined and
   summed where the text is read. The other frequencies, one row for each document and rarer pre-token, are joined
   with the lexicon by shuffle; none is so frequent that it would be a hot key.
3. Sums per document.

Null and empty texts have 0 tokens. Equal doc_ids stay separate rows; any other columns are left alone. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymesh.llm.common import batch, column, stored, tidied
from eddymesh.llm.tokens import MARKS, chunks, load, special_strings, units

#: Most frequent pre-tokens that every worker holds, whatever the input's size.
HEAD = 1 << 17
#: Distinct pre-tokens that a worker sums up before it passes them on.
HELD = 400_000
#: Bytes of text that are split at a time.
CHUNK = 8 << 20


class PreTokens:
    """Texts to pre-tokens. A special string is an entry of the lexicon of its own, and no pre-token reaches across it."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.special = special_strings(self.tokenizer)
        self.between = re.compile(f"({'|'.join(map(re.escape, self.special))})") if self.special else None
        self.normalizer, self.splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer

    def of(self, text: str) -> list[str]:
        """Pre-tokens of a text, or of a unit with the space that it begins with."""
        if self.between is not None and len(parts := self.between.split(text)) > 1:
            return [t for k, part in enumerate(parts) for t in ([part] if k % 2 else self.of(part))]
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def later(self, unit: str) -> list[str]:
        """Pre-tokens of a space and a unit; the usual cases without the library."""
        if self.normalizer is None:
            head, line, tail = unit.partition("\n")
            if (a := self.simple(head)) is not None:
                if not line:
                    a[0] = " " + a[0]
                    return a
                if (b := self.simple(tail)) is not None:
                    a[0] = " " + a[0]
                    return [*a, "\n", *b]
        return self.of(f" {unit}")

    @staticmethod
    def simple(unit: str) -> list[str] | None:
        word = unit.rstrip(MARKS)
        if not word.isalpha() or not (word.isascii() or max(word) < "ƀ"):
            return None
        return [word] if len(word) == len(unit) else [word, unit[len(word) :]]

    def counts(self, tokens: list[str]) -> list[int]:
        """Pieces of each pre-token."""
        return [len(self.tokenizer.encode(t, add_special_tokens=False)) for t in tokens]

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """For each unit of a run of rows a code, where each row's units begin, and the pre-tokens of each code."""
        codes, first, names, whole = units(texts, self.special)
        names = names.to_pylist()
        first_names = codes[first].tolist()
        rest = np.ones(len(codes), bool)
        rest[first] = False
        if whole.any():
            rest &= ~np.repeat(whole, np.diff([*first, len(codes)]))
        used = np.zeros(len(names), bool)
        used[codes[rest]] = True
        made = [self.later(u) if w else [] for u, w in zip(names, used.tolist())]
        codes[~rest] = len(made)
        made.append([])
        whole_texts = iter(texts.filter(pa.array(whole)).to_pylist())
        at_first = [next(whole_texts) if w else names[c] for w, c in zip(whole.tolist(), first_names)]
        for at, text in zip(first.tolist(), at_first):
            codes[at] = len(made)
            made.append(self.of(text) if text else [])
        return codes, first, made


FREQUENCIES = pa.schema([("pretoken", pa.string()), ("n", pa.int64())])


def frequencies(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    found, split = {}, PreTokens(path)
    for b in batches:
        for part in chunks(pc.fill_null(column(b, "text"), ""), CHUNK):
            codes, _, made = split.coded(part)
            for tokens, n in zip(made, np.bincount(codes, minlength=len(made)).tolist()):
                for t in tokens if n else ():
                    found[t] = found.get(t, 0) + n
            if len(found) > HELD:
                yield batch(FREQUENCIES, pretoken=list(found), n=list(found.values()))
                found = {}
    yield batch(FREQUENCIES, pretoken=list(found), n=list(found.values()))


LEXICON = pa.schema([("pretoken", pa.string()), ("n", pa.int64()), ("pieces", pa.int64())])


def with_pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    split = PreTokens(path)
    for b in batches:
        names = column(b, "pretoken")
        yield batch(LEXICON, pretoken=names, n=column(b, "n"), pieces=split.counts(names.to_pylist()))


def lexicon(docs: DataFrame, path: str) -> DataFrame:
    """pretoken, n (how often it occurs in all texts) and pieces (tokens that it makes)."""
    counted = docs.select("text").mapInArrow(lambda bs: tidied(frequencies(bs, path)), "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return stored(counted.mapInArrow(lambda bs: tidied(with_pieces(bs, path)), "pretoken string, n long, pieces long"), "lexicon")


ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("head", pa.int64()), ("pretoken", pa.string()), ("freq", pa.int64())])
ROWS_DDL = "row long, doc_id long, n_bytes long, head long, pretoken string, freq long"


def document_rows(batches: Iterator[pa.RecordBatch], path: str, head: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """For each document a row with the pieces of the head's pre-tokens, and a row for each rarer pre-token in it.

    The first kind's key is a string that no pre-token is, another for each row, so that it is dealt evenly.
    """
    split = PreTokens(path)
    for b in batches:
        at = 0
        rows, names, texts = column(b, "row").to_numpy(), column(b, "doc_id"), pc.fill_null(column(b, "text"), "")
        sizes = pc.binary_length(texts)
        for part in chunks(texts, CHUNK):
            n = len(part)
            codes, first, made = split.coded(part)
            known = np.fromiter((sum([head.get(t, 0) for t in tokens]) for tokens in made), np.int64, len(made))
            ids: dict[str, int] = {}
            rare = [[ids.setdefault(t, len(ids)) for t in tokens if t not in head] for tokens in made]
            n_rare = np.fromiter(map(len, rare), np.int64, len(rare))
            flat, starts = np.fromiter((t for r in rare for t in r), np.int64, int(n_rare.sum())), np.cumsum(n_rare) - n_rare
            own = rows[at : at + n]
            yield batch(ROWS, row=own, doc_id=names.slice(at, n), n_bytes=sizes.slice(at, n), head=np.add.reduceat(known[codes], first), pretoken=[f"\0{r}" for r in own.tolist()], freq=pa.nulls(n))
            lengths = n_rare[codes]
            if total := int(lengths.sum()):
                of_row = np.repeat(np.repeat(np.arange(n), np.diff([*first.tolist(), len(codes)])), lengths)
                shift = np.cumsum(lengths) - lengths
                tokens = flat[np.arange(total) + np.repeat(starts[codes] - shift, lengths)]
                pairs, freq = np.unique(of_row * len(ids) + tokens, return_counts=True)
                yield batch(ROWS, row=own[pairs // len(ids)], doc_id=pa.nulls(len(pairs)), n_bytes=pa.nulls(len(pairs)), head=pa.nulls(len(pairs)), pretoken=pa.array(list(ids)).take(pa.array(pairs % len(ids))), freq=freq)
            at += n


def token_counts(docs: DataFrame, path: str, head_size: int = HEAD) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row of documents(doc_id, text)."""
    spark = docs.sparkSession
    words = lexicon(docs, path)
    head = {r["pretoken"]: r["pieces"] for r in words.orderBy(F.desc("n"), "pretoken").limit(head_size).select("pretoken", "pieces").toLocalIterator()}
    shared = spark.sparkContext.broadcast(head)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda bs: tidied(document_rows(bs, path, shared.value)), ROWS_DDL)
    joined = rows.join(words.select("pretoken", "pieces"), "pretoken", "left")
    summed = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), (F.max("head") + F.sum(F.coalesce(F.col("freq") * F.col("pieces"), F.lit(0)))).alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens")
