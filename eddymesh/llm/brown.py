"""Language-model scores by Brown classes: class-transition and word-emission probabilities.

A text is its words in lower case, then one end token. The model is P(word | before) = P(class | class before) *
P(word | class), with an end before the first word.

1. Word counts over all training texts, a written table; the HEAD most frequent words go to every worker (a fixed
   number).
2. Exchange clustering: the most frequent words, CLUSTERED or GROWTH times the cube root of the number of distinct
   words if that is more, are moved between CLASSES classes, each to where the mutual information of neighbouring
   classes rises most, until a sweep moves none or SWEEPS are over. Only their bigram counts reach the driver. Every
   other training word is assigned, distributed, to the class that makes its neighbours' classes likeliest: its counts
   of neighbouring classes are dealt out by word (summed up by each task first for the words up to CLASSED). The
   end is a class of its own.
3. Class sequences of all texts, a written table: workers fill in the classes of the words they have, the others'
   places are joined with the words' classes and counts by shuffle, and come back to their text by another.
4. Class bigrams over the sequences of the training texts; transitions are smoothed with the classes' own frequency.
5. Scores. A word of count c has c / tokens in its class. Unknown words belong to the class that most words seen once
   belong to; there a word of count c has (c + 1) / (tokens + types + 1), an unknown word 1 / (the same):
   probabilities sum to 1.

base_score: the sum over tokens of log10((c + 1) / (N + V + 1)) with c the token's count, N all and V the distinct
training tokens. Null and empty texts are an end alone. Rows with null doc_id belong to training; rows with the same
doc_id are texts of their own. Without training texts every word is unknown. Other columns are left alone; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymesh.llm.common import LOWER, batch, column, stored, tidied
from eddymesh.llm.quality import held_out
from eddymesh.llm.tokens import chunks

HEAD, CLASSED, CLUSTERED, CLASSES, SWEEPS = 1 << 17, 1 << 15, 1024, 64, 12
#: Words that a worker sums up before it passes them on; weight of the classes' own frequency in transitions.
HELD, SMOOTH, GROWTH = 150_000, 20.0, 6
#: Words whose classes are weighed at a time.
WEIGHED = 1 << 14
#: Bytes of text whose words are in memory at once; a longer text is alone.
CHUNK = 4 << 20


def word_lists(texts: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """For each run of rows: all words, and how many each row has."""
    for part in chunks(texts, CHUNK):
        words, counts = [], []
        for text in part:
            own = text.as_buffer().to_pybytes().translate(LOWER).split() if text.is_valid else []
            words += own
            counts.append(len(own))
        yield words, np.array(counts, np.int64)


COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()
    for b in batches:
        for words, _ in word_lists(column(b, "text")):
            found.update(words)
            if len(found) > HELD:
                yield batch(COUNTS, word=list(found), n=list(found.values()))
                found = Counter()
    yield batch(COUNTS, word=list(found), n=list(found.values()))


def sequences(words: list[bytes], counts: np.ndarray, ids: dict[bytes, int], other: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, an end after each row's; and where the ends are."""
    at = np.cumsum(counts + 1) - 1
    out = np.full(len(words) + len(counts), end, np.int64)
    inner = np.ones(len(out), bool)
    inner[at] = False
    get = ids.get
    out[inner] = np.fromiter(map(get, words, repeat(other)), np.int64, len(words))
    return out, at


def before(ids: np.ndarray, ends: np.ndarray, end: int) -> np.ndarray:
    """What stands before each token; an end before a row's first."""
    out = np.empty_like(ids)
    out[1:], out[0] = ids[:-1], end
    return out


PAIRS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])


def bigrams(batches: Iterator[pa.RecordBatch], ids: dict[bytes, int], size: int) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring ids, as before * size + after. The last two ids: others, the end."""
    dense = size * size <= 1 << 22
    held = np.zeros(size * size if dense else 0, np.int64)
    for b in batches:
        for words, counts in word_lists(column(b, "text")):
            own, ends = sequences(words, counts, ids, size - 2, size - 1)
            pairs = before(own, ends, size - 1) * size + own
            if dense:
                held += np.bincount(pairs, minlength=size * size)
            else:
                seen, n = np.unique(pairs, return_counts=True)
                yield batch(PAIRS, pair=seen, n=n)
    seen = np.flatnonzero(held)
    yield batch(PAIRS, pair=seen, n=held[seen])


def class_bigrams(batches: Iterator[pa.RecordBatch], size: int, kind: type) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring classes in class sequences; the last class is the end."""
    held = np.zeros(size * size, np.int64)
    for b in batches:
        own, sizes = unpacked(column(b, "seq"), kind)
        own = own.astype(np.int64)
        if len(own):
            held += np.bincount(before(own, np.cumsum(sizes) - 1, size - 1) * size + own, minlength=size * size)
    seen = np.flatnonzero(held)
    yield batch(PAIRS, pair=seen, n=held[seen])


def matrix(pairs: DataFrame, size: int) -> np.ndarray:
    """A (size x size) matrix of counts."""
    rows = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary rows of values[offsets[k]:offsets[k + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(rows: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of binary rows, and how many each row has."""
    if not len(rows):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    _, at, data = rows.buffers()
    at = np.frombuffer(at, np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if at[-1] > at[0] else np.zeros(0, kind), np.diff(at) // size


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, words: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each of the first `words` ids; the last two ids keep classes of their own."""
    total = classes + 2
    of = np.concatenate([np.arange(words) % classes, [classes, classes + 1]])
    grid = np.zeros((total, total))
    np.add.at(grid, (of[:, None], of[None, :]), pairs)
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            own = of[w]
            after, past, self_ = np.bincount(of, pairs[w], total), np.bincount(of, pairs[:, w], total), pairs[w, w]
            after[own] -= self_
            past[own] -= self_
            if not after.any() and not past.any():
                continue
            grid[own] -= after
            grid[:, own] -= past
            grid[own, own] -= self_
            # Change of sum x log x when the word joins each class, cell by cell of that class's row and column.
            c = np.arange(classes)
            old = xlogx(grid)
            row, col = xlogx(grid[:classes] + after) - old[:classes], xlogx(grid[:, :classes] + past[:, None]) - old[:, :classes]
            gain = row.sum(axis=1) + col.sum(axis=0) - row[c, c] - col[c, c]
            gain += xlogx(grid[c, c] + after[:classes] + past[:classes] + self_) - old[c, c]
            out_, in_ = grid.sum(axis=1)[:classes], grid.sum(axis=0)[:classes]
            n_out, n_in = after.sum() + self_, past.sum() + self_
            gain -= xlogx(out_ + n_out) - xlogx(out_) + xlogx(in_ + n_in) - xlogx(in_)
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = int(own)
            moved += best != own
            of[w] = best
            grid[best] += after
            grid[:, best] += past
            grid[best, best] += self_
        if not moved:
            break
    return of


CONTEXT = pa.schema([("word", pa.binary()), ("at", pa.binary()), ("n", pa.binary())])


def contexts(batches: Iterator[pa.RecordBatch], ids: dict[bytes, int], classes: np.ndarray, last: int) -> Iterator[pa.RecordBatch]:
    """For each word without a class how often each class stands before (its number) or after (plus their number) it.
    The words with one are the first of ids; all others count as one class. Words before `last` are summed up by the
    task, later ones and those that aren't in ids by each run of rows."""
    first, size = len(classes) - 2, int(classes[-1]) + 1
    held = np.zeros((last - first) * 2 * size, np.int32)
    other, end = len(ids), len(ids) + 1
    table = np.full(len(ids) + 2, size - 2)
    table[:first], table[end] = classes[:first], size - 1

    def rows(words: list[bytes], keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        own, begin = np.unique(keys // (2 * size), return_index=True)
        offsets = np.append(begin, len(keys))
        return batch(CONTEXT, word=pa.array(words, pa.binary()).take(pa.array(own)), at=packed((keys % (2 * size)).astype(np.uint16), offsets), n=packed(n.astype(np.uint32), offsets))

    for b in batches:
        for words, counts in word_lists(column(b, "text")):
            own, ends = sequences(words, counts, ids, other, end)
            kinds = table[own]
            past = before(kinds, ends, size - 1)
            mine = np.flatnonzero((own >= first) & (own < last))
            place = (own[mine] - first) * (2 * size)
            np.add.at(held, place + past[mine], 1)
            np.add.at(held, place + size + kinds[mine + 1], 1)
            far = np.flatnonzero((own >= last) & (own != end))
            if len(far):
                found, codes = coded(words, far - np.searchsorted(ends, far))
                place = codes * (2 * size)
                yield rows(found, *np.unique(np.concatenate([place + past[far], place + size + kinds[far + 1]]), return_counts=True))
    seen = np.flatnonzero(held)
    yield rows(list(ids)[first:last], seen, held[seen])


def coded(words: list[bytes], at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words at these places, and for each place which of them it has."""
    found: dict[bytes, int] = {}
    codes = np.fromiter((found.setdefault(words[k], len(found)) for k in at.tolist()), np.int64, len(at))
    return list(found), codes


LEARNT = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("class", pa.int32())])
LEARNT_DDL = "word binary, n long, class int"


def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """A partition's rows, each column in one piece."""
    parts = [b for b in batches if len(b)]
    return pa.Table.from_batches(parts).combine_chunks() if parts else None


def one(rows: pa.Table, name: str) -> pa.Array:
    found = rows[name]
    return found.chunk(0) if found.num_chunks == 1 else found.combine_chunks()


def assigned(batches: Iterator[pa.RecordBatch], odds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each word's count and the class under which its neighbours are likeliest. odds: classes x contexts, log
    probabilities."""
    rows = whole(batches)
    if rows is None:
        return
    words = one(rows, "word").dictionary_encode()
    at, sizes = unpacked(one(rows, "at"), np.uint16)
    n = unpacked(one(rows, "n"), np.uint32)[0]
    entry = np.repeat(words.indices.to_numpy(), sizes).astype(np.int64)
    order = np.argsort(entry, kind="stable")
    entry, at, n, width = entry[order], at[order], n[order], odds.shape[1]
    for k in range(0, len(words.dictionary), WEIGHED):
        own = words.dictionary.slice(k, WEIGHED)
        lo, hi = np.searchsorted(entry, [k, k + len(own)])
        counts = np.bincount((entry[lo:hi] - k) * width + at[lo:hi], n[lo:hi], len(own) * width).reshape(len(own), width)
        yield batch(LEARNT, word=own, n=counts[:, : width // 2].sum(axis=1).astype(np.int64), **{"class": np.argmax(counts @ odds.T, axis=1)})


RANKED = pa.schema([("id", pa.int64()), ("class", pa.int32())])


def ranked(batches: Iterator[pa.RecordBatch], ids: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """The classes of the words that every worker has."""
    for b in batches:
        own = np.fromiter(map(ids.get, column(b, "word").to_pylist(), repeat(-1)), np.int64, len(b))
        seen = np.flatnonzero(own >= 0)
        yield batch(RANKED, id=own[seen], **{"class": column(b, "class").take(pa.array(seen))})


ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("emit", pa.float64()), ("word", pa.binary()), ("data", pa.binary())])
ROWS_DDL = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, emit double, word binary, data binary"


def document_rows(batches: Iterator[pa.RecordBatch], ids: dict[bytes, int], classes: np.ndarray, base: np.ndarray, emit: np.ndarray, kind: type) -> Iterator[pa.RecordBatch]:
    """Per document a row with its classes and the sums over the workers' own words, and a row with the places of each
    rarer word in it.

    The first kind's word is no word (it holds a space), another for each row, so that it is dealt evenly.
    """
    other, end = len(classes) - 2, len(classes) - 1
    for b in batches:
        at = 0
        for words, counts in word_lists(column(b, "text")):
            n = len(counts)
            own, ends = sequences(words, counts, ids, other, end)
            first = ends - counts
            rows = column(b, "row").slice(at, n)
            sums = [np.add.reduceat(x, first) for x in (base[own], emit[own], (own != other) & (base[own] != 0))]
            yield batch(ROWS, row=rows, doc_id=column(b, "doc_id").slice(at, n), held_out=column(b, "held_out").slice(at, n), n_tokens=counts + 1, base=sums[0], emit=sums[1], known=sums[2].astype(np.int64), word=[b" %d" % r for r in rows.to_pylist()], data=packed(classes[own].astype(kind), np.append(0, ends + 1)))
            rare = np.flatnonzero(own == other)
            if len(rare):
                of_row = np.searchsorted(ends, rare)
                found, codes = coded(words, rare - of_row)
                keys = of_row * len(found) + codes
                order = np.argsort(keys, kind="stable")
                keys, begin = np.unique(keys[order], return_index=True)
                none = pa.nulls(len(keys))
                places = packed((rare - first[of_row])[order].astype(np.uint32), np.append(begin, len(order)))
                yield batch(ROWS, row=rows.take(pa.array(keys // len(found))), doc_id=none, held_out=none, n_tokens=none, known=none, base=none, emit=none, word=pa.array(found, pa.binary()).take(pa.array(keys % len(found))), data=places)
            at += n


def emission(n: np.ndarray, classes: np.ndarray, in_class: np.ndarray, unknown: int, unknown_whole: float) -> np.ndarray:
    """log10 P(word | class) by the words' counts and classes."""
    return np.log10(np.where(classes == unknown, (n + 1) / unknown_whole, np.maximum(n, 1) / np.maximum(in_class, 1)[classes]))


CODED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("emit", pa.float64()), ("seq", pa.binary())])
CODED_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emit double, seq binary"


def sequenced(batches: Iterator[pa.RecordBatch], kind: type, tokens: float, in_class: np.ndarray, unknown: int, unknown_whole: float) -> Iterator[pa.RecordBatch]:
    """Documents with the classes of all their words; a partition has all rows of its documents."""
    rows = whole(batches)
    if rows is None:
        return
    is_text = pc.is_valid(rows["n_tokens"])
    texts, rare = rows.filter(is_text).sort_by("row"), rows.filter(pc.invert(is_text))
    seq, sizes = unpacked(one(texts, "data"), kind)
    seq, start = seq.copy(), np.cumsum(sizes) - sizes
    base, emit, known = (one(texts, c).to_numpy().copy() for c in ("base", "emit", "known"))
    if len(rare):
        text = np.searchsorted(one(texts, "row").to_numpy(), one(rare, "row").to_numpy())
        places, freq = unpacked(one(rare, "data"), np.uint32)
        n = pc.fill_null(one(rare, "n"), 0).to_numpy()
        classes = pc.fill_null(one(rare, "class"), unknown).to_numpy()
        seq[np.repeat(start[text], freq) + places] = np.repeat(classes, freq)
        base += np.bincount(text, freq * np.log10((n + 1) / tokens), len(base))
        emit += np.bincount(text, freq * emission(n, classes, in_class, unknown, unknown_whole), len(emit))
        known += np.bincount(text, freq * (n > 0), len(known)).astype(np.int64)
    yield batch(CODED, doc_id=one(texts, "doc_id"), held_out=one(texts, "held_out"), n_tokens=one(texts, "n_tokens"), n_known=known, base_score=base, emit=emit, seq=packed(seq, np.append(0, np.cumsum(sizes))))


SCORED = pa.schema([*[f for f in CODED if f.name not in ("emit", "seq")], ("score", pa.float64())])


def scored(batches: Iterator[pa.RecordBatch], step: np.ndarray, kind: type) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seq, sizes = unpacked(column(b, "seq"), kind)
        if len(sizes):
            ends = np.cumsum(sizes) - 1
            moves = np.add.reduceat(step[before(seq, ends, len(step) - 1), seq], ends + 1 - sizes)
            yield batch(SCORED, score=column(b, "emit").to_numpy() + moves, **{f.name: column(b, f.name) for f in SCORED if f.name != "score"})


def brown_scores(docs: DataFrame, parts: int = 7, head: int = HEAD, classed: int = CLASSED, clustered: int = CLUSTERED, n_classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of documents(doc_id, text).

    Learns from the rows whose crc32(doc_id) mod `parts` is not 2.
    """
    spark = docs.sparkSession
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id"), parts).alias("held_out"))
    training = numbered.where(~F.col("held_out")).select("text")
    words = stored(training.mapInArrow(lambda bs: tidied(word_counts(bs)), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    ends = training.count()
    sums = words.agg(F.sum("n"), F.count("*")).first()
    tokens, types = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    top = words.orderBy(F.desc("n"), "word").limit(head).toArrow()
    names, counts = top["word"].to_pylist(), top["n"].to_numpy()
    n_head, clustered = len(names), min(max(clustered, round(GROWTH * types ** (1 / 3))), len(names))
    classed = max(clustered, min(classed, n_head))
    ids = spark.sparkContext.broadcast({bytes(w): k for k, w in enumerate(names)})
    few = spark.sparkContext.broadcast({bytes(w): k for k, w in enumerate(names[:clustered])})
    # Classes 0 .. n_classes - 1 by exchange, then all words without one and the end.
    pairs = matrix(training.mapInArrow(lambda bs: tidied(bigrams(bs, few.value, clustered + 2)), "pair long, n long"), clustered + 2)
    first = exchange(pairs, clustered, n_classes)
    grid = np.full((n_classes + 2, n_classes + 2), 0.5)
    np.add.at(grid, (first[:, None], first[None, :]), pairs)
    odds = np.concatenate([np.log(grid / grid.sum(axis=0))[:, :n_classes].T, np.log(grid / grid.sum(axis=1, keepdims=True))[:n_classes]], axis=1)
    spread = training.mapInArrow(lambda bs: tidied(contexts(bs, ids.value, first, classed)), "word binary, at binary, n binary")
    others = spread.repartition("word").mapInArrow(lambda bs: tidied(assigned(bs, odds)), LEARNT_DDL)
    exchanged = pa.Table.from_batches([batch(LEARNT, word=names[:clustered], n=counts[:clustered], **{"class": first[:clustered]})])
    # All training words with their counts and classes.
    learnt = stored(others.unionByName(spark.createDataFrame(exchanged)) if clustered else others, "classes")
    found = learnt.mapInArrow(lambda bs: tidied(ranked(bs, ids.value)), "id long, class int").toArrow()
    end, size, kind = n_classes, n_classes + 1, np.min_scalar_type(n_classes)
    table = np.zeros(n_head + 2, np.int64)
    table[found["id"].to_numpy()], table[-1] = found["class"].to_numpy(), end
    in_class, types_in, once = np.zeros(size), np.zeros(size), np.zeros(size)
    for r in learnt.groupBy("class").agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("long"))).collect():
        in_class[r[0]], types_in[r[0]], once[r[0]] = r[1:]
    unknown = int(np.argmax(once))
    unknown_whole, all_whole = in_class[unknown] + types_in[unknown] + 1, float(tokens + types + 1)
    # Others' sums come from the join; a known word's base is never 0, for it isn't all there is.
    base = np.concatenate([np.log10((counts + 1) / all_whole), [0.0, np.log10((ends + 1) / all_whole)]])
    emit = np.concatenate([emission(counts, table[:n_head], in_class, unknown, unknown_whole), [0.0, 0.0]])
    sent = spark.sparkContext.broadcast((table, base, emit))
    rows = numbered.mapInArrow(lambda bs: tidied(document_rows(bs, ids.value, *sent.value, kind)), ROWS_DDL)
    joined = rows.join(learnt, "word", "left").drop("word").repartition("row")
    texts = stored(joined.mapInArrow(lambda bs: tidied(sequenced(bs, kind, all_whole, in_class, unknown, unknown_whole)), CODED_DDL), "sequences")
    grid = matrix(texts.where(~F.col("held_out")).select("seq").mapInArrow(lambda bs: class_bigrams(bs, size, kind), "pair long, n long"), size)
    own = grid.sum(axis=0)
    unigram = (own + 1) / (own.sum() + size)
    step = np.log10((grid + SMOOTH * unigram) / (grid.sum(axis=1, keepdims=True) + SMOOTH))
    out = texts.mapInArrow(lambda bs: scored(bs, step, kind), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
