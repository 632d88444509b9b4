"""MinHash near-dedup with HyperMinHash sketches.

A document's set is its distinct k-word shingles (with fewer words: all of them as one; without words: empty, and
linked with nothing). Documents are linked when their sets' Jaccard similarity reaches the threshold, and grouped by
connected components.

1. One pass makes each document's sketch: REGISTERS buckets by the first bits of a shingle's 64-bit hash; a register
   holds the leading zeros of the bucket's smallest remaining hash (6 bits) and the mantissa bits after them (10).
   Empty buckets borrow from a filled one chosen by a fixed random order. Equal sets form classes; from here on one
   member stands for its class, so copies make no pairs.
2. Bands of ROWS registers, hashed, are buckets. 42 bands of 6 miss a pair of similarity 0.8 with 3 in a million.
   In each bucket its smallest member is compared to all others: as many pairs as members.
3. A pair's registers give a similarity, corrected for registers that agree by chance; pairs further below the
   threshold than six standard errors go, all others are verified on full sets.
4. Buckets whose other members aren't all in one component yet are compared in blocks of at most about BLOCK members
   and BLOCK_SHINGLES shingles by as many: sketches first, full sets then, and only between components. A block passes on just the links that join
   components there, so a group of n members gives at most n of them, and no pair of different texts that share a band
   is left out.

Rows with null doc_id or the same doc_id are nodes of their own. A component's id is its smallest doc_id (null only if
all are), and its kept row the first by (doc_id, place in the input). Other columns are left alone, whatever their
names; empty tables give empty results. Rows are numbered in a written table, which all later steps read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddymesh.llm.common import LOWER, batch, column, numbered, scratch, stored, tidied
from eddymesh.llm.components import components
from eddymesh.llm.tokens import chunks

REGISTERS, ROWS, MANTISSA = 256, 6, 10
BANDS = REGISTERS // ROWS
#: Members of a block, and shingles of all of them on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Bytes of text whose words are in memory at once; a longer text is alone.
CHUNK = 2 << 20
#: The share of a union that must be common, as a fraction.
THRESHOLD = (80, 100)
_RNG = np.random.default_rng(20240501)
#: A factor for each word of a shingle, and for each empty bucket an order of the buckets to borrow from.
FACTORS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
DONORS = _RNG.permuted(np.tile(np.arange(REGISTERS, dtype=np.int32), (REGISTERS, 1)), axis=1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes half of the output."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for part in chunks(texts, CHUNK):
        words, counts = [], []
        for text in part:
            data = text.as_buffer().to_pybytes().translate(LOWER).split() if text.is_valid else []
            words += data
            counts.append(len(data))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        whole = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for j in range(k):
            whole += hashes[j : j + len(whole)] * FACTORS[j]
        whole, at = mixed(whole), 0
        for n in counts:
            if n >= k:
                yield np.unique(whole[at : at + n - k + 1])
            elif n:
                yield mixed((hashes[at : at + n] * FACTORS[:n]).sum(keepdims=True) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)
            at += n


def sketch(values: np.ndarray) -> np.ndarray:
    """Registers of a sorted, non-empty set."""
    bucket = (values >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    full = bucket[first]
    rest = (values[first] << np.uint64(8)) | np.uint64(1)
    zeros = (64 - np.frexp(rest.astype(np.float64))[1]).astype(np.uint64)
    mantissa = (rest << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    registers = np.zeros(REGISTERS, np.uint16)
    registers[full] = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    if len(full) < REGISTERS:
        empty = np.ones(REGISTERS, bool)
        empty[full] = False
        rank = DONORS[np.flatnonzero(empty)[:, None], full[None, :]]
        registers[empty] = registers[full[rank.argmin(axis=1)]]
    return registers


def chance(n: np.ndarray) -> np.ndarray:
    """For sets of n, how likely each count of leading zeros is for a filled bucket's smallest hash."""
    per = np.maximum(np.asarray(n, np.float64) / REGISTERS, 1.0)[:, None]
    edges = (1 - 2.0 ** -np.arange(0, 41)[None, :]) ** per
    edges[:, 0] = 0
    return np.diff(edges, axis=1)


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (a row each), corrected for agreement by chance."""
    agree = (a == b).mean(axis=-1)
    by_chance = (chance(n_a) * chance(n_b)).sum(axis=1) / (1 << MANTISSA)
    return (agree - by_chance) / (1 - by_chance)


def margin(n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Six standard errors of the estimate at the threshold; small sets have fewer registers of their own."""
    return 6 * np.sqrt(least * (1 - least) / np.minimum(np.minimum(n_a, n_b), REGISTERS))


def linked(common: int, n_a: int, n_b: int, threshold: tuple[int, int]) -> bool:
    return threshold[1] * common >= threshold[0] * (n_a + n_b - common)


SIGNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("registers", pa.binary())])
SIGNED_DDL = "row long, doc_id long, n long, key binary, registers binary"


def signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, sizes, keys, registers = column(b, "row"), [], [], []
        for own, row in zip(shingle_sets(column(b, "text"), k), rows.to_pylist(), strict=True):
            sizes.append(len(own))
            keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else row.to_bytes(8, "little"))
            registers.append(sketch(own).tobytes() if len(own) else None)
        yield batch(SIGNED, row=rows, doc_id=column(b, "doc_id"), n=sizes, key=keys, registers=registers)


SETS = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("registers", pa.binary()), ("shingles", pa.binary())])


def full_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [s.tobytes() for s in shingle_sets(column(b, "text"), k)]
        if any(xxhash.xxh3_128_digest(s) != key for s, key in zip(own, column(b, "key").to_pylist())):
            raise ValueError("the documents changed between two reads")
        yield batch(SETS, row=column(b, "row"), n=column(b, "n"), registers=column(b, "registers"), shingles=own)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def matrix(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def likely(batches: Iterator[pa.RecordBatch], threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches don't rule them out."""
    least = threshold[0] / threshold[1]
    for b in batches:
        n_a, n_b = column(b, "n_a").to_numpy(), column(b, "n_b").to_numpy()
        close = estimated(matrix(column(b, "registers_a")), matrix(column(b, "registers_b")), n_a, n_b) >= least - margin(n_a, n_b, least)
        yield pa.RecordBatch.from_arrays([column(b, c).filter(pa.array(close)) for c in ("a", "b")], schema=PAIR)


def verified(batches: Iterator[pa.RecordBatch], threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept = []
        for x, y in zip(column(b, "shingles_a"), column(b, "shingles_b")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            kept.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), threshold))
        yield pa.RecordBatch.from_arrays([column(b, c).filter(pa.array(kept, pa.bool_())) for c in ("a", "b")], schema=PAIR)


class Joined(dict):
    """Union-find over component ids."""

    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = self.get(up, up)
            x = up
        return x


def compared(rows: list[dict], threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between the components of a block: enough to join all that its pairs join."""
    least, roots, out = threshold[0] / threshold[1], Joined(), []
    registers = np.stack([np.frombuffer(r["registers"], np.uint16) for r in rows])
    n, side = np.array([r["n"] for r in rows]), np.array([r["side"] for r in rows])
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
    root, odds = np.array([r["root"] for r in rows]), chance(n)
    agree = np.stack([(registers == own).mean(axis=1) for own in registers])
    by_chance = odds @ odds.T / (1 << MANTISSA)
    guess = (agree - by_chance) / (1 - by_chance)
    sizes = np.minimum(n[:, None], n[None, :]) * threshold[1] >= np.maximum(n[:, None], n[None, :]) * threshold[0]
    close = np.triu((guess >= least - margin(n[:, None], n[None, :], least)) & (root[:, None] != root[None, :]) & sizes, 1)
    if side.any():  # two blocks: only between them
        close &= side[:, None] != side[None, :]
    i, j = np.nonzero(close)
    for k in np.argsort(-guess[i, j], kind="stable"):
        a, b = int(i[k]), int(j[k])
        x, y = roots.find(int(root[a])), roots.find(int(root[b]))
        if x != y and linked(len(np.intersect1d(sets[a], sets[b], assume_unique=True)), len(sets[a]), len(sets[b]), threshold):
            roots[max(x, y)] = min(x, y)
            out.append((rows[a]["row"], rows[b]["row"]))
    return out


def compared_blocks(batches: Iterator[pa.RecordBatch], threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Blocks come sorted, one after another."""
    held: list[dict] = []

    def links() -> pa.RecordBatch:
        found = compared(held, threshold)
        return batch(PAIR, a=[a for a, _ in found], b=[b for _, b in found])

    for b in batches:
        for row in b.to_pylist():
            if held and any(held[-1][c] != row[c] for c in ("band", "one", "other")):
                yield links()
                held.clear()
            held.append(row)
    if held:
        yield links()


def bands() -> Column:
    """Bucket keys of the column `registers`."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """row (a number of its own for each row), doc_id, n_shingles, component_id and kept of documents(doc_id, text)."""
    return grouped(numbered(docs, ["doc_id", "text"]), k, threshold)


def grouped(rows: DataFrame, k: int, threshold: tuple[int, int]) -> DataFrame:
    """near_duplicates of numbered rows(row, of: a struct with doc_id and text)."""
    with scratch() as kept:
        texts = rows.select("row", F.col("of.doc_id").cast("long").alias("doc_id"), F.col("of.text").alias("text"))
        members = stored(texts.mapInArrow(lambda bs: tidied(signed(bs, k)), SIGNED_DDL), "sketches")
        classes = stored(members.groupBy("key").agg(F.min("row").alias("class")), "classes")
        heads = members.where("n > 0").join(classes.select(F.col("class").alias("row")), "row", "left_semi")
        in_bands = heads.select("row", F.explode(bands()).alias("band"))
        buckets = in_bands.groupBy("band").agg(F.min("row").alias("pivot"), F.count("*").alias("members")).where("members > 1")
        shared = stored(in_bands.join(buckets, "band"), "buckets")
        # Each bucket's smallest member against the others.
        pairs = shared.where("row <> pivot").select(F.col("pivot").alias("a"), F.col("row").alias("b")).distinct()
        signs = members.select("row", "n", "registers")

        def both(pairs: DataFrame, of: DataFrame) -> DataFrame:
            for end in ("a", "b"):
                pairs = pairs.join(of.select(*[F.col(c).alias(end if c == "row" else f"{c}_{end}") for c in of.columns]), end)
            return pairs

        near = stored(both(pairs, signs).mapInArrow(lambda bs: tidied(likely(bs, threshold)), "a long, b long"), "likely-pairs")
        # Full sets of those that a comparison on full sets can need.
        need = near.select(F.col("a").alias("row")).union(near.select("b")).union(shared.where("members > 2").select("row")).distinct()
        needed = texts.select("row", "text").join(members.select("row", "n", "key", "registers").join(need, "row", "left_semi"), "row")
        sets = stored(needed.mapInArrow(lambda bs: tidied(full_sets(bs, k)), "row long, n long, registers binary, shingles binary"), "shingles")
        links = stored(both(near, sets.select("row", "shingles")).mapInArrow(lambda bs: tidied(verified(bs, threshold)), "a long, b long"), "links")
        found = components(links)
        # Members of buckets of which some aren't in one component yet, without the pivot, which all were compared to.
        rest = shared.where("row <> pivot and members > 2").select("band", "row").join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
        rest = rest.join(members.select("row", "n"), "row")
        open_ = rest.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"), F.sum("n").alias("size")).where("low < high")
        open_ = stored(open_.select("band", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "open-buckets")
        dealt = rest.drop("n").join(open_, "band").withColumn("own", F.pmod(F.xxhash64("row", "band"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keyed = dealt.select("band", "row", "root", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("other"), (F.col("own") > F.col("with")).cast("int").alias("side"))
        full = keyed.join(sets, "row")
        blocks = full.repartition("band", "one", "other").sortWithinPartitions("band", "one", "other", "row")
        more = stored(blocks.mapInArrow(lambda bs: tidied(compared_blocks(bs, threshold)), "a long, b long"), "links")
        if not more.isEmpty():
            found = components(links.union(more))
        # From classes back to rows. Both tables of a class or a component are written before they meet the rows, so that
        # these joins are of two shuffled tables, whose crowded partitions Spark can split.
        of_class = stored(classes.join(found.withColumnRenamed("node", "class"), "class", "left").select("key", F.coalesce("root", "class").alias("root")), "roots")
        labelled = stored(members.select("row", "doc_id", "n", "key").join(of_class, "key").drop("key"), "labelled")
        first = stored(labelled.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")), "first-rows")
        kept += [labelled, first]
    return labelled.join(first, "root").select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with their columns."""
    rows = numbered(docs)
    return rows.join(grouped(rows, k, threshold).where("kept").select("row"), "row", "left_semi").select("of.*")
