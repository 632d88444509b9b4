"""Exact top-k search by distributed histogram selection.

Every query is scored against every row: the queries go out in blocks of a fixed number, so a broadcast doesn't grow
with the input, and each task multiplies a block with its rows. A block's results are written, and its broadcasts
removed, before the next begins. Scores are integers, and exact: products of norms tell where doubles could round,
where 64-bit integers are multiplied instead, and where those could overflow, which leaves exact integers of any size;
a score beyond 64 bits is given as the largest or smallest 64-bit number, and ties among these go by id. A first pass counts them in BINS
equal bins for each query; the bin that holds the k-th largest is split into BINS again, until its width is 1 and the
k-th value is known exactly. A last pass keeps the rows above it, and of the rows equal to it the smallest ids.

A task passes on counts only from the bin of its own k-th largest upwards, for the global k-th is nowhere below, and
of its last rows at most k for each query: nothing is lost, and one very common vector makes no long lists.

Vectors that are null, empty, or hold a null or a component that isn't finite (64-fold), take no part. A query's
candidates are the rows of its own length; each length is searched on its own. Rows with the same id are rows, and queries, of their own; rows with a query's id are no
candidates for it. With fewer than k
candidates all are given. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddymesh.llm.common import batch, column, stored, tidied

BINS = 512
#: Queries that go out at once, and that are multiplied at once.
QUERIES, BLOCK = 16_384, 1_024
#: Rows of a task that are scored at once.
ROWS = 4_096
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(embedding: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component, as doubles, which hold these integers exactly; null where the vector is null
    or a component is null or not finite."""
    large = 2.0**53  # from here on doubles are integers

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < large, F.floor(y).cast("double")).otherwise(y)

    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, whole))


def matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        ids, vectors = column(b, "id").to_numpy(), column(b, "v").flatten().to_numpy().reshape(-1, dim)
        for at in range(0, len(ids), ROWS):
            yield ids[at : at + ROWS], vectors[at : at + ROWS]


def norms(rows: np.ndarray) -> np.ndarray:
    """Lengths of rows, a little more rather than less."""
    with np.errstate(over="ignore"):
        return np.sqrt((rows**2).sum(axis=1)) * (1 + 1e-9)


def integers(rows: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in rows.tolist()], dtype=object).reshape(rows.shape)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products (queries x rows) of integers held as doubles, exact up to 64 bits and clipped there."""
    of_query, of_row = norms(queries), norms(rows)
    most = of_query.max(initial=0.0) * of_row.max(initial=0.0)
    if most < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    with np.errstate(over="ignore"):
        reach = of_query[:, None] * of_row[None, :]
    out = np.zeros(reach.shape, np.int64)
    # Components of pairs that stay below 64 bits do so too, for those of the other pairs it doesn't matter.
    wide = reach >= 2.0**63
    q, r = np.flatnonzero(~wide.all(axis=1)), np.flatnonzero(~wide.all(axis=0))
    if len(q) and len(r):
        low = [np.where(np.abs(x) < 2.0**63, x, 0.0).astype(np.int64) for x in (queries[q], rows[r])]
        out[np.ix_(q, r)] = low[0] @ low[1].T
    q, r = np.flatnonzero(wide.any(axis=1)), np.flatnonzero(wide.any(axis=0))
    if len(q):
        exact = np.clip(integers(queries[q]) @ integers(rows[r]).T, LEAST, MOST).astype(np.int64)
        out[np.ix_(q, r)] = np.where(wide[np.ix_(q, r)], exact, out[np.ix_(q, r)])
    return out


def scores(ids: np.ndarray, rows: np.ndarray, qids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores (queries x rows) and where a row is the query's own."""
    return products(queries, rows), qids[:, None] == ids[None, :]


HIST = pa.schema([("query", pa.int64()), ("bin", pa.int64()), ("n", pa.int64())])


def histograms(batches: Iterator[pa.RecordBatch], sent: tuple, k: int) -> Iterator[pa.RecordBatch]:
    """Counts of scores by query and bin, from low in steps of width; above the BINS as the bin BINS."""
    qids, queries, low, width = sent
    held = np.zeros((len(qids), BINS + 1), np.int64)
    any_rows = False
    for ids, rows in matrices(batches, queries.shape[1]):
        any_rows = True
        for at in range(0, len(qids), BLOCK):
            part = slice(at, at + BLOCK)
            score, own = scores(ids, rows, qids[part], queries[part])
            # Differences of 64-bit numbers need one bit more.
            past = (score.view(np.uint64) - low[part, None].view(np.uint64)) // np.uint64(width)
            bins = np.minimum(past, np.uint64(BINS)).astype(np.int64)
            bins[own | (score < low[part, None])] = -1
            flat = bins + (np.arange(len(bins)) * (BINS + 2))[:, None] + 1
            counted = np.bincount(flat.ravel(), minlength=len(bins) * (BINS + 2)).reshape(len(bins), BINS + 2)
            held[part] += counted[:, 1:]
    if any_rows:
        above = held[:, ::-1].cumsum(axis=1)[:, ::-1] - held  # rows in higher bins
        q, b = np.nonzero((held > 0) & (above < k))
        yield batch(HIST, query=q, bin=b, n=held[q, b])


KEPT = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def survivors(batches: Iterator[pa.RecordBatch], sent: tuple, k: int) -> Iterator[pa.RecordBatch]:
    """Rows at or above each query's k-th value; at most the best k of a batch of rows."""
    qids, queries, least, base = sent
    for ids, rows in matrices(batches, queries.shape[1]):
        for at in range(0, len(qids), BLOCK):
            part = slice(at, at + BLOCK)
            score, own = scores(ids, rows, qids[part], queries[part])
            q, r = np.nonzero((score >= least[part, None]) & ~own)
            if len(q):
                value, name = score[q, r], ids[r]
                order = np.lexsort((name, -value, q))
                q, value, name = q[order], value[order], name[order]
                begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                place = np.arange(len(q)) - np.repeat(begin, np.diff([*begin, len(q)]))
                kept = place < k
                yield batch(KEPT, q=base + at + q[kept], query_id=qids[part][q[kept]], id=name[kept], score=value[kept])


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k rows of the highest integer inner product for each query, ties to the smaller id.

    rows and queries: id long, v array<double>, as `quantised` makes it. Returns query_id, rank (from 1), id, score.
    """
    spark = rows.sparkSession
    rows, queries = (x.where(F.col("id").isNotNull() & (F.size("v") > 0)).select("id", F.col("v").cast("array<double>").alias("v")) for x in (rows, queries))
    squares = rows.groupBy(F.size("v").alias("d")).agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square"))
    parts: list[DataFrame] = []
    for row in squares.orderBy("d").collect():
        same = F.size("v") == row["d"]
        for block in blocks(queries.where(same)):
            parts.append(searched(rows.where(same), block, row["square"], k, len(parts) * QUERIES))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    kept = parts[0]
    for p in parts[1:]:
        kept = kept.unionByName(p)
    return kept.selectExpr("query_id", "row_number() over (partition by q order by score desc, id) as rank", "id", "score").where(F.col("rank") <= k)


def blocks(queries: DataFrame) -> Iterator[list]:
    held = []
    for row in queries.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == QUERIES:
            yield held
            held = []
    if held:
        yield held


def searched(rows: DataFrame, block: list, square: float, k: int, base: int) -> DataFrame:
    """The rows that may be among the k best of a block of queries, numbered from base; a written table."""
    send = rows.sparkSession.sparkContext.broadcast
    qids = np.array([r[0] for r in block], np.int64)
    matrix = np.array([r[1] for r in block], np.float64)
    # No score is beyond the product of the norms.
    reach = norms(matrix).max() * np.sqrt(square) * (1 + 1e-9)
    bound = int(reach) + 1 if reach < 2.0**62 else MOST
    low, width = np.full(len(qids), max(-bound, LEAST), np.int64), -(-(2 * bound + 1) // BINS)
    while True:
        sent = send((qids, matrix, low, width))
        counts = rows.mapInArrow(lambda bs, s=sent: tidied(histograms(bs, s.value, k)), "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        # From the top down, the bin in which k is reached; the lowest one where there are fewer rows.
        down = counts.selectExpr("query", "bin", "sum(n) over (partition by query order by bin desc) as past")
        at = down.groupBy("query").agg(F.coalesce(F.max(F.when(F.col("past") >= k, F.col("bin"))), F.min("bin")).alias("bin")).toArrow()
        sent.destroy()
        bins = np.zeros(len(qids), np.int64)
        bins[at["query"].to_numpy()] = at["bin"].to_numpy()
        low = low + bins * width
        if width == 1:
            break
        width = -(-width // BINS)
    sent = send((qids, matrix, low, base))
    found = stored(rows.mapInArrow(lambda bs: tidied(survivors(bs, sent.value, k)), "q long, query_id long, id long, score long"), "top-k")
    sent.destroy()
    return found
