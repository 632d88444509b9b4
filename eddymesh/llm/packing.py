"""Best-fit packing of documents into sequences of a fixed number of tokens.

Only the histogram of piece lengths reaches the driver: at most `capacity` numbers, whatever the input's size. There
the configuration linear program (a configuration: a multiset of lengths that fits one sequence; as few sequences as
possible that cover the histogram) is solved by multiplicative weights. Each round prices the lengths by how little
they are covered yet, finds the best configuration at these prices by bounded-knapsack dynamic programming, and uses it
until its tightest length is covered; so each round covers a length at least, and rounds go on until all lengths are
covered. Uses become whole sequences, never more than the histogram has; what is left is packed best-fit, longest
first. That is done for the uses of all rounds, of seven eighths of them, and so on; with all configurations and with
those that waste little; and at other first prices, if the plan isn't within a thousandth of the bound that the program's
dual gives: the fewest sequences are kept. The plan has, for each length and configuration, a
range of ranks; pieces get a rank within their length from counts per task, and so their sequence and offset, without a
shuffle of texts or ids.

A null or empty text is one piece that holds just the end id. Only documents longer than the capacity are cut, into
pieces of the capacity; the last may be shorter. Repeated rows are packed each for itself. An empty table gives no
rows. Other columns are left alone.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymesh.llm.common import batch, column, stored, tidied
from eddymesh.llm.tokens import CHUNK_BYTES, KEPT_UNITS, encoder

CAPACITY = 2048
#: Lengths that a round prices at most, but for the longest open one.
ACTIVE = 200
#: After how many parts of the rounds the plan is rounded; the one of fewest sequences is kept.
CUTS = 8
#: Which share of a sequence a configuration may leave empty to be used as it is; tried in turn.
WASTES = (1.0, 1 / 512, 1 / 64)
#: Other prices are tried until the plan has at most this share of sequences more than the bound.
CLOSE = 0.001
RATE = 4.0


def knapsack(lengths: np.ndarray, prices: np.ndarray, limits: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length is in the best configuration at these prices, none above its limit (bounded knapsack:
    copies in powers of two are items of their own)."""
    items: list[tuple[int, int]] = []
    for k in np.argsort(-lengths, kind="stable").tolist():
        left, copies = min(int(limits[k]), capacity // int(lengths[k])), 1
        while left > 0:
            items.append((k, min(copies, left)))
            left, copies = left - copies, copies * 2
    best, taken = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
    for row, (k, copies) in enumerate(items):
        size = int(lengths[k]) * copies
        value = best[: capacity + 1 - size] + prices[k] * copies
        better = value > best[size:]
        taken[row, size:] = better
        best[size:] = np.where(better, value, best[size:])
    counts, room = np.zeros(len(lengths), np.int64), capacity
    for row in range(len(items) - 1, -1, -1):
        if taken[row, room]:
            k, copies = items[row]
            counts[k] += copies
            room -= int(lengths[k]) * copies
    return counts


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Best-fit decreasing on counts: (sequences, counts of each length), alike sequences together.

    Works on how many open sequences have each room, so its steps follow the number of lengths, not of pieces.
    """
    open_: dict[int, list[list]] = {}  # room -> [number, {length: count}]
    for k in range(len(lengths) - 1, -1, -1):
        size, need = int(lengths[k]), int(left[k])
        while need:
            fits = [r for r in open_ if r >= size]
            if fits:
                room = min(fits)
                group = open_[room][-1]
                each = min(room // size, -(-need // group[0]))
                number = min(group[0], need // each)
                if not number:
                    each, number = need, 1
                if number == group[0]:
                    open_[room].pop()
                    if not open_[room]:
                        del open_[room]
                else:
                    group[0] -= number
                held = dict(group[1])
            else:
                room, held = capacity, {}
                each = min(capacity // size, need)
                number = need // each
            held[k] = held.get(k, 0) + each
            open_.setdefault(room - size * each, []).append([number, held])
            need -= each * number
    done = []
    for groups in open_.values():
        for number, held in groups:
            counts = np.zeros(len(lengths), np.int64)
            counts[list(held)] = list(held.values())
            done.append((number, counts))
    return done


def dual_prices(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """Prices under which no configuration is worth more than 1, so that no packing has fewer sequences than the
    demand is worth: lengths priced by how many of them fit (rounded down to k-ths), or as a share of the capacity where
    the shortest are free and those that leave too little for the others cost 1. The best of these."""
    found = [lengths / capacity]
    for k in range(1, 64):
        steps = (k + 1) * lengths
        found.append(np.where(steps % capacity == 0, lengths / capacity, steps // capacity / k))
    for least in np.unique(lengths[lengths <= capacity // 2]).tolist():
        found.append(np.where(lengths > capacity - least, 1.0, np.where(lengths >= least, lengths / capacity, 0.0)))
    return max(found, key=lambda p: float((p * demand).sum()))


def starts(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[np.ndarray]:
    """What lengths are worth at first. A perfect fill is worth its tokens; long lengths a little more, as they fit fewer
    places. Or the dual's prices, and what they leave open is decided by the tokens."""
    prices = dual_prices(lengths, demand, capacity)
    return [lengths * (1 + 0.05 * lengths / capacity), *(prices * capacity * (1 + lean * lengths / capacity) + 0.05 * lengths for lean in (0.05, 1.0))]


def covering(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, rate: float = RATE, start: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[bytes, float]], float]:
    """How often each length's demand is covered, each round's configuration (its counts as bytes) and use, and a bound
    that no packing goes below."""
    covered, found = np.zeros(len(lengths)), []
    bound = 0.0
    worth = starts(lengths, demand, capacity)[0] if start is None else start
    for turn in range(len(lengths)):
        # Multiplicative weights: a length's price falls by a factor for each share of its demand that is covered.
        open_ = np.flatnonzero(covered < 1)
        if not len(open_):
            break
        # Every n-th open length, others in each round, and always the longest.
        step = -(-len(open_) // ACTIVE)
        active = open_[(len(open_) - 1 - turn % step) % step :: step]
        active = active if active[-1] == open_[-1] else np.append(active, open_[-1])
        prices = worth[active] * np.exp(-rate * covered[active])
        own = np.zeros(len(lengths), np.int64)
        own[active] = knapsack(lengths[active], prices, demand[active], capacity)
        # At prices divided by the best configuration's no configuration is worth more than 1.
        bound = max(bound, float((prices * demand[active]).sum() / (prices * own[active]).sum()))
        # The configuration's use: until its tightest length is covered once.
        share = own / demand
        step = 1.0 / share.max()
        found.append((own.tobytes(), step))
        covered += step * share
        covered[share == share.max()] = np.maximum(covered[share == share.max()], 1.0)  # whatever rounding does
    return covered, found, bound


def rounded(lengths: np.ndarray, demand: np.ndarray, found: list[tuple[bytes, float]], capacity: int, waste: int) -> list[tuple[int, np.ndarray]]:
    """Whole uses of the configurations that leave at most `waste` places, cut so that no length is used more often
    than it occurs; the rest is packed best-fit."""
    uses: dict[bytes, float] = {}
    for key, use in found:
        uses[key] = uses.get(key, 0.0) + use
    left, plan = demand.copy(), []
    for key, use in sorted(uses.items(), key=lambda x: (-x[1], x[0])):
        counts = np.frombuffer(key, np.int64)
        held = counts > 0
        number = int(min(np.ceil(use - 1e-9), (left[held] // counts[held]).min()))
        if number and capacity - int((counts * lengths).sum()) <= waste:
            plan.append((number, counts))
            left = left - number * counts
    return plan + best_fit(lengths, left, capacity)


def planned(histogram: dict[int, int], capacity: int = CAPACITY, rate: float = RATE) -> tuple[list[tuple[int, dict[int, int]]], int]:
    """Configurations as (sequences, {length: pieces in each}); together they hold the histogram exactly. And the
    fewest sequences that the program's dual allows for."""
    if not histogram:
        return [], 0
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    bound, plan = float((dual_prices(lengths, demand, capacity) * demand).sum()), None
    for start in starts(lengths, demand, capacity):
        covered, found, of_round = covering(lengths, demand, capacity, rate, start)
        assert (covered >= 1).all(), "a length isn't covered"
        bound = max(bound, of_round)
        least = int(np.ceil(bound - 1e-6))
        # The last rounds have few lengths to choose from; best fit may do better there, or with all that fits loosely,
        # so several cuts are tried.
        cuts = sorted({-(-len(found) * k // CUTS) for k in range(1, CUTS + 1)}, reverse=True)
        for waste, cut in itertools.product(WASTES, cuts):
            made = rounded(lengths, demand, found[:cut], capacity, int(waste * capacity))
            if plan is None or sum(n for n, _ in made) < sum(n for n, _ in plan):
                plan = made
            if sum(n for n, _ in plan) <= least:
                break
        if sum(n for n, _ in plan) <= least * (1 + CLOSE):
            break
    return [(number, {int(lengths[k]): int(counts[k]) for k in np.flatnonzero(counts)}) for number, counts in plan], least


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rate: float = RATE) -> list[tuple[int, dict[int, int]]]:
    return planned(histogram, capacity, rate)[0]


PIECES = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("local_rank", pa.int64())])
PIECES_DDL = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, local_rank long"


def pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, kept: int, chunk: int) -> Iterator[pa.RecordBatch]:
    encode, part, seen = encoder(path, kept, chunk).encode, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    end = np.array([end_id], "<u4").tobytes()
    for b in batches:
        names, at = column(b, "doc_id").to_pylist(), 0
        for ids, counts in encode(column(b, "text")):
            data, stop, rows = ids.astype("<u4").tobytes(), 0, []
            for k, n in enumerate(counts.tolist()):
                own, stop = data[4 * stop : 4 * (stop + n)] + end, stop + n
                for piece, first in enumerate(range(0, n + 1, capacity)):
                    length = min(capacity, n + 1 - first)
                    rows.append((names[at + k], piece, first, length, zlib.crc32(own[4 * first : 4 * (first + length)]), int(seen[length])))
                    seen[length] += 1
            at += len(counts)
            cols = list(zip(*rows))
            yield batch(PIECES, part=[part] * len(rows), **dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "local_rank"), cols)))


def placed(batches: Iterator[pa.RecordBatch], plan: dict[int, tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lengths, ranks = column(b, "length").to_numpy(), column(b, "rank").to_numpy()
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for n in np.unique(lengths).tolist():
            own = lengths == n
            past, first, each, place = plan[n]
            k = np.searchsorted(past, ranks[own], side="right")
            within = ranks[own] - np.where(k > 0, past[k - 1], 0)
            sequence[own], offset[own] = first[k] + within // each[k], place[k] + within % each[k] * n
        yield batch(schema, **{c: column(b, c) for c in schema.names[:-2]}, sequence_id=sequence, offset=offset)


def plan_of(configurations: list[tuple[int, dict[int, int]]]) -> dict[int, tuple]:
    """For each length: past ranks, first sequence, pieces in each sequence and place there, by configuration."""
    plan: dict[int, list] = {}
    first = 0
    for number, counts in configurations:
        place = 0
        for n in sorted(counts, reverse=True):
            plan.setdefault(n, []).append((number * counts[n], first, counts[n], place))
            place += n * counts[n]
        first += number
    return {n: (np.cumsum([r[0] for r in rows]), *(np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))) for n, rows in plan.items()}


def pack_lengths(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows with part, length and local_rank (the place among its part's rows of that length), and sequence_id and
    offset for each. The rows must be a written table, as they are read three times."""
    spark = rows.sparkSession
    counts = stored(rows.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_of(solve(histogram, capacity)))
    # A length's rows here are one for each part, so the window's groups are as long as there are parts.
    before = counts.selectExpr("part", "length", "sum(n) over (partition by length order by part rows between unbounded preceding and current row) - n as before")
    ranked = rows.join(before, ["part", "length"]).withColumn("rank", F.col("local_rank") + F.col("before"))
    kept = [c for c in rows.columns if c not in ("part", "local_rank")]
    out = ranked.select(*kept, "rank")
    types = {f.name: f for f in PIECES}
    schema = pa.schema([types[c] for c in kept] + [("sequence_id", pa.int64()), ("offset", pa.int64())])
    ddl = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in kept).replace("bigint", "long") + ", sequence_id long, offset long"
    return out.mapInArrow(lambda bs: tidied(placed(bs, plan.value, schema)), ddl)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, kept: int = KEPT_UNITS, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Pieces of documents(doc_id, text) with their sequence and offset; ids are read by `path`, the end id follows;
    a worker keeps the ids of about `kept` words, and splits `chunk` bytes of text at a time."""
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda bs: tidied(pieces(bs, path, capacity, end_id, kept, chunk), True), PIECES_DDL)
    return pack_lengths(stored(made, "pieces"), capacity)
