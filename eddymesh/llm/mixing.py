"""Mixing sources to target weights along a time-varying curriculum.

Each source has a schedule: how much it weighs at each training time from 0 to 1, linear between breakpoints. Its
integral over the training is the source's weight. Targets share a total by these weights and stop at `most` times a
source's size; what is over goes to the other sources by weight (water filling, in closed form over the sources
ordered by the level at which they are full). Documents of a source come in the order of a hash of doc_id, whole
passes first; of the last pass those whose middle lies within the rest of the target. A copy's place among its source's
taken words is a cumulated demand; the inverse of the integrated schedule turns it into a training time, by which the
documents are sorted over all partitions.

Running sums within a source are taken in two steps, over the partitions of a range sort by source, hash, doc_id, size,
text and row, and within them: no task gets a whole source, nor all rows of one doc_id. Everything is DataFrame
operations; texts take no part but in the last join and sort.

A null source is a source of its own, last in order. Null and empty texts have size 0: they are never taken for their
words, and count as taken 0 times. Rows with the same doc_id are separate rows. Ties of the hash go by doc_id,
size, a hash of the text and place in the input. An empty table gives an empty result. The few windows over the sources
themselves, a row each, are one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddymesh.llm.common import n_words, numbered, scratch, stored

#: (time, weight) breakpoints of the default schedules, for the sources in turn: rising to 5, falling to 2, level at 1.
SCHEDULES = [[(0.0, 2.5), (1.0, 7.5)], [(0.0, 3.0), (1.0, 1.0)], [(0.0, 1.0), (1.0, 1.0)]]
SHARE, MOST = 1.5, 2
#: Up to so many sources are broadcast.
BROADCAST_SOURCES = 10_000


def integral(schedule: list[tuple[float, float]]) -> float:
    return sum((b - a) * (v + w) / 2 for (a, v), (b, w) in zip(schedule, schedule[1:]))


def time_of(schedule: list[tuple[float, float]], share: Column) -> Column:
    """The time at which so much of the schedule's integral has passed: the inverse of a piecewise quadratic."""
    whole, done, found = integral(schedule), 0.0, None
    for (a, v), (b, w) in zip(schedule, schedule[1:]):
        slope, part = (w - v) / (b - a), (b - a) * (v + w) / 2
        rest = share * F.lit(whole) - F.lit(done)
        at = F.lit(a) + (rest / F.lit(v) if slope == 0 else (F.sqrt(F.lit(v * v) + F.lit(2 * slope) * rest) - F.lit(v)) / F.lit(slope))
        found = at if found is None else F.when(share * F.lit(whole) < F.lit(done), found).otherwise(at)
        done += part
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), found))


def targets(sized: DataFrame, schedules=SCHEDULES, share: float = SHARE, most: int = MOST) -> DataFrame:
    """A row for each source: no_source, source_name (the join's keys), kind (its schedule), source_size, target."""
    sums = sized.groupBy("no_source", "source_name").agg(F.sum("size").alias("source_size"))
    turns = F.array(*[F.lit(float(integral(s))) for s in schedules])
    # Windows over the sources only: a row each.
    ranked = sums.selectExpr("*", f"cast((row_number() over (order by no_source, source_name) - 1) % {len(schedules)} as int) as kind")
    weighed = ranked.withColumn("weight", turns[F.col("kind")]).withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap") / F.col("weight"))
    order = "order by level, no_source, source_name rows between"
    filled = weighed.selectExpr(
        "*",
        f"({share} * sum(source_size) over () - coalesce(sum(cap) over ({order} unbounded preceding and 1 preceding), 0)) / sum(weight) over ({order} current row and unbounded following) as at_level",
    )
    # The first source that isn't full at the level which the ones before leave sets the level for all after it.
    final = filled.selectExpr("*", "min(case when level >= at_level then struct(level, no_source, source_name, at_level) end) over () as first_open")
    return final.select("no_source", "source_name", "kind", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("first_open.at_level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def placed(rows: DataFrame, schedules, share: float, most: int) -> DataFrame:
    """row, size, source_size, target, passes, taken and positions of numbered rows(row, of)."""
    with scratch() as kept:
        size, key = n_words(F.col("of.text")), F.md5(F.coalesce(F.col("of.doc_id").cast("string"), F.lit("")))
        source = [F.col("of.source").isNull().alias("no_source"), F.coalesce("of.source", F.lit("")).alias("source_name")]
        # From here on rows are narrow; texts come back at the end.
        sized = stored(rows.select("row", F.col("of.doc_id").alias("doc_id"), size.alias("size"), *source, key.alias("mix_key"), F.xxhash64("of.text").alias("mix_tie")), "sizes")
        keys, order = ["no_source", "source_name"], ["mix_key", "doc_id", "size", "mix_tie", "row"]
        goals = stored(targets(sized, schedules, share, most), "targets")
        # Written with their partition, whose sums come first.
        ordered = stored(sized.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()), "ordered")
        sums = stored(ordered.groupBy(*keys, "part").agg(F.sum("size").alias("part_size")), "part-sums")
        before = sums.selectExpr(*keys, "part", "sum(part_size) over (partition by no_source, source_name order by part) - part_size as part_before")
        within = ordered.selectExpr("*", f"sum(size) over (partition by part, no_source, source_name order by {', '.join(order)} rows between unbounded preceding and current row) as upto")
        # Few sources go to every task, so that rows stay where they are; more of them meet their rows by shuffle.
        summed = within.join(before, [*keys, "part"]).join(F.broadcast(goals) if goals.count() <= BROADCAST_SOURCES else goals, keys).withColumn("middle", F.expr("part_before + upto - size / 2"))
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
        passes = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("mix_whole") + (F.col("middle") <= F.col("target") - F.col("mix_whole") * F.col("source_size")).cast("int"))
        taken = summed.withColumn("mix_whole", whole).withColumn("passes", passes.cast("int"))

        def position(copy: int) -> Column:
            at = F.least(F.lit(1.0), (F.col("middle") + copy * F.col("source_size")) / F.col("target"))
            found = time_of(schedules[0], at)
            for kind, schedule in enumerate(schedules[1:], 1):
                found = F.when(F.col("kind") == kind, time_of(schedule, at)).otherwise(found)
            return F.when(F.col("passes") > copy, found)

        out = taken.withColumn("taken", (F.col("passes") * F.col("size")).cast("long")).withColumn("positions", F.array_compact(F.array(*[position(c) for c in range(most)])))
        kept.append(found := stored(out.select("row", "size", "source_size", "target", "passes", "taken", "positions"), "placed"))
    return found


def mixture(docs: DataFrame, schedules=SCHEDULES, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of docs(doc_id, text, source, ...) with size, source_size, target, passes (whole copies taken), taken
    (words) and positions (training time of each copy), sorted by the first position over all partitions, untaken
    last. These columns replace any of the same name."""
    made = ["size", "source_size", "target", "passes", "taken", "positions"]
    rows = numbered(docs)
    out = rows.join(placed(rows, schedules, share, most), "row")
    order = [F.asc_nulls_last(F.get("positions", F.lit(0))), F.asc("of.doc_id"), F.asc("row")]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"of.`{c}`") for c in docs.columns if c not in made], *made)


def mixed(docs: DataFrame, schedules=SCHEDULES, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The documents as the training takes them: the columns of docs, a row for each copy, sorted by training time."""
    rows = numbered(docs)
    copies = placed(rows, schedules, share, most).select("row", F.explode("positions").alias("mix_at")).join(rows, "row")
    return copies.repartitionByRange("mix_at", "row").sortWithinPartitions("mix_at", "row").select("of.*")
