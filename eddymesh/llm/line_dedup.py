"""Line dedup by windows of lines; DataFrame operations only.

A line is what stands between two line feeds; lines without a word take no part, and are always kept. A window is a
run of lines with at least WORDS words that is the shortest from its first line on, or the shortest up to its last
line. Windows are compared whole, by 128 bits of their lines' hashes of 128 bits, with the first place of an equal window over all documents
(by doc_id, null last, then place in the input; then line). The lines of each other place are deleted.

No repeat is missed: in a run with that many words that stands at an earlier place too, each line is in a window from
one of its lines on or in the shortest window up to its end, and those stand at the earlier place as well. Each window
meets one first place, so n copies make n - 1 pairs, and a text of n equal lines about n windows of at most WORDS lines.
Every deleted line equals one at an earlier place, so the first of equal lines stays.

A null text stays null, an empty one empty. A document may end up with an empty text; rows are never dropped. Rows with
null or equal doc_ids are documents of their own. Other columns are kept as they are, whatever their names; empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymesh.llm.common import WORD, numbered, scratch, stored

WORDS = 50


def repeats(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """row and ranges ([first line, last line] of repeated runs, from 0) of rows(row, doc, text)."""
    with scratch() as kept:
        text = rows.select("row", "doc", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
        # Lines are told apart by 128 bits, of two hashes.
        hashes = F.struct(F.xxhash64("content").alias("a"), F.xxhash64(F.lit("line"), "content").alias("b"))
        counted = text.select("row", "doc", "line", F.regexp_count("content", F.lit(WORD)).alias("n"), hashes.alias("h")).where("n > 0")
        placed = counted.selectExpr("*", "sum(n) over (partition by row order by line) as past", "sum(n) over (partition by row order by line) - n as at", "sum(n) over (partition by row) as total")
        onward, back = f"(partition by row order by at range between current row and {words - 1} following)", f"(partition by row order by past range between {words - 1} preceding and current row)"
        framed = placed.selectExpr("*", f"collect_list(h) over {onward} as h1", f"max(line) over {onward} as last", f"collect_list(h) over {back} as h0", f"min(line) over {back} as first", f"min(at) over {back} as from")
        # A window up to a line that is also the shortest from its own first line on is among those already.
        both = F.array(
            F.when(F.col("total") - F.col("at") >= words, F.struct(F.col("line").alias("a"), F.col("last").alias("b"), F.col("h1").alias("h"))),
            F.when(F.col("at") - F.col("from") >= words, F.struct(F.col("first").alias("a"), F.col("line").alias("b"), F.col("h0").alias("h"))),
        )
        cut = framed.select("row", "doc", F.explode(F.filter(both, lambda w: w.isNotNull())).alias("w"))
        # A window's key: two hashes of all its lines' hashes.
        windows = stored(cut.select("row", "doc", F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.xxhash64("w.h").alias("key1"), F.xxhash64(F.lit("window"), "w.h").alias("key2")), "windows")
        keys = ["key1", "key2"]
        placed = windows.withColumn("place", F.struct(F.col("doc").isNull().alias("none"), "doc", "row", "a"))
        # Written, so that the join below is of two shuffled tables, whose crowded partitions Spark can split.
        first = stored(placed.groupBy(*keys).agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1").select(*keys, "first"), "first-windows")
        later = placed.join(first, keys).where("place <> first").select("row", "a", "b")
        # Windows that overlap become one range.
        joined = later.selectExpr("*", "coalesce(max(b) over (partition by row order by a, b rows between unbounded preceding and 1 preceding) < a, true) as begins")
        islands = joined.selectExpr("*", "sum(int(begins)) over (partition by row order by a, b rows between unbounded preceding and current row) as island")
        ranges = islands.groupBy("row", "island").agg(F.array(F.min("a"), F.max("b")).alias("range"))
        found = stored(ranges.groupBy("row").agg(F.collect_list("range").alias("ranges")), "ranges")
        kept.append(found)
    return found


def line_dedup(docs: DataFrame, words: int = WORDS, report: bool = False) -> DataFrame:
    """The rows of docs(doc_id, text, ...) with repeated runs of lines deleted from `text`.

    With report only doc_id, n_lines, removed (line numbers from 0, ascending) and text.
    """
    rows = numbered(docs, ["doc_id", "text"] if report else None)
    found = repeats(rows.select("row", F.col("of.doc_id").alias("doc"), F.col("of.text").alias("text")), words)
    joined = rows.join(found, "row", "left").withColumn("lines", F.split("of.text", "\n", -1))
    # A blank line inside a deleted run stays.
    indexed = F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    gone = lambda p: F.exists("ranges", lambda r: (p["i"] >= r[0]) & (p["i"] <= r[1])) & (F.regexp_count(p["x"], F.lit(WORD)) > 0)
    kept = F.when(F.col("ranges").isNull(), F.col("of.text")).otherwise(F.array_join(F.transform(F.filter(indexed, lambda p: ~gone(p)), lambda p: p["x"]), "\n"))
    if not report:
        return joined.select(*[kept.alias(c) if c == "text" else F.col(f"of.`{c}`").alias(c) for c in docs.columns])
    removed = F.when(F.col("ranges").isNull(), F.array().cast("array<int>")).otherwise(F.transform(F.filter(indexed, gone), lambda p: p["i"]))
    return joined.select(F.col("of.doc_id").alias("doc_id"), F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), removed.alias("removed"), kept.alias("text"))
