"""Cutouts: boxes of voxels with strides, periodic replication, axis coordinates; and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymesh.lattice import N


def axis_indices(spark, name: str, lo: int, hi: int, stride: int, n: int = N) -> DataFrame:
    """Requested 0-based indices lo..hi by stride, with the stored index each one repeats."""
    return spark.range(lo, hi + 1, stride).select(F.col("id").alias(f"r{name}"), F.pmod("id", F.lit(n)).cast("long").alias(f"i{name}"))


def box(voxels: DataFrame, ranges: list[tuple[int, int]], strides: tuple[int, int, int] = (1, 1, 1), n: int = N) -> DataFrame:
    """Voxels of 0-based inclusive ranges along x, y, z.

    Inside the lattice it is a filter, strides included, which goes down to the scan; a range that leaves the lattice
    joins the requested indices with the stored ones, so each voxel is read once however often it is repeated.
    """
    out = voxels
    for a, (lo, hi), stride in zip("xyz", ranges, strides):
        if 0 <= lo and hi < n:
            out = out.where(F.col(f"i{a}").between(lo, hi) & ((F.col(f"i{a}") - lo) % stride == 0)).withColumn(f"r{a}", F.col(f"i{a}"))
        else:
            # An axis has as many indices as the request is long; its size is known here.
            wanted = axis_indices(voxels.sparkSession, a, lo, hi, stride, n)
            out = out.join(F.broadcast(wanted) if (hi - lo) // stride < 100_000 else wanted, f"i{a}")
    return out


def file_boxes(spark, ranges: list[tuple[int, int]], edge: int, n: int = N) -> DataFrame:
    """The box split along file boundaries and periodic images: fx, fy, fz (file), and lo/hi within the lattice."""
    out = None
    for a, (lo, hi) in zip("xyz", ranges):
        part = spark.range(lo // edge, hi // edge + 1).select(
            F.pmod("id", F.lit(n // edge)).cast("long").alias(f"f{a}"), F.greatest(F.col("id") * edge, F.lit(lo)).cast("long").alias(f"lo_{a}"), F.least((F.col("id") + 1) * edge - 1, F.lit(hi)).cast("long").alias(f"hi_{a}")
        )
        out = part if out is None else out.join(part, how="cross")  # files of one request along each axis: a few rows
    return out


def complete(found: DataFrame, expected: int, columns: list[str]) -> DataFrame:
    """expected, found, nulls and whether nothing is missing."""
    nulls = F.coalesce(F.sum(F.greatest(*[F.col(c).isNull().cast("long") for c in columns], F.lit(0))), F.lit(0))
    return found.agg(F.lit(expected).cast("long").alias("expected"), F.count("*").alias("found"), nulls.cast("long").alias("nulls")).withColumn("complete", (F.col("expected") == F.col("found")) & (F.col("nulls") == 0))


def assert_complete(found: DataFrame, expected: int, columns: list[str]) -> DataFrame:
    row = complete(found, expected, columns).first()
    if not row["complete"]:
        raise ValueError(f"{row['found']} of {row['expected']} rows, {row['nulls']} with nulls")
    return found
