"""Time: indices of stored snapshots, cubic interpolation between them, series of times, particle tracks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddymesh.getdata import evaluate
from eddymesh.lattice import into_chunks
from eddymesh.weights import spline


def time_index(t: Column, dt: float, shift: int, interpolate: bool) -> Column:
    """Position of a time among the snapshots; the nearest one without interpolation."""
    at = t / F.lit(dt) + F.lit(shift)
    return at if interpolate else F.floor(at + 0.5).cast("long")


def series(t: float, end: float, step: float) -> list[float]:
    """t, t + step, ... below end, and end itself if the next step would meet it."""
    times = [t + k * step for k in range(max(0, math.ceil((end - t) / step)))]
    if times and math.isclose(times[-1] + step, end, rel_tol=1e-9):
        times.append(end)
    return times


def pchip_weights(theta: Column) -> dict[int, Column]:
    """Weights of the snapshots -1, 0, 1, 2 around a time: slopes are means of the two secants next to a snapshot."""
    out = {}
    for k, c in spline(1, 4).items():
        w = F.lit(float(c[-1]))
        for a in reversed(c[:-1]):
            w = w * theta + F.lit(float(a))
        out[k] = w
    return out


def pchip_shares(theta: float) -> dict[int, float]:
    """The same weights for a known time."""
    return {k: sum(float(v) * theta**p for p, v in enumerate(c)) for k, c in spline(1, 4).items()}


def weighted(values: list[Column], weights: list) -> Column:
    """A weighted sum without what is null; null if all are."""
    parts = [F.coalesce(v * w, F.lit(0.0)) for v, w in zip(values, weights)]
    return F.when(F.coalesce(*values).isNotNull(), sum(parts[1:], parts[0]))


def in_time(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """pid, tau, value of stored(chunk_code, t, vals) at wanted(pid, chunk_code, pos, tau): pos in the chunk, tau in
    snapshots. Each chunk's four snapshots around an interval are brought together first, so a point is one row."""
    weights = pchip_weights(F.col("tau") - F.floor("tau"))
    around = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("t") - k).cast("long").alias("below")) for k in weights])
    windows = stored.select("chunk_code", "vals", F.inline(around)).groupBy("chunk_code", "below").agg(*[F.max(F.when(F.col("k") == k, F.col("vals"))).alias(f"v{j}") for j, k in enumerate(weights)])
    rows = wanted.withColumn("below", F.floor("tau").cast("long")).join(windows, ["chunk_code", "below"])
    found = [F.get(f"v{j}", F.col("pos").cast("int")).cast("double") for j in range(len(weights))]
    return rows.select("pid", "tau", weighted(found, list(weights.values())).alias("value"))


def track(points: DataFrame, velocity: DataFrame | None, method: str, step: float, steps: int, chunks: DataFrame | None = None) -> DataFrame:
    """Positions after so many midpoint steps in a velocity field, by node or by chunk: pid, x, y, z. Each step is
    written, so lost executors repeat one step only."""
    spark = points.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"{tempfile.gettempdir()}/eddymesh-checkpoints")

    chunks = into_chunks(velocity, 3) if chunks is None else chunks

    def moved(at: DataFrame, h: float) -> DataFrame:
        """From bx, by, bz, with the velocity at x, y, z."""
        u = evaluate(at, None, method, "field", 3, quantize=False, chunks=chunks, keep=("bx", "by", "bz"))
        return u.select("pid", *[f"b{a}" for a in "xyz"], *[(F.col(f"b{a}") + F.lit(h) * F.col(f"c{k}_0")).alias(a) for k, a in enumerate("xyz")])

    now = points.select("pid", "x", "y", "z")
    for _ in range(steps):
        base = now.select("*", *[F.col(a).alias(f"b{a}") for a in "xyz"])
        now = moved(moved(base, step / 2), step).select("pid", "x", "y", "z").checkpoint()
    return now
