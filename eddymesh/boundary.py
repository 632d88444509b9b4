"""Non-periodic z: which method a point near the ground or the sky gets, and the linear methods there.

Bands are in units of dz for a lattice of n planes. The Laplacian adds a first z derivative to second x and y ones, and
the gradient of w below 1.5 dz divides w two planes up by two spacings: both as in the queries this engine follows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddymesh.getdata import contracted, evaluate, fraction, index, polynomials, summed
from eddymesh.lattice import CHUNK, into_chunks
from eddymesh.weights import CORNERS, difference, field

# Methods to fall back on, in order.
STEPS = {
    "lag8": ["lag6", "lag4", "linear"], "lag6": ["lag4", "linear"], "lag4": ["linear"], "m2q8": ["m1q4", "linear"], "m1q4": ["linear"],
    "m2q8_g": ["m1q4_g", "linear_g"], "m1q4_g": ["linear_g"], "m2q8_h": ["fd6noint_h", "fd4noint_h", "linear_h"],
    "fd8noint_g": ["fd6noint_g", "fd4noint_g", "linear_g"], "fd8noint_l": ["fd6noint_l", "fd4noint_l", "linear_l"], "fd8noint_h": ["fd6noint_h", "fd4noint_h", "linear_h"],
    **{f"fd6noint_{o}": [f"fd4noint_{o}", f"linear_{o}"] for o in "ghl"}, **{f"fd4noint_{o}": [f"linear_{o}"] for o in "ghl"},
    "fd4lag4_g": ["m1q4_g", "linear_g"], "fd4lag4_l": ["fd6noint_l", "fd4noint_l", "linear_l"],
}
# Lowest z of a method for velocity and energy, and how far below n its end is for velocity.
LOWEST = {"lag8": 4.0, "m2q8": 4.0, "fd4lag4": 4.0, "lag6": 3.0, "lag4": 2.0, "m1q4": 2.0, "fd8noint": 4.5, "fd6noint": 3.5, "fd4noint": 2.5}
BELOW = {"lag8": 3.5, "m2q8": 3.5, "fd4lag4": 3.5, "lag6": 2.5, "lag4": 1.5, "m1q4": 1.5, "fd8noint": 5.0, "fd6noint": 4.0, "fd4noint": 3.0}


def band(method: str, variable: str, n: int) -> tuple[float, float]:
    name = method.rsplit("_", 1)[0]
    if name == "linear":
        return 0.0, n + 1.0
    low = LOWEST[name] - (0.5 if variable in ("temperature", "pressure") else 0.0)
    return low, n - BELOW[name] + (0.5 if variable == "energy" else 0.0)


def routed(z: Column, method: str, variable: str, n: int) -> Column:
    """The method of a point: the first in order whose band holds it."""
    out = None
    for m in [method, *STEPS[method]]:
        low, high = band(m, variable, n)
        hit = (z >= low) & (z < high)
        out = F.when(hit, F.lit(m)) if out is None else out.when(hit, F.lit(m))
    return out


def z_offset(kind: str) -> float:
    """uv: planes at (k + 1/2) dz (also pressure and temperature); w and energy: at (k + 1) dz."""
    return -0.5 if kind == "uv" else -1.0


def linear_field(points: DataFrame, nodes: DataFrame | None, kind: str, method: str, n: int, components: int = 1, chunks: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """pid, the columns to keep and c0_0, c1_0, ...: the method's own kernel in x and y, linear in z; w is 0 on the
    ground, energy constant below dz. nodes or chunks as for `evaluate`."""
    off, ground = z_offset(kind), F.col("z") < 1.0
    fz = fraction(F.col("z"), 1.0, off, False)
    low, high = 1 - fz, fz
    if kind != "uv":
        # Below the first plane (the next one up): all of it for energy, the share above the ground for w.
        low, high = F.when(ground, F.lit(0.0)).otherwise(low), F.when(ground, fz if kind == "w" else F.lit(1.0)).otherwise(high)
    placed = points.select("pid", *keep, index(F.col("x"), 1.0, 0.0, n, False).alias("ix"), index(F.col("y"), 1.0, 0.0, n, False).alias("iy"), index(F.col("z"), 1.0, off, n, False).alias("iz"), fraction(F.col("x"), 1.0, 0.0, True).alias("fx"), fraction(F.col("y"), 1.0, 0.0, True).alias("fy"), low.alias("low"), high.alias("high"))
    kernel = field(method)
    width = sorted(kernel)
    weights = {a: polynomials(f"f{a}", {"w": kernel}, width) for a in "xy"} | {"z": lambda part: {"w": np.stack([part["low"].to_numpy(), part["high"].to_numpy()], axis=1)}}
    reach = {"x": (width[0], width[-1]), "y": (width[0], width[-1]), "z": (0, 1)}
    return contracted(placed, into_chunks(nodes, components) if chunks is None else chunks, weights, [["www"]], [[1.0]], reach, components, ["fx", "fy", "low", "high"], keep, n, CHUNK)


def planes(kind: str, hessian: bool, n: int) -> tuple[Column, Column, Column, Column]:
    """How far the base plane moves, and the planes (bottom, middle, top) from it, or the divisor for the middle one.
    A bottom of -1 is the ground, where the value is 0."""
    z = F.col("z")

    def cases(*rows):
        out = None
        for when, value in rows:
            out = F.when(when, F.lit(value)) if out is None else out.when(when, F.lit(value))
        return out

    if kind == "uv":
        low, sky = z < 1.0, z >= n - 1.0
        mid = ~low & ~sky
        if hessian:
            return cases((low, 0), (mid, -1), (sky, -2)), F.lit(0), F.lit(1), F.lit(2)
        return cases((low, 0), (mid, -1), (sky, -2)), cases((low, 0), (mid, 0), (sky, 1)), cases((low, 1), (mid, 2), (sky, 1)), cases((low, 1), (mid, 2), (sky, 2))
    low, sky = z < 1.5, z == n - 0.5
    mid = ~low & ~sky
    ground = -1 if kind == "w" else 0
    shift = cases((low, 0), (mid, -1), (sky, -2))
    if hessian:
        return shift, cases((low, ground), (mid, 0), (sky, 0)), cases((low, 0), (mid, 1), (sky, 1)), cases((low, 1), (mid, 2), (sky, 2))
    top = 2 if kind == "w" else 1
    return shift, cases((low, ground), (mid, 0), (sky, 1)), cases((low, 2), (mid, 2), (sky, 1)), cases((low, top), (mid, 2), (sky, 2))


def linear_differences(points: DataFrame, nodes: DataFrame, kind: str, order: int, operator: str, n: int) -> DataFrame:
    """pid and c0_0, c0_1, ...: gradient, laplacian or hessian near the ground and the sky."""
    shift, bottom, middle, top = planes(kind, operator == "hessian", n)
    placed = points.select("pid", index(F.col("x"), 1.0, 0.0, n, True).alias("ix"), index(F.col("y"), 1.0, 0.0, n, True).alias("iy"), F.pmod(index(F.col("z"), 1.0, z_offset(kind), n, True) + shift, F.lit(n)).cast("long").alias("iz"), bottom.alias("zb"), middle.alias("zm"), top.alias("zt"))
    zb, zm, zt, ground = F.col("zb"), F.col("zm"), F.col("zt"), F.col("zb") < 0
    count = {"gradient": 3, "laplacian": 1, "hessian": 6}[operator]

    def tap(x, y, z, **w):
        return F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), (z if isinstance(z, Column) else F.lit(z)).cast("int").alias("z"), *[(v if isinstance(v := w.get(f"w{j}", 0.0), Column) else F.lit(float(v))).alias(f"w{j}") for j in range(count)])

    above = lambda v: F.when(ground, F.lit(0.0)).otherwise(v)
    low = F.greatest(zb, F.lit(0))
    if operator == "hessian":
        all_ = [tap(k, 0, 0, w0=c[0]) for k, c in difference(2, order).items()] + [tap(0, k, 0, w3=c[0]) for k, c in difference(2, order).items()]
        for k, w in zip(range(len(CORNERS[order]), 0, -1), CORNERS[order]):
            all_ += [tap(i, j, 0, w1=w if i * j > 0 else -w) for i in (k, -k) for j in (k, -k)]
        all_ += [tap(0, 0, zt, w5=1.0), tap(0, 0, zm, w5=-2.0), tap(0, 0, low, w5=above(F.lit(1.0)))]
        for sign in (1, -1):
            all_ += [tap(sign, 0, zt, w2=sign / 4), tap(sign, 0, low, w2=above(F.lit(-sign / 4))), tap(0, sign, zt, w4=sign / 4), tap(0, sign, low, w4=above(F.lit(-sign / 4)))]
    else:
        second = operator == "laplacian"
        kernel = difference(2 if second else 1, order)
        all_ = [tap(k, 0, 0, w0=c[0]) for k, c in kernel.items()] + [tap(0, k, 0, **{"w0" if second else "w1": c[0]}) for k, c in kernel.items()]
        z = "w0" if second else "w2"
        all_ += [tap(0, 0, zt, **{z: F.lit(1.0) / zm}), tap(0, 0, low, **{z: above(F.lit(-1.0) / zm)})]
    out = placed.withColumn("k", F.explode(F.array(*all_)))
    return summed(out.select("pid", *[(F.col(f"i{a}") + F.col(f"k.{a}")).alias(f"i{a}") for a in "xyz"], *[f"k.w{j}" for j in range(count)]), nodes, count, 1, n)


def velocity(points: DataFrame, uv: DataFrame, w: DataFrame, method: str) -> DataFrame:
    """pid, ux, uy, uz with u and v on half planes and w on whole ones, both by chunk: two offsets, one result. What the
    first finds goes along with its point to the second, so nothing is joined by pid; the second's chunks count their
    points without it, so that the first is evaluated once."""
    flat = evaluate(points.select("pid", "x", "y", "z"), None, method, "field", 2, offset=(0.0, 0.0, -0.5), chunks=uv, keep=("x", "y", "z"))
    both = flat.select("pid", "x", "y", "z", F.col("c0_0").alias("ux"), F.col("c1_0").alias("uy"))
    return evaluate(both, None, method, "field", 1, offset=(0.0, 0.0, -1.0), chunks=w, keep=("ux", "uy"), counted=points).select("pid", "ux", "uy", F.col("c0_0").alias("uz"))
