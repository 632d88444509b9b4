"""Whole requests: points or a cutout of a dataset, checked, routed, evaluated and named.

A source says where a dataset's values are: `nodes(names, snapshot)` gives ix, iy, iz and a column c0, c1, ... for each
stored name, and optionally `chunks(names, snapshot)` the same by chunk, for wide kernels. Vectors are stored as three
names (variable + "_x", ...), others under their own.

Near the ground and the sky of a dataset that isn't periodic in z, each point gets the widest method whose nodes are
inside; the methods' results are united, so each point is evaluated once. Times between snapshots are weighted sums of
four snapshots' results; the snapshots are components of one evaluation, some at a time, whatever the number of times.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddymesh import boundary, catalog, cutout, temporal
from eddymesh.getdata import evaluate, names
from eddymesh.lattice import into_chunks, out_of_chunks
from eddymesh.weights import TERMS

#: Snapshots that are evaluated together, as components.
SNAPSHOTS = 12
SUFFIX = {"field": "", "gradient": "_g", "laplacian": "_l", "hessian": "_h"}


class Source(NamedTuple):
    """n: nodes along each axis; spacing; periodic: whether z is."""

    n: int
    spacing: float
    periodic: bool
    nodes: Callable[[list[str], int], DataFrame]
    chunks: Callable[[list[str], int], DataFrame] | None = None


def stored_names(variable: str) -> list[str]:
    return [f"{variable}_{a}" for a in "xyz"] if variable in catalog.VECTORS else [variable]


def kinds(source: Source, variable: str) -> list[tuple[str, list[str]]]:
    """Names that lie on the same planes: u and v half way between those of w and energy, where z isn't periodic."""
    own = stored_names(variable)
    if source.periodic:
        return [("uv", own)]
    if variable == "velocity":
        return [("uv", own[:2]), ("w", own[2:])]
    return [("energy" if variable == "energy" else "uv", own)]


def at_snapshots(source: Source, points: DataFrame, variable: str, method: str, operator: str, snapshots: list[int], quantize: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """pid, the columns to keep, and the columns of catalog.columns (field, gradient, Laplacian or Hessian) at points(pid,
    x, y, z) in each snapshot, as <column>_<place of the snapshot>. The snapshots are components of one evaluation."""
    outputs, found = len(TERMS[operator]), None
    for kind, own in kinds(source, variable):
        part = of_kind(source, points, variable, kind, own, method, operator, snapshots, quantize, keep if found is None else ())
        found = part if found is None else found.join(part, "pid")
    wanted = [(name, j) for name in stored_names(variable) for j in range(outputs)]
    return found.select("pid", *keep, *[F.col(f"{name}_{j}_{s}").alias(f"{c}_{s}") for s in range(len(snapshots)) for (name, j), c in zip(wanted, catalog.columns(variable, operator))])


def by_chunk(source: Source, own: list[str], snapshots: list[int]) -> DataFrame:
    """cx, cy, cz and v0, v1, ...: all names of the first snapshot, then of the next. A chunk may be absent from some."""
    found = None
    for s, snapshot in enumerate(snapshots):
        part = source.chunks(own, snapshot) if source.chunks else into_chunks(source.nodes(own, snapshot), len(own))
        part = part.select("cx", "cy", "cz", *[F.col(f"v{k}").alias(f"v{s * len(own) + k}") for k in range(len(own))])
        found = part if found is None else found.join(part, ["cx", "cy", "cz"], "full")
    return found


def of_kind(source: Source, points: DataFrame, variable: str, kind: str, own: list[str], method: str, operator: str, snapshots: list[int], quantize: bool, keep: Sequence[str]) -> DataFrame:
    chunks, outputs, components = by_chunk(source, own, snapshots), len(TERMS[operator]), len(own) * len(snapshots)
    nodes = source.nodes(own, snapshots[0]) if len(snapshots) == 1 else out_of_chunks(chunks, components)
    made = names(operator, components)

    if source.periodic:
        out = evaluate(points, nodes, method, operator, components, (source.spacing,) * 3, (0.0, 0.0, 0.0), source.n, quantize=quantize, chunks=chunks, keep=keep)
    else:
        # In units of the spacing; each point goes to one method.
        unit = points.select("pid", *keep, *[(F.col(a) / F.lit(source.spacing)).alias(a) for a in "xyz"])
        route = boundary.routed(F.col("z"), method + SUFFIX[operator], variable, source.n)
        routed, out = unit.withColumn("by", route), None
        for by in [method + SUFFIX[operator], *boundary.STEPS[method + SUFFIX[operator]]]:
            at, plain = routed.where(F.col("by") == by).drop("by"), by.removesuffix(SUFFIX[operator])
            if plain == "linear":
                part = near_ground(at, nodes, chunks, kind, method, operator, components, source.n, keep)
            else:
                part = evaluate(at, nodes, plain, operator, components, (1.0,) * 3, (0.0, 0.0, boundary.z_offset(kind)), source.n, quantize=quantize, chunks=chunks, keep=keep)
            part = part.select("pid", *keep, *made)
            out = part if out is None else out.unionByName(part)
        factor = F.lit(source.spacing ** -{"field": 0, "gradient": 1}.get(operator, 2))
        out = out.select("pid", *keep, *[(F.col(c) * factor).alias(c) for c in made])
    return out.select("pid", *keep, *[F.col(f"c{s * len(own) + k}_{j}").alias(f"{name}_{j}_{s}") for s in range(len(snapshots)) for k, name in enumerate(own) for j in range(outputs)])


def near_ground(points: DataFrame, nodes: DataFrame, chunks: DataFrame, kind: str, method: str, operator: str, components: int, n: int, keep: Sequence[str]) -> DataFrame:
    """The linear methods: in x and y with the wanted method's own kernel, or its differences, one component at a time."""
    if operator == "field":
        return boundary.linear_field(points, None, kind, method, n, components, chunks, keep)
    found = points.select("pid", *keep)
    for k in range(components):
        one = nodes.select("ix", "iy", "iz", F.col(f"c{k}").alias("c0"))
        part = boundary.linear_differences(points, one, kind, int(method[2]) if method.endswith("noint") else 4, operator, n)
        outs = [c for c in part.columns if c != "pid"]
        part = part.select("pid", *[F.col(c).alias(f"c{k}_{c.split('_')[1]}") for c in outs])
        found = found.join(part, "pid")
    return found


def get_data(source: Source, title: str, variable: str, time: float, method: str, operator: str, points: DataFrame, temporal_method: str = "none", end: float | None = None, step: float | None = None, limited: bool = True) -> DataFrame:
    """pid, time, x_point, y_point, z_point and the named result columns, for each of the points(pid, x, y, z) at the
    time, or at each time of a series to `end` by `step`.

    Raises ValueError for a request that the catalog doesn't offer, or points outside the dataset's domain. No points
    give no rows. limited: a call takes catalog.MAX_POINTS at most; a job over a whole table isn't such a call."""
    catalog.check(title, variable, time, method, operator, temporal_method, end=end, step=step)
    catalog.check_points(title, points, limited)
    d, out = catalog.dataset(title), None
    series = [time] if end is None else temporal.series(time, end, step)
    columns = catalog.columns(variable, operator)
    keep = [f"{a}_point" for a in "xyz"]
    placed = points.select("pid", "x", "y", "z", *[F.col(a).alias(c) for a, c in zip("xyz", keep)])
    for snapshots, wanted in needed(d, series, temporal_method):
        part, rows = at_snapshots(source, placed, variable, method, operator, list(snapshots), keep=keep), []
        for at, t in enumerate(wanted):
            shares = [(s, weights[at]) for s, weights in enumerate(snapshots.values()) if weights[at]]
            sums = [temporal.weighted([F.col(f"{c}_{s}") for s, _ in shares], [w for _, w in shares]) for c in columns]
            rows.append(F.struct(F.lit(t).alias("time"), *[v.alias(c) for v, c in zip(sums, columns)]))
        part = part.select("pid", F.inline(F.array(*rows)), *keep).select("pid", "time", *keep, *columns)
        out = part if out is None else out.unionByName(part)
    return out


def needed(d: tuple, series: list[float], temporal_method: str) -> list[tuple[dict[int, list[float]], list[float]]]:
    """Times in groups that share snapshots, each with its snapshots and their weights at every time of the group."""
    index = lambda t: t if d[0] in catalog.SNAPSHOT_TIMES else t / d[7] + d[8]
    groups: list[tuple[set[int], list[tuple[float, dict[int, float]]]]] = []
    for t in series:
        tau = index(t)
        if temporal_method == "pchip":
            below = int(tau // 1)
            own = {below + k: w for k, w in temporal.pchip_shares(tau - below).items()}
        else:
            own = {int((tau + 0.5) // 1): 1.0}
        if not groups or len(groups[-1][0] | set(own)) > SNAPSHOTS:
            groups.append((set(), []))
        groups[-1][0].update(own)
        groups[-1][1].append((t, own))
    return [({s: [own.get(s, 0.0) for _, own in times] for s in sorted(found)}, [t for t, _ in times]) for found, times in groups]


def get_cutout(source: Source, title: str, variable: str, snapshot: int, ranges: list[tuple[int, int]], strides: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """x, y, z (coordinates), i, j, k (1-based requested indices) and the variable's columns, for each stride-th node of
    1-based inclusive ranges. Along a periodic axis a range may leave the lattice or be longer than it: each node is read
    once, and repeated after.

    Raises ValueError for a request that the catalog doesn't offer."""
    own = stored_names(variable)
    catalog.check(title, variable, snapshot, "", "", cutout=True)
    catalog.check_box(title, ranges, list(strides), len(own))
    nodes = source.nodes(own, snapshot)
    found = cutout.box(nodes, [(lo - 1, hi - 1) for lo, hi in ranges], strides, source.n)
    shift = catalog.offsets(title, variable)
    at = [(F.round(F.col(f"r{a}") * F.lit(source.spacing), 7) + F.lit(s)).alias(a) for a, s in zip("xyz", shift)]
    index: list[Column] = [(F.col(f"r{a}") + 1).alias(i) for a, i in zip("xyz", "ijk")]
    return found.select(*at, *index, *[F.col(f"c{k}").alias(c) for k, c in enumerate(catalog.columns(variable, "field"))])


def axis_coordinates(title: str, axis: str, first: int, last: int, stride: int, variable: str, spark, grid: DataFrame | None = None) -> DataFrame:
    """i (1-based index) and coordinate of every stride-th node of an axis. An irregular axis takes its coordinates from
    grid(i, coordinate), a table that its owner gives."""
    k = "xyz".index(axis)
    spacing, shift = catalog.dataset(title)[2][k], catalog.offsets(title, variable)[k]
    rows = spark.range(first, last + 1, stride).select(F.col("id").alias("i"))
    if spacing is None:
        if grid is None:
            raise ValueError(f"{axis} of {title} is irregular, and needs a table of its coordinates")
        return rows.join(grid, "i").select("i", "coordinate")
    return rows.select("i", (F.round((F.col("i") - 1) * F.lit(spacing), 7) + F.lit(shift)).alias("coordinate"))
