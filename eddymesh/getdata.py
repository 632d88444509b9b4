"""Point queries: a field, its gradient, Laplacian or Hessian at arbitrary points.

Points go to chunks: those with points and the ones around them, as stored, meet the points of the chunk. Kernels are
contracted there axis by axis in numpy, differences at nodes are sums of shifted values. So a point is one row, whatever
the width of its kernel. Points of a chunk are split into runs, so that a crowded chunk is no one task's work. Only what
has fewer than four nodes an axis is a stencil join: points, exploded taps, an equi-join with the voxels and a sum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

from eddymesh.lattice import CHUNK, N, around, into_chunks
from eddymesh.weights import TERMS, axis, nearest, taps

#: From so many nodes an axis on, points go to chunks. Points of a chunk in one run; points contracted at once.
WIDE, RUN, BLOCK = 4, 50_000, 1024
STEPS = 100_000


def index(p: Column, d: float, off: float, n: int, near: bool) -> Column:
    """Grid index below the point, or of the nearest node."""
    return F.pmod(F.floor(p / F.lit(d) + F.lit(off + 0.5 * near)).cast("long"), F.lit(n)).cast("long")


def fraction(p: Column, d: float, off: float, quantize: bool) -> Column:
    """Position between two nodes, cut to steps of 1e-5 with quantize, as a lookup table would."""
    exact = F.pmod(p / F.lit(d) + F.lit(off), F.lit(1.0))
    return F.floor(exact * STEPS) / F.lit(float(STEPS)) if quantize else exact


def polynomial(c: list, x: Column) -> Column:
    out = F.lit(float(c[-1]))
    for a in reversed(c[:-1]):
        out = out * x + F.lit(float(a))
    return out


def scale(term: str, spacing: tuple[float, float, float]) -> float:
    out = 1.0
    for kind, d in zip(term, spacing):
        out /= d ** "wds".index(kind)
    return out


def names(operator: str, components: int) -> list[str]:
    return [f"c{k}_{j}" for k in range(components) for j in range(len(TERMS[operator]))]


def summed(exploded: DataFrame, nodes: DataFrame, outputs: int, components: int, n: int = N, keep: Sequence[str] = ()) -> DataFrame:
    """exploded: pid, the columns to keep, ix, iy, iz (not wrapped yet) and weights w0, w1, ...; the weighted sums of
    each component."""
    keys = exploded.select("pid", *keep, *[F.pmod(F.col(f"i{a}"), F.lit(n)).cast("long").alias(f"i{a}") for a in "xyz"], *[f"w{j}" for j in range(outputs)])
    sums = [F.sum(F.col(f"w{j}") * F.col(f"c{k}")).alias(f"c{k}_{j}") for k in range(components) for j in range(outputs)]
    return keys.join(nodes, ["ix", "iy", "iz"]).groupBy("pid", *keep).agg(*sums)


def evaluate(points: DataFrame, nodes: DataFrame | None, method: str, operator: str = "field", components: int = 1, spacing=(1.0, 1.0, 1.0), offset=(0.0, 0.0, 0.0), n: int = N, chunk: int = CHUNK, quantize: bool = True, chunks: DataFrame | None = None, keep: Sequence[str] = (), counted: DataFrame | None = None, decimals: int | None = None) -> DataFrame:
    """pid, the columns to keep and a column c<component>_<output> for each output, for points(pid, x, y, z) and
    nodes(ix, iy, iz, c0, ...).

    chunks: the same nodes by chunk (cx, cy, cz, v0, ...), if they are stored so; no voxel rows are made then, unless
    the method isn't `wide`. keep: columns of the points to go along. counted: points(x, y, z) among which these are, by
    which chunks' points are counted if these are costly to make: what they come from then is evaluated once. decimals:
    to which results are rounded (`rounded`), for methods that are `wide`.
    """
    near, terms = nearest(method), TERMS[operator]
    at = [index(F.col(a), d, o, n, near).alias(f"i{a}") for a, d, o in zip("xyz", spacing, offset)]
    across = wide(method)
    if decimals is not None and not across:
        raise ValueError("only results by chunk are rounded here")
    counted = None if counted is None else counted.select(*at)
    if across and chunks is None:
        chunks = into_chunks(nodes, components, chunk)
    if near:
        factors = [scale(t[0], spacing) if len(t) == 1 else None for t in terms]
        if operator == "laplacian" and len(set(spacing)) > 1:
            raise ValueError("nearest-node Laplacians take one spacing for all axes")
        factors = [f if f is not None else spacing[0] ** -2 for f in factors]
        scaled = [(x, y, z, [w * f for w, f in zip(ws, factors)]) for x, y, z, ws in taps(method, operator)]
        placed = points.select("pid", *keep, *at)
        if across:
            return differenced(placed, chunks, scaled, components, keep, n, chunk, counted, decimals)
        all_ = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"), *[F.lit(w).alias(f"w{j}") for j, w in enumerate(ws)]) for x, y, z, ws in scaled])
        exploded = placed.select("*", F.explode(all_).alias("k")).select("pid", *keep, *[(F.col(f"i{a}") + F.col(f"k.{a}")).alias(f"i{a}") for a in "xyz"], *[f"k.w{j}" for j in range(len(terms))])
        return summed(exploded, nodes, len(terms), components, n, keep)
    placed = points.select("pid", *keep, *at, *[fraction(F.col(a), d, o, quantize).alias(f"f{a}") for a, d, o in zip("xyz", spacing, offset)])
    kernels = axis(method)
    used = sorted({c for t in terms for term in t for c in term})
    width = sorted({x for c in used for x in kernels[c]})
    if across:
        scales = [[scale(t, spacing) for t in group] for group in terms]
        return contracted(placed, chunks, {a: polynomials(f"f{a}", {c: kernels[c] for c in used}, width) for a in "xyz"}, terms, scales, {a: (width[0], width[-1]) for a in "xyz"}, components, [f"f{a}" for a in "xyz"], keep, n, chunk, counted, decimals)
    out = placed
    for a in "xyz":
        weights = F.array(*[F.struct(F.lit(x).alias("k"), *[polynomial(kernels[c].get(x, [0]), F.col(f"f{a}")).alias(c) for c in used]) for x in width])
        out = out.withColumn(f"t{a}", F.explode(weights))
    sums = []
    for j, t in enumerate(terms):
        parts = [F.col(f"tx.{x}") * F.col(f"ty.{y}") * F.col(f"tz.{z}") * F.lit(scale(x + y + z, spacing)) for x, y, z in t]
        sums.append(sum(parts[1:], parts[0]).alias(f"w{j}"))
    return summed(out.select("pid", *keep, *[(F.col(f"i{a}") + F.col(f"t{a}.k")).alias(f"i{a}") for a in "xyz"], *sums), nodes, len(terms), components, n, keep)


def wide(method: str) -> bool:
    """Whether the method's kernels go to chunks."""
    return len({x for k in axis(method).values() for x in k}) >= WIDE


def polynomials(column: str, kernels: dict, width: list[int]) -> Callable[[pa.Table], dict[str, np.ndarray]]:
    """For a table of points, each kernel's weights (point, node) at the fractions in a column."""
    powers = max(len(p) for k in kernels.values() for p in k.values())
    coefficients = {c: np.array([[float(v) for v in k.get(x, [])] + [0.0] * (powers - len(k.get(x, []))) for x in width]) for c, k in kernels.items()}
    return lambda part: {c: part[column].to_numpy()[:, None] ** np.arange(powers)[None, :] @ m.T for c, m in coefficients.items()}


def rounded(v: np.ndarray, decimals: int | None) -> np.ndarray:
    """Nearest values of so many decimals by DuckDB's rule: the nearest whole number of them, halves away from 0, and what
    that overflows as it is; all as they are for None."""
    if decimals is None:
        return v
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = v * 10.0**decimals
        whole = np.rint(scaled)
        whole = np.where(np.abs(scaled - whole) == 0.5, scaled + np.copysign(0.5, scaled), whole) / 10.0**decimals
    return np.where(np.isfinite(whole), whole, v) + 0.0


def contracted(placed: DataFrame, chunks: DataFrame, weights: dict, terms, scales, reach: dict[str, tuple[int, int]], components: int, carried: list[str], keep: Sequence[str], n: int, chunk: int, counted: DataFrame | None = None, decimals: int | None = None) -> DataFrame:
    """Sums of products of one kernel along each axis. weights: of an axis, a function of the points that gives each of
    its kernels' weights; reach: first and last node of an axis."""
    size = [reach[a][1] - reach[a][0] + 1 for a in "zyx"]

    def compute(values: np.ndarray, first: dict[str, np.ndarray], part: pa.Table) -> np.ndarray:
        window = np.lib.stride_tricks.sliding_window_view(values, size, (1, 2, 3))[:, first["z"], first["y"], first["x"]]
        own = {a: weights[a](part) for a in "xyz"}
        by_x: dict[str, np.ndarray] = {}
        by_xy: dict[str, np.ndarray] = {}
        cols = []
        for group, factors in zip(terms, scales):
            total = 0.0
            for (x, y, z), f in zip(group, factors):
                if x not in by_x:  # (components, points, z, y)
                    by_x[x] = np.einsum("cpzyx,px->cpzy", window, own["x"][x])
                if x + y not in by_xy:
                    by_xy[x + y] = np.einsum("cpzy,py->cpz", by_x[x], own["y"][y])
                total = total + np.einsum("cpz,pz->cp", by_xy[x + y], own["z"][z]) * f
            cols.append(total)
        return np.stack(cols, axis=1)

    return by_chunk(placed, chunks, compute, reach, components, len(terms), carried, keep, n, chunk, counted=counted, decimals=decimals)


def differenced(placed: DataFrame, chunks: DataFrame, shifts: list[tuple[int, int, int, list[float]]], components: int, keep: Sequence[str], n: int, chunk: int, counted: DataFrame | None = None, decimals: int | None = None) -> DataFrame:
    """Sums of weighted values at fixed steps from a node; those of a node that several points share are summed once."""
    outputs = len(shifts[0][3])
    reach = {a: (min(t[k] for t in shifts), max(t[k] for t in shifts)) for k, a in enumerate("xyz")}

    def compute(values: np.ndarray, first: dict[str, np.ndarray], part: pa.Table) -> np.ndarray:
        found = np.zeros((components, outputs, len(first["x"])))
        with np.errstate(invalid="ignore"):  # a value that is no number makes none of each output, by a weight of 0 too
            for x, y, z, ws in shifts:
                at = values[:, first["z"] + (z - reach["z"][0]), first["y"] + (y - reach["y"][0]), first["x"] + (x - reach["x"][0])]
                for j, w in enumerate(ws):
                    found[:, j] += w * at
        return found

    return by_chunk(placed, chunks, compute, reach, components, outputs, [], keep, n, chunk, [t[:3] for t in shifts], counted, by_node=True, decimals=decimals)


def by_chunk(placed: DataFrame, chunks: DataFrame, compute: Callable, reach: dict[str, tuple[int, int]], components: int, outputs: int, carried: list[str], keep: Sequence[str], n: int, chunk: int, shifts: list[tuple[int, int, int]] | None = None, counted: DataFrame | None = None, by_node: bool = False, decimals: int | None = None) -> DataFrame:
    """Chunks that have points, with the chunks around them, against their points: compute(values, first, part) gives
    (components, outputs, points) from the values that the chunk's points reach (component, z, y, x), where each point's
    own begin there, and the points themselves with the columns carried.

    A node that isn't stored or is null adds nothing, as in a join and a sum; a point without any gives null. shifts: the
    nodes that a point takes, if not all within its reach. counted: ix, iy, iz of these points or more, for the runs.
    by_node: points of one node have one result, so compute is called with each node that has points, and part None."""
    below, above = max(0, *[-lo for lo, _ in reach.values()]), max(0, *[hi for _, hi in reach.values()])
    margin = (below + chunk - 1) // chunk
    across = (margin + (above + chunk - 1) // chunk + 1) * chunk
    at = F.lit(0)
    for a in "zyx":
        at = at * chunk + F.col(f"i{a}") % chunk
    edge = n // chunk
    own = [F.expr(f"i{a} div {chunk}") for a in "xyz"]
    cell = (own[0] * edge + own[1]) * edge + own[2]
    of_chunk = placed.select("pid", *keep, *carried, cell.alias("cell"), at.cast("int").alias("at"))
    # Nulls go before the count, so that both of its uses read one shuffle.
    there = (placed if counted is None else counted).select(cell.alias("cell")).where("cell is not null")
    runs = there.groupBy("cell").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    wanted = runs.select("cell", "runs", *[F.expr(e).alias(f"c{a}") for a, e in zip("xyz", (f"cell div {edge * edge}", f"cell div {edge} % {edge}", f"cell % {edge}"))])
    parts = around(wanted, chunks, below, above, components, chunk, n).withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).drop("cx", "cy", "cz", "runs")
    parts = parts.select(*[F.col(c).alias(c) for c in parts.columns])  # names of its own, as both sides come from the points
    # Chunks of several runs are fewer than the points by RUN at least, so these may be broadcast.
    crowded = runs.where("runs > 1")
    run_of = F.coalesce(F.pmod(F.xxhash64("pid"), F.col("runs")), F.lit(0)).cast("int")
    dealt = of_chunk.where("cell is not null").join(F.broadcast(crowded), "cell", "left").withColumn("run", run_of).drop("runs")
    kept = ["pid", *keep]
    result = StructType([placed.schema[c] for c in kept])
    for k in range(components):
        for j in range(outputs):
            result = result.add(f"c{k}_{j}", DoubleType())
    schema = to_arrow_schema(result)
    inner = [slice(margin * chunk + reach[a][0], (margin + 1) * chunk + reach[a][1]) for a in "zyx"]
    size = [reach[a][1] - reach[a][0] + 1 for a in "zyx"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return schema.empty_table()
        whole = np.zeros((components, across, across, across))
        known = np.zeros(whole.shape, dtype=bool)
        corner = [(right[f"r{a}"].to_numpy() + margin) * chunk for a in "zyx"]
        for k in range(components):
            for block, z, y, x in zip(right[f"v{k}"], *corner):
                if block.is_valid:
                    inside = (k, slice(z, z + chunk), slice(y, y + chunk), slice(x, x + chunk))
                    vals = block.values.slice(0, chunk**3)
                    for into, own in ((whole, pc.fill_null(vals, 0.0)), (known, vals.is_valid())):
                        own = own.to_numpy(zero_copy_only=False)
                        into[inside] = np.pad(own, (0, chunk**3 - len(own))).reshape(chunk, chunk, chunk)
        values, known = whole[:, *inner], known[:, *inner]
        seen = None if known.all() else np.lib.stride_tricks.sliding_window_view(known, size, (1, 2, 3))
        if seen is not None:
            seen = seen.any(axis=(4, 5, 6)) if shifts is None else np.any([seen[..., z - reach["z"][0], y - reach["y"][0], x - reach["x"][0]] for x, y, z in shifts], axis=0)

        def found_at(place: np.ndarray, part: pa.Table | None) -> tuple[np.ndarray, np.ndarray | None]:
            """Values (component, output, place), and where there are none."""
            first = {"x": place % chunk, "y": place // chunk % chunk, "z": place // (chunk * chunk)}
            return rounded(compute(values, first, part), decimals), None if seen is None else ~seen[:, first["z"], first["y"], first["x"]]

        if by_node:
            asked = np.zeros(chunk**3, dtype=bool)
            asked[left["at"].to_numpy()] = True
            number = np.cumsum(asked) - 1
            each = [found_at(place, None) for place in np.split(np.flatnonzero(asked), range(BLOCK, int(asked.sum()), BLOCK))]
            of_nodes = np.concatenate([f for f, _ in each], axis=2), None if seen is None else np.concatenate([m for _, m in each], axis=1)
        blocks = []
        step = RUN if by_node else BLOCK
        for start in range(0, left.num_rows, step):
            part = left.slice(start, step)
            place = part["at"].to_numpy()
            if by_node:
                found, none = (None if x is None else x[..., number[place]] for x in of_nodes)
            else:
                found, none = found_at(place, part)
            cols = [pa.array(np.ascontiguousarray(found[k, j]), mask=None if none is None else none[k]) for k in range(components) for j in range(outputs)]
            blocks.append(pa.table([*[part[c].combine_chunks() for c in kept], *cols], schema=schema))
        return pa.concat_tables(blocks)

    keys = ["cell", "run"]
    return dealt.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInArrow(run, result)
