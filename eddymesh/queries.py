"""The queries over the lattice, each with its SQL for DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddymesh import boundary, catalog, cutout, requests, temporal
from eddymesh.getdata import evaluate, names, wide
from eddymesh.lattice import CHUNK, N, chunked, nodes, pack, points, read, snapshots, stored_chunks, unpack, voxels
from eddymesh.weights import CORNERS, TERMS, axis, difference, field, nearest, spline, taps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VOX = """vox as (select case vec_id // 64 when 0 then 'ux' when 1 then 'uy' when 2 then 'uz' else 'p' end as var, greatest(vec_id // 64 - 3, 0) as t, code as chunk_code,
  4 * ((code & 1) + 2 * ((code >> 3) & 1)) + pos % 4 as ix, 4 * (((code >> 1) & 1) + 2 * ((code >> 4) & 1)) + (pos // 4) % 4 as iy, 4 * (((code >> 2) & 1) + 2 * ((code >> 5) & 1)) + pos // 16 as iz, e::double as v
  from (select vec_id, vec_id % 64 as code, unnest(range(0, 64)) as pos, unnest(embedding) as e from embeddings))"""
PTS = """pts as (select o_orderkey as pid, ((o_orderkey * 37) % 1552) / 97.0::double as x, ((o_custkey * 53 + o_orderkey * 5) % 1552) / 97.0::double as y, ((o_orderkey * 29 + o_custkey * 7) % 1552) / 97.0::double as z from orders)"""
P_NODES = "nodes as (select ix, iy, iz, v as c0 from vox where var = 'p' and t = 0)"
U_NODES = "nodes as (select ix, iy, iz, max(v) filter (var = 'ux') as c0, max(v) filter (var = 'uy') as c1, max(v) filter (var = 'uz') as c2 from vox where t = 0 and var <> 'p' group by all)"


def query(sql: str | None = None):
    def added(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return added


def r6(c):
    """Six decimals by DuckDB's own rule: the nearest whole number of millionths, halves away from 0, and what that
    overflows as it is. Spark's round makes a decimal of each value, which took most of a query's time."""
    s = c * F.lit(1e6)
    whole = F.when(F.abs(s - F.rint(s)) == 0.5, s + F.signum(s) * F.lit(0.5)).otherwise(F.rint(s))
    return F.when(F.abs(s) < float("inf"), whole / F.lit(1e6)).otherwise(c) + F.lit(0.0)


def values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v!r}::double" if isinstance(v, float) else f"{v}::bigint"
    return f"(values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) as k({columns})"


def horner(c: list, x: str) -> str:
    out = f"{float(c[-1])!r}::double"
    for a in reversed(c[:-1]):
        out = f"({out} * {x} + {float(a)!r}::double)"
    return out


def sql_interp(method: str, operator: str, columns: list[str], components: int = 1, z: str = "z", off_z: str = "0", source: str = "pts", node_sql: str | None = None) -> str:
    """The stencil as a join of points, taps and voxels."""
    near, terms = nearest(method), TERMS[operator]
    shift = 0.5 if near else 0
    place = ", ".join(f"floor({p} + {o} + {shift})::bigint as i{a}, floor(100000 * ({p} + {o} - floor({p} + {o}))) / 100000.0::double as f{a}" for a, p, o in (("x", "x", "0"), ("y", "y", "0"), ("z", z, off_z)))
    base = f"with {VOX}, {PTS}, {node_sql or (P_NODES if components == 1 else U_NODES)}, g as (select pid, {place} from {source})"
    out = [f"round(sum(w{j} * c{k}), 6) + 0.0 as {columns[k * len(terms) + j]}" for k in range(components) for j in range(len(terms))]
    if near:
        rows = [(x, y, z_, *ws) for x, y, z_, ws in taps(method, operator)]
        k = values(rows, ", ".join(["dx", "dy", "dz", *[f"w{j}" for j in range(len(terms))]]))
        return f"{base} select pid, {', '.join(out)} from g, {k} join nodes on nodes.ix = (g.ix + dx) & 15 and nodes.iy = (g.iy + dy) & 15 and nodes.iz = (g.iz + dz) & 15 group by pid"
    kernels = axis(method)
    used = sorted({c for t in terms for term in t for c in term})
    width = sorted({x for c in used for x in kernels[c]})
    parts = []
    for a in "xyz":
        rows = " union all ".join(f"select pid, (i{a} + {x}) & 15 as j{a}, " + ", ".join(f"{horner(kernels[c].get(x, [0]), f'f{a}')} as {c}{a}" for c in used) + " from g" for x in width)
        parts.append(f"t{a} as ({rows})")
    sums = ", ".join(f"{' + '.join(f'{x}x * {y}y * {z_}z' for x, y, z_ in t)} as w{j}" for j, t in enumerate(terms))
    return f"{base}, {', '.join(parts)}, w as (select tx.pid, jx, jy, jz, {sums} from tx join ty on tx.pid = ty.pid join tz on tx.pid = tz.pid) select pid, {', '.join(out)} from w join nodes on ix = jx and iy = jy and iz = jz group by pid"


def interpolation(name: str, method: str, operator: str, variable: str, sql: bool = True) -> None:
    components, columns = (1, catalog.columns("pressure", operator)) if variable == "p" else (3, catalog.columns("velocity", operator))
    stored = ["p"] if variable == "p" else ["ux", "uy", "uz"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = names(operator, components)
        if wide(method):  # rounded where they are made: a Hessian's 18 columns are too much code for one compiled step
            found = evaluate(points(spark, sf_dir), None, method, operator, components, chunks=chunked(spark, sf_dir, stored), decimals=6)
            return found.select("pid", *[F.col(c).alias(n) for c, n in zip(own, columns)])
        found = evaluate(points(spark, sf_dir), nodes(spark, sf_dir, stored), method, operator, components)
        return found.select("pid", *[r6(F.col(c)).alias(n) for c, n in zip(own, columns)])

    QUERIES[name] = run
    if sql:
        SQL[name] = sql_interp(method, operator, columns, components)


for _name, _method, _operator, _variable in [
    ("interp_none", "none", "field", "u"), ("interp_lag4", "lag4", "field", "p"), ("interp_lag6", "lag6", "field", "p"), ("interp_lag8", "lag8", "field", "u"),
    ("interp_m1q4", "m1q4", "field", "p"), ("interp_m2q8", "m2q8", "field", "p"), ("interp_m2q14", "m2q14", "field", "p"),
    ("grad_fd4", "fd4noint", "gradient", "u"), ("grad_fd6", "fd6noint", "gradient", "p"), ("grad_fd8", "fd8noint", "gradient", "p"),
    ("grad_fd4lag4", "fd4lag4", "gradient", "p"), ("grad_m1q4", "m1q4", "gradient", "p"), ("grad_m2q8", "m2q8", "gradient", "p"),
    ("lap_fd4", "fd4noint", "laplacian", "u"), ("lap_fd6", "fd6noint", "laplacian", "u"), ("lap_fd8", "fd8noint", "laplacian", "u"), ("lap_fd4lag4", "fd4lag4", "laplacian", "u"),
    ("hess_fd4", "fd4noint", "hessian", "u"), ("hess_fd6", "fd6noint", "hessian", "p"), ("hess_fd8", "fd8noint", "hessian", "p"), ("hess_m2q8", "m2q8", "hessian", "p"), ("hess_fd4lag4", "fd4lag4", "hessian", "p"),
]:
    interpolation(_name, _method, _operator, _variable)

# --- Catalogs and names ---

_catalog = [(d[0], *d[1], *d[2], *(c == "T" for c in d[3]), d[5][0], d[5][1], d[6], d[7], d[8], d[10], d[11]) for d in catalog.DATASETS]
_catalog_columns = "title, nx, ny, nz, dx, dy, dz, periodic_x, periodic_y, periodic_z, t_first, t_last, snapshots, dt, t_shift, native, pchip"


@query(f"select * from {values(_catalog, _catalog_columns)}")
def dataset_catalog(spark, sf_dir):
    kinds = "title string, nx long, ny long, nz long, dx double, dy double, dz double, periodic_x boolean, periodic_y boolean, periodic_z boolean, t_first double, t_last double, snapshots long, dt double, t_shift long, native boolean, pchip boolean"
    return spark.createDataFrame(_catalog, kinds)


_requests = [(t, v, o, m) for t in catalog.NAMES for v in ("pressure", "velocity", "temperature") for o in ("field", "laplacian") for m in ("lag8", "fd4noint", "m2q14")]


@query(f"with c as (select * from {values(catalog.capabilities(), 'title, variable, operator, method')}), r as (select * from {values(_requests, 'title, variable, operator, method')}) select r.*, exists (select 1 from c where c.title = r.title and c.variable = r.variable and c.operator = r.operator and c.method = r.method) as allowed from r")
def capability_check(spark, sf_dir):
    kinds = "title string, variable string, operator string, method string"
    legal = spark.createDataFrame(catalog.capabilities(), kinds).withColumn("legal", F.lit(True))
    return spark.createDataFrame(_requests, kinds).join(F.broadcast(legal), ["title", "variable", "operator", "method"], "left").select("title", "variable", "operator", "method", F.col("legal").isNotNull().alias("allowed"))


_headers = [(v, o, k, c) for v in [*catalog.VECTORS, *catalog.SCALARS] for o in catalog.operators(v) for k, c in enumerate(catalog.columns(v, o))]


@query(f"select variable, operator, string_agg(name, ',' order by place) as columns from {values(_headers, 'variable, operator, place, name')} group by variable, operator")
def result_header(spark, sf_dir):
    rows = spark.createDataFrame(_headers, "variable string, operator string, place int, name string")
    return rows.groupBy("variable", "operator").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda s: s["name"]), ",").alias("columns"))


@query(f"with {VOX} select var, t, chunk_code, ix, iy, iz, round(v, 6) + 0.0 as v from vox")
def voxel_scan(spark, sf_dir):
    return voxels(spark, sf_dir).select("var", "t", "chunk_code", "ix", "iy", "iz", r6(F.col("v")).alias("v"))


# --- Files and Morton codes ---


def file_ranges(spark, sf_dir):
    """A file for each supplier: 512 codes each, the last ones without a backup."""
    s = read(spark, sf_dir, "supplier")
    return s.selectExpr("s_name as name", "(s_suppkey - 1) * 512 as min_lim", "s_suppkey * 512 - 1 as max_lim", "concat('/prod/', s_name) as path_prod")


FILES = "files as (select s_name as name, (s_suppkey - 1) * 512 as min_lim, s_suppkey * 512 - 1 as max_lim, '/prod/' || s_name as path_prod from supplier)"
BACK = "backs as (select s_name as name, '/back/' || s_name as path_back from supplier where s_nationkey >= 5)"


@query(f"with {FILES} select name, min_lim, max_lim from files union all select 'synthetic' || i, (i - 1) * 134217728, i * 134217728 - 1 from range(1, 65) r(i)")
def file_map(spark, sf_dir):
    made = spark.range(1, 65).selectExpr("concat('synthetic', id) as name", "(id - 1) * 134217728 as min_lim", "id * 134217728 - 1 as max_lim")
    return file_ranges(spark, sf_dir).select("name", "min_lim", "max_lim").unionByName(made)


@query("select n_name as name, path, folder_rank from (select n_name, '/data/' || c_custkey as path, c_custkey as folder_rank, row_number() over (partition by n_name order by c_custkey) as k from customer join nation on c_nationkey = n_nationkey) where k = 1")
def file_paths_first_wins(spark, sf_dir):
    found = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    first = found.groupBy(F.col("n_name").alias("name")).agg(F.min("c_custkey").alias("folder_rank"))
    return first.select("name", F.concat(F.lit("/data/"), "folder_rank").alias("path"), "folder_rank")


CELLS = f"{PTS}, cells as (select pid, floor(x)::bigint as ix, floor(y)::bigint as iy, floor(z)::bigint as iz from pts)"
MORTON = " | ".join(f"(((i{a} >> {i}) & 1) << {3 * i + k})" for i in range(4) for k, a in enumerate("xyz"))


def cells(spark, sf_dir):
    return points(spark, sf_dir).select("pid", *[F.floor(a).cast("long").alias(f"i{a}") for a in "xyz"])


@query(f"with {CELLS} select pid, ix, iy, iz, {MORTON} as morton from cells")
def morton_pack(spark, sf_dir):
    return cells(spark, sf_dir).withColumn("morton", pack(F.col("ix"), F.col("iy"), F.col("iz")))


@query("select p_partkey, " + ", ".join(" | ".join(f"((((p_partkey % 4096) >> {3 * i + k}) & 1) << {i})" for i in range(4)) + f" as i{a}" for k, a in enumerate("xyz")) + " from part")
def morton_unpack(spark, sf_dir):
    code = F.col("p_partkey") % 4096
    return read(spark, sf_dir, "part").select("p_partkey", *[unpack(code, k).alias(f"i{a}") for k, a in enumerate("xyz")])


@query(f"with {CELLS} select pid, (({MORTON}) >> 9) << 9 as corner, count(*) over (partition by (({MORTON}) >> 9)) as in_file from cells")
def file_corner_code(spark, sf_dir):
    coded = cells(spark, sf_dir).select("pid", F.shiftleft(F.shiftright(pack(F.col("ix"), F.col("iy"), F.col("iz")), 9), 9).alias("corner"))
    return coded.join(coded.groupBy("corner").agg(F.count("*").alias("in_file")), "corner").select("pid", "corner", "in_file")


def coded_points(spark, sf_dir):
    return cells(spark, sf_dir).select("pid", (pack(F.col("ix"), F.col("iy"), F.col("iz")) % 4096).alias("morton"))


@query(f"with {CELLS}, {FILES}, m as (select pid, {MORTON} as morton from cells) select pid, morton, name from m join files on morton between min_lim and max_lim")
def file_range_join(spark, sf_dir):
    # Ranges are whole multiples of a file's size, so the interval join is an equi-join on the file's number, verified.
    files = file_ranges(spark, sf_dir).withColumn("file_code", F.expr("min_lim div 512"))
    found = coded_points(spark, sf_dir).withColumn("file_code", F.shiftright("morton", 9)).join(files, "file_code")
    return found.where("morton between min_lim and max_lim").select("pid", "morton", "name")


@query(f"with {CELLS}, {FILES}, m as (select pid, {MORTON} as morton from cells) select name, count(*) as n_points, min(morton) as first_code from m join files on (morton >> 9) << 9 = min_lim group by name")
def file_equi_join(spark, sf_dir):
    found = coded_points(spark, sf_dir).withColumn("min_lim", F.shiftleft(F.shiftright("morton", 9), 9)).join(file_ranges(spark, sf_dir), "min_lim")
    return found.groupBy("name").agg(F.count("*").alias("n_points"), F.min("morton").alias("first_code"))


@query(f"with {FILES}, {BACK} select files.name, path_prod, coalesce(path_back, '') as path_back from files left join backs on files.name = backs.name")
def backup_left_join(spark, sf_dir):
    back = read(spark, sf_dir, "supplier").where("s_nationkey >= 5").selectExpr("s_name as name", "concat('/back/', s_name) as path_back")
    return file_ranges(spark, sf_dir).join(back, "name", "left").select("name", "path_prod", F.coalesce("path_back", F.lit("")).alias("path_back"))


@query("select event_id, 'Velocity_' || lpad((event_id % 10000)::varchar, 4, '0') as name from events")
def zfill_names(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Velocity_"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0")).alias("name"))


# --- Grid places, chunks ---


@query(f"with {PTS} select pid, " + ", ".join(f"floor({a})::bigint % 16 as i{a}, floor({a} + 0.5)::bigint % 16 as n{a}" for a in "xyz") + " from pts")
def grid_index(spark, sf_dir):
    from eddymesh.getdata import index

    return points(spark, sf_dir).select("pid", *[index(F.col(a), 1.0, 0.0, N, near).alias(f"{'n' if near else 'i'}{a}") for a in "xyz" for near in (False, True)])


@query(f"with {PTS} select pid, " + ", ".join(f"floor(100000 * ({a} - floor({a}))) / 100000.0::double as f{a}" for a in "xyz") + " from pts")
def grid_fraction(spark, sf_dir):
    from eddymesh.getdata import fraction

    return points(spark, sf_dir).select("pid", *[fraction(F.col(a), 1.0, 0.0, True).alias(f"f{a}") for a in "xyz"])


def chunk_groups(spark, sf_dir):
    """First and last chunk of each point's lag8 neighbourhood (3 below, 4 above), and how many chunks it touches."""
    out = cells(spark, sf_dir)
    for a in "xyz":
        out = out.withColumn(f"lo_{a}", F.floor((F.col(f"i{a}") - 3) / 4).cast("long")).withColumn(f"hi_{a}", F.floor((F.col(f"i{a}") + 4) / 4).cast("long"))
    volume = (F.col("hi_x") - F.col("lo_x") + 1) * (F.col("hi_y") - F.col("lo_y") + 1) * (F.col("hi_z") - F.col("lo_z") + 1)
    return out.select("pid", *[F.pmod(f"{e}_{a}", F.lit(4)).cast("long").alias(f"{e}_{a}") for a in "xyz" for e in ("lo", "hi")], volume.alias("volume"))


GROUPS = (
    f"{CELLS}, q as (select pid, " + ", ".join(f"floor((i{a} - 3) / 4.0::double)::bigint as l{a}, floor((i{a} + 4) / 4.0::double)::bigint as h{a}" for a in "xyz") + " from cells), "
    "groups as (select pid, " + ", ".join(f"((l{a} % 4) + 4) % 4 as lo_{a}, ((h{a} % 4) + 4) % 4 as hi_{a}" for a in "xyz") + ", (hx - lx + 1) * (hy - ly + 1) * (hz - lz + 1) as volume from q)"
)


GROUPS_OF = f"with {GROUPS}"


@query(f"with {GROUPS} select * from groups")
def chunk_group_key(spark, sf_dir):
    return chunk_groups(spark, sf_dir)


@query(f"with {GROUPS} select lo_x, lo_y, lo_z, volume, count(*) as n_points, min(pid) as first_pid from groups group by all")
def points_per_chunk(spark, sf_dir):
    found = chunk_groups(spark, sf_dir).groupBy("lo_x", "lo_y", "lo_z", "volume").agg(F.count("*").alias("n_points"), F.min("pid").alias("first_pid"))
    return found.sortWithinPartitions(F.desc("volume"), "lo_z", "lo_y", "lo_x")


@query(sql_interp("lag8", "field", ["p"], source=f"(select pts.* from pts join ({GROUPS_OF} select pid, volume from groups) using (pid) where volume > 1)"))
def visitor_points(spark, sf_dir):
    """Points whose neighbourhood spans chunks get the same path as any other."""
    across = points(spark, sf_dir).join(chunk_groups(spark, sf_dir).where("volume > 1").select("pid"), "pid")
    return evaluate(across, None, "lag8", chunks=chunked(spark, sf_dir, ["p"])).select("pid", r6(F.col("c0_0")).alias("p"))


# --- Cutouts ---

BOX, PLANE = [(2, 9), (0, 11), (5, 14)], [(3, 3), (0, 15), (0, 15)]
WHERE = " and ".join(f"i{a} between {lo} and {hi}" for a, (lo, hi) in zip("xyz", BOX))


@query(f"with {VOX} select var, ix, iy, iz, round(v, 6) + 0.0 as v from vox where t = 0 and {WHERE}")
def cutout_box(spark, sf_dir):
    return cutout.box(voxels(spark, sf_dir, t=0, ranges=BOX), BOX).select("var", "ix", "iy", "iz", r6(F.col("v")).alias("v"))


@query(f"with {VOX} select var, ix, iy, iz, round(v, 6) + 0.0 as v from vox where t = 0 and {WHERE} and (ix - 2) % 2 = 0 and iy % 3 = 0 and (iz - 5) % 4 = 0")
def cutout_stride(spark, sf_dir):
    return cutout.box(voxels(spark, sf_dir, t=0, ranges=BOX), BOX, (2, 3, 4)).select("var", "ix", "iy", "iz", r6(F.col("v")).alias("v"))


@query(f"with {VOX} select var, rx, ry, rz, round(v, 6) + 0.0 as v from vox join range(10, 41) a(rx) on ((rx % 16) + 16) % 16 = ix join range(0, 8, 2) b(ry) on ry = iy join range(-4, 18) c(rz) on ((rz % 16) + 16) % 16 = iz where t = 0")
def cutout_periodic_tile(spark, sf_dir):
    return cutout.box(voxels(spark, sf_dir, t=0), [(10, 40), (0, 7), (-4, 17)], (1, 2, 1)).select("var", "rx", "ry", "rz", r6(F.col("v")).alias("v"))


def _axis_files(a: str, lo: int, hi: int) -> str:
    return f"(select ((i % 2) + 2) % 2 as f{a}, greatest(i * 8, {lo}) as lo_{a}, least((i + 1) * 8 - 1, {hi}) as hi_{a} from range({lo // 8}, {hi // 8 + 1}) r(i))"


@query("select * from " + ", ".join(_axis_files(a, lo, hi) for a, (lo, hi) in zip("xyz", [(3, 25), (0, 7), (-5, 9)])))
def box_file_split(spark, sf_dir):
    return cutout.file_boxes(spark, [(3, 25), (0, 7), (-5, 9)], 8)


@query("select i, round(i * 0.1953125::double, 7) as xcoor, round(i * 0.1953125::double, 7) + 0.09765625::double as zcoor_uv, round(i * 0.1953125::double, 7) + 0.1953125::double as zcoor_w from range(0, 2048, 3) r(i)")
def axis_coords(spark, sf_dir):
    at = F.round(F.col("id") * F.lit(0.1953125), 7)
    return spark.range(0, 2048, 3).select(F.col("id").alias("i"), at.alias("xcoor"), (at + 0.09765625).alias("zcoor_uv"), (at + 0.1953125).alias("zcoor_w"))


@query("select i, round(-cos(pi() * i / 511), 7) + 0.0 as y, round(-cos(pi() * (i + 1) / 511) + cos(pi() * i / 511), 7) + 0.0 as dy from range(0, 511) r(i)")
def irregular_y_coords(spark, sf_dir):
    """An irregular y grid by rule (wall-clustered cosines): coordinate and spacing of each index."""
    at = lambda i: -F.cos(F.lit(math.pi) * i / 511)
    return spark.range(0, 511).select(F.col("id").alias("i"), (F.round(at(F.col("id")), 7) + 0.0).alias("y"), (F.round(at(F.col("id") + 1) - at(F.col("id")), 7) + 0.0).alias("dy"))


@query(f"with {VOX}, {CELLS} select pid, round(v, 6) + 0.0 as p from cells join vox using (ix, iy, iz) where var = 'p' and t = 0 and {WHERE}")
def cutout_values(spark, sf_dir):
    stored = cutout.box(voxels(spark, sf_dir, ["p"], 0, BOX), BOX)
    return cells(spark, sf_dir).join(stored, ["ix", "iy", "iz"]).select("pid", r6(F.col("v")).alias("p"))


@query(f"with {VOX} select iy, iz, round(v, 6) + 0.0 as ux from vox where var = 'ux' and t = 0 and ix = 3")
def plane_slice(spark, sf_dir):
    return cutout.box(voxels(spark, sf_dir, ["ux"], 0, PLANE), PLANE).select("iy", "iz", r6(F.col("v")).alias("ux"))


@query(f"with {VOX} select bin, count(*) as n from (select least(greatest(floor((v + 0.6) / 0.06)::bigint, 0), 19) as bin from vox where var = 'p') group by bin")
def value_histogram(spark, sf_dir):
    bins = F.least(F.greatest(F.floor((F.col("v") + 0.6) / 0.06).cast("long"), F.lit(0)), F.lit(19)).cast("long")
    return voxels(spark, sf_dir, ["p"]).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"))


@query(f"with {PTS}, p as (select *, 0.5 + z * 15 / 16 as zz from pts) select count(*) as n, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(zz) as min_z, max(zz) as max_z, count(*) <= 2000000 and min(zz) >= 0.5 and max(zz) <= 15.5 as valid, count(*) filter (zz > 15) as near_top from p")
def points_domain_check(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("z", F.lit(0.5) + F.col("z") * 15 / 16)
    out = p.agg(F.count("*").alias("n"), *[f(a).alias(f"{k}_{a}") for a in "xyz" for k, f in (("min", F.min), ("max", F.max))], F.count(F.when(F.col("z") > 15, 1)).alias("near_top"))
    return out.withColumn("valid", (F.col("n") <= catalog.MAX_POINTS) & (F.col("min_z") >= 0.5) & (F.col("max_z") <= 15.5))


@query("select event_id, 1 + (event_id % 97) / 97.0::double as t, (event_id % 120) between 1 and 100 as snapshot_ok, 1 + (event_id % 97) / 97.0::double between 0 and 7.425 as time_ok from events")
def timepoint_check(spark, sf_dir):
    t = 1 + (F.col("event_id") % 97) / F.lit(97.0)
    d = catalog.dataset("sabl2048high")
    return read(spark, sf_dir, "events").select("event_id", t.alias("t"), (F.col("event_id") % 120).between(1, d[6]).alias("snapshot_ok"), t.between(*d[5]).alias("time_ok"))


@query("select p_partkey, 1 + p_partkey % 16 as lo, p_partkey % 16 + 1 + p_size % 20 as hi, (p_size % 20 + 1)::bigint as len, p_partkey % 16 + 1 + p_size % 20 <= 16 as inside, ((p_size % 20 + 1) * 16 * 16 * 4 * 3) <= 17179869184 as small from part")
def cutout_bounds_check(spark, sf_dir):
    lo, n = 1 + F.col("p_partkey") % 16, 1 + F.col("p_size") % 20
    return read(spark, sf_dir, "part").select("p_partkey", lo.alias("lo"), (lo + n - 1).cast("long").alias("hi"), n.cast("long").alias("len"), (lo + n - 1 <= 16).alias("inside"), (n * (16 * 16 * 4 * 3) <= catalog.MAX_BYTES).alias("small"))


@query(f"with {VOX} select t, 4096::bigint as expected, count(*) as found, count(*) filter (v is null) as nulls, count(*) = 4096 and count(v) = 4096 as complete from vox where var = 'p' group by t")
def completeness(spark, sf_dir):
    found = voxels(spark, sf_dir, ["p"]).groupBy("t").agg(F.lit(N**3).cast("long").alias("expected"), F.count("*").alias("found"), F.count(F.when(F.col("v").isNull(), 1)).alias("nulls"))
    return found.withColumn("complete", (F.col("expected") == F.col("found")) & (F.col("nulls") == 0))


@query(sql_interp("lag4", "field", ["p"]).replace(" select pid, round", ", o as (select pid, round", 1) + ") select pid, concat_ws(chr(9), '1.0', x::varchar, y::varchar, z::varchar, printf('%.6f', p)) as text from o join (select pid, printf('%.6f', x) as x, printf('%.6f', y) as y, printf('%.6f', z) as z from pts) using (pid)")
def tsv_rows(spark, sf_dir):
    """Lines of a result file; `write_tsv` writes them in order, with the description and header lines."""
    from eddymesh.sinks import tsv_lines

    p = points(spark, sf_dir)
    found = evaluate(p, None, "lag4", chunks=chunked(spark, sf_dir, ["p"])).select("pid", r6(F.col("c0_0")).alias("p"))
    return tsv_lines(p.join(found, "pid").withColumn("time", F.lit(1.0)), ["p"]).select("pid", "text")


# --- Demo points ---


@query("select i * 64 + k as pid, i * (25.0::double / 63) as x, 0.9::double as y, k * (9.0::double / 63) as z from range(0, 64) a(i), range(0, 64) b(k)")
def demo_plane_points(spark, sf_dir):
    return spark.range(0, 4096).select(F.col("id").alias("pid"), (F.expr("id div 64") * F.lit(25.0 / 63)).alias("x"), F.lit(0.9).alias("y"), ((F.col("id") % 64) * F.lit(9.0 / 63)).alias("z"))


@query("select (i * 16 + j) * 16 + k as pid, 0.1 + i * (1.5::double / 15) as x, -0.9::double + j * (1.8::double / 15) as y, k * (1.0::double / 15) as z from range(0, 16) a(i), range(0, 16) b(j), range(0, 16) c(k)")
def demo_box_points(spark, sf_dir):
    at = [F.expr("id div 256"), F.expr("id div 16") % 16, F.col("id") % 16]
    return spark.range(0, 4096).select(F.col("id").alias("pid"), (0.1 + at[0] * F.lit(1.5 / 15)).alias("x"), (F.lit(-0.9) + at[1] * F.lit(1.8 / 15)).alias("y"), (at[2] * F.lit(1.0 / 15)).alias("z"))


@query()
def demo_random_points(spark, sf_dir):
    low, high = (6.1359, -0.61359, 0.6), (21.8656, 0.8656, 8.8656)
    return spark.range(0, 1000).select(F.col("id").alias("pid"), *[(F.lit(lo) + F.rand(7 + k) * (hi - lo)).alias(a) for k, (a, lo, hi) in enumerate(zip("xyz", low, high))])


# --- Time ---


@query("select event_id, ((event_id % 97) / 97.0::double) / 0.075::double + 1 as position, floor(((event_id % 97) / 97.0::double) / 0.075::double + 1 + 0.5)::bigint as nearest, 0.075::double * (floor(((event_id % 97) / 97.0::double) / 0.075::double + 1 + 0.5)::bigint - 1) as nearest_time from events")
def time_index(spark, sf_dir):
    t = (F.col("event_id") % 97) / F.lit(97.0)
    near = temporal.time_index(t, 0.075, 1, False)
    return read(spark, sf_dir, "events").select("event_id", temporal.time_index(t, 0.075, 1, True).alias("position"), near.alias("nearest"), (F.lit(0.075) * (near - 1)).alias("nearest_time"))


PCHIP = " union all ".join(f"select pid, tau, floor(tau)::bigint + {k} as t, {horner(c, 'theta')} as w from a" for k, c in spline(1, 4).items())


@query(f"with {VOX}, {CELLS}, a as (select pid, tau, tau - floor(tau) as theta from (select pid, 1 + (pid % 97) / 97.0::double as tau from cells)), k as ({PCHIP}) select pid, tau, round(sum(w * v), 6) + 0.0 as p from k join cells using (pid) join vox using (ix, iy, iz, t) where var = 'p' group by pid, tau")
def pchip_time(spark, sf_dir):
    # Times lie between 0 and 2, so that no snapshot beyond 3 has a share.
    place = (F.col("iz") % CHUNK * CHUNK + F.col("iy") % CHUNK) * CHUNK + F.col("ix") % CHUNK
    code = pack(*[F.expr(f"i{a} div {CHUNK}") for a in "xyz"], bits=2)
    wanted = cells(spark, sf_dir).select("pid", code.alias("chunk_code"), place.alias("pos"), (1 + (F.col("pid") % 97) / F.lit(97.0)).alias("tau"))
    return temporal.in_time(wanted, stored_chunks(spark, sf_dir, ["p"], (0, 3))).select("pid", "tau", r6(F.col("value")).alias("p"))


_times = temporal.series(0.1, 0.5, 0.008)


@query(f"select k, t from {values([(k, t) for k, t in enumerate(_times)], 'k, t')}")
def time_series_expand(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(temporal.series(0.1, 0.5, 0.008))), "k long, t double")


_series = [(t,) for t in temporal.series(1.0, 1.9, 0.3)]


@query(
    f"with {VOX}, {PTS}, g as (select pid, floor(x)::bigint as ix, floor(y)::bigint as iy, floor(z)::bigint as iz, " + ", ".join(f"floor(100000 * ({a} - floor({a}))) / 100000.0::double as f{a}" for a in "xyz") + " from pts), "
    + ", ".join(f"t{a} as (" + " union all ".join(f"select pid, (i{a} + {x}) & 15 as j{a}, {horner(c, f'f{a}')} as w{a} from g" for x, c in field("lag4").items()) + ")" for a in "xyz")
    + f", s as (select pid, t, sum(wx * wy * wz * v) as v from tx join ty using (pid) join tz using (pid) join vox on ix = jx and iy = jy and iz = jz where var = 'p' and t <= 3 group by pid, t), a as (select tau, tau - floor(tau) as theta, 0 as pid from {values(_series, 'tau')}), k as ({PCHIP}) "
    "select s.pid, tau, round(sum(w * v), 6) + 0.0 as p from k join s using (t) group by s.pid, tau"
)
def time_series(spark, sf_dir):
    """The snapshots are components of one evaluation, so that every voxel and every point's stencil is read once; a
    known time is a weighted sum of them, without a join."""
    found = evaluate(points(spark, sf_dir), None, "lag4", components=4, chunks=snapshots(spark, sf_dir, "p", range(4)))
    rows = []
    for (tau,) in _series:
        below = math.floor(tau)
        shares = temporal.pchip_shares(tau - below)
        value = temporal.weighted([F.col(f"c{below + k}_0") for k in shares], list(shares.values()))
        rows.append(F.struct(F.lit(tau).alias("tau"), value.alias("p")))
    return found.select("pid", F.inline(F.array(*rows))).select("pid", "tau", r6(F.col("p")).alias("p"))


@query()
def particle_track(spark, sf_dir):
    out = temporal.track(points(spark, sf_dir), None, "lag4", 0.25, 2, chunks=chunked(spark, sf_dir, ["ux", "uy", "uz"]))
    return out.select("pid", *[r6(F.col(a)).alias(a) for a in "xyz"])


# --- Non-periodic z ---

LOW_PTS = f"{PTS}, low as (select pid, x, y, 0.5 + z * 15 / 16 as z from pts)"


def low_points(spark, sf_dir):
    return points(spark, sf_dir).withColumn("z", F.lit(0.5) + F.col("z") * 15 / 16)


def _route(method: str, variable: str) -> str:
    cases = [(m, *boundary.band(m, variable, N)) for m in [method, *boundary.STEPS[method]]]
    return "case " + " ".join(f"when z >= {a} and z < {b} then '{m}'" for m, a, b in cases) + " end"


@query(f"with {LOW_PTS} select pid, ((floor(z - 0.5)::bigint % 16) + 16) % 16 as iz_uv, ((floor(z - 1.0)::bigint % 16) + 16) % 16 as iz_w, floor(100000 * (z - 0.5 - floor(z - 0.5))) / 100000.0::double as fz_uv from low")
def staggered_grid_index(spark, sf_dir):
    from eddymesh.getdata import fraction, index

    z = F.col("z")
    return low_points(spark, sf_dir).select("pid", index(z, 1.0, -0.5, N, False).alias("iz_uv"), index(z, 1.0, -1.0, N, False).alias("iz_w"), fraction(z, 1.0, -0.5, True).alias("fz_uv"))


_routes = {"lag8_velocity": ("lag8", "velocity"), "lag8_pressure": ("lag8", "pressure"), "m2q8_energy": ("m2q8", "energy"), "fd8_g_velocity": ("fd8noint_g", "velocity"), "fd4lag4_l_pressure": ("fd4lag4_l", "pressure"), "m2q8_h_energy": ("m2q8_h", "energy")}


@query(f"with {LOW_PTS} select pid, " + ", ".join(f"{_route(*r)} as {n}" for n, r in _routes.items()) + " from low")
def sabl_stepdown(spark, sf_dir):
    return low_points(spark, sf_dir).select("pid", *[boundary.routed(F.col("z"), m, v, N).alias(n) for n, (m, v) in _routes.items()])


KINDS = ("uv", "w", "energy")


def _linear_field_sql(method: str = "lag4", node_sql: str = P_NODES, source: str = "low") -> str:
    xy = ", ".join(f"t{a} as (" + " union all ".join(f"select pid, (i{a} + {x}) & 15 as j{a}, {horner(c, f'f{a}')} as w{a} from g" for x, c in field(method).items()) + ")" for a in "xy")
    z = " union all ".join([
        "select pid, 'uv' as kind, floor(z - 0.5)::bigint & 15 as jz, 1 - (z - 0.5 - floor(z - 0.5)) as wz from g", "select pid, 'uv', (floor(z - 0.5)::bigint + 1) & 15, z - 0.5 - floor(z - 0.5) from g",
        "select pid, 'w', floor(z - 1)::bigint & 15, case when z < 1 then 0 else 1 - (z - floor(z)) end from g", "select pid, 'w', floor(z)::bigint & 15, z - floor(z) from g",
        "select pid, 'energy', (case when z < 1 then 0 else floor(z - 1)::bigint end) & 15, case when z < 1 then 1 else 1 - (z - floor(z)) end from g", "select pid, 'energy', floor(z)::bigint & 15, case when z < 1 then 0 else z - floor(z) end from g",
    ])
    return f"with {VOX}, {LOW_PTS}, {node_sql}, g as (select pid, z, floor(x)::bigint as ix, floor(y)::bigint as iy, " + ", ".join(f"floor(100000 * ({a} - floor({a}))) / 100000.0::double as f{a}" for a in "xy") + f" from {source}), {xy}, tz as ({z}) select pid, kind, round(sum(wx * wy * wz * c0), 6) + 0.0 as value from tx join ty using (pid) join tz using (pid) join nodes on ix = jx and iy = jy and iz = jz group by pid, kind"


def of_kinds(make) -> DataFrame:
    out = None
    for kind in KINDS:
        part = make(kind).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query(_linear_field_sql())
def sabl_linear_field(spark, sf_dir):
    p, own = low_points(spark, sf_dir), chunked(spark, sf_dir, ["p"])
    return of_kinds(lambda kind: boundary.linear_field(p, None, kind, "lag4", N, chunks=own)).select("pid", "kind", r6(F.col("c0_0")).alias("value"))


def _linear_sql(operator: str, order: int) -> str:
    """Base plane and taps of each kind of variable, by the bands of z, as plain rows."""
    hessian, count = operator == "hessian", {"gradient": 3, "laplacian": 1, "hessian": 6}[operator]
    bands = {
        "uv": [("z < 1", 0, 0, 1, 1), ("z >= 1 and z < 15", -1, 0, 2, 2), ("z >= 15", -2, 1, 1, 2)],
        "w": [("z < 1.5", 0, -1, 2, 2), ("z >= 1.5 and z < 15.5", -1, 0, 2, 2), ("z >= 15.5", -2, 1, 1, 2)],
        "energy": [("z < 1.5", 0, 0, 2, 1), ("z >= 1.5 and z < 15.5", -1, 0, 2, 2), ("z >= 15.5", -2, 1, 1, 2)],
    }
    if hessian:
        bands = {"uv": [("z < 1", 0, 0, 1, 2), ("z >= 1 and z < 15", -1, 0, 1, 2), ("z >= 15", -2, 0, 1, 2)], "w": [("z < 1.5", 0, -1, 0, 1), ("z >= 1.5 and z < 15.5", -1, 0, 1, 2), ("z >= 15.5", -2, 0, 1, 2)], "energy": [("z < 1.5", 0, 0, 0, 1), ("z >= 1.5 and z < 15.5", -1, 0, 1, 2), ("z >= 15.5", -2, 0, 1, 2)]}
    parts = []
    for kind, rows in bands.items():
        off = 0.5 if kind == "uv" else 1.0
        for when, shift, bottom, middle, top in rows:
            w = lambda **k: [float(k.get(f"w{j}", 0)) for j in range(count)]
            if hessian:
                tap = [(k, 0, 0, *w(w0=c[0])) for k, c in difference(2, order).items()] + [(0, k, 0, *w(w3=c[0])) for k, c in difference(2, order).items()]
                for k, c in zip(range(len(CORNERS[order]), 0, -1), CORNERS[order]):
                    tap += [(i, j, 0, *w(w1=c if i * j > 0 else -c)) for i in (k, -k) for j in (k, -k)]
                tap += [(0, 0, top, *w(w5=1)), (0, 0, middle, *w(w5=-2))] + [(s, 0, top, *w(w2=s / 4)) for s in (1, -1)] + [(0, s, top, *w(w4=s / 4)) for s in (1, -1)]
                if bottom >= 0:
                    tap += [(0, 0, bottom, *w(w5=1))] + [(s, 0, bottom, *w(w2=-s / 4)) for s in (1, -1)] + [(0, s, bottom, *w(w4=-s / 4)) for s in (1, -1)]
            else:
                lap = operator == "laplacian"
                kernel = difference(2 if lap else 1, order)
                tap = [(k, 0, 0, *w(w0=c[0])) for k, c in kernel.items()] + [(0, k, 0, *w(**{"w0" if lap else "w1": c[0]})) for k, c in kernel.items()]
                tap += [(0, 0, top, *w(**{"w0" if lap else "w2": 1 / middle}))] + ([(0, 0, bottom, *w(**{"w0" if lap else "w2": -1 / middle}))] if bottom >= 0 else [])
            k = values(tap, ", ".join(["dx", "dy", "dz", *[f"w{j}" for j in range(count)]]))
            parts.append(f"select pid, '{kind}' as kind, (floor(x + 0.5)::bigint + dx) & 15 as jx, (floor(y + 0.5)::bigint + dy) & 15 as jy, ((floor(z - {off} + 0.5)::bigint & 15) + {shift} + dz) & 15 as jz, {', '.join(f'w{j}' for j in range(count))} from low, {k} where {when}")
    columns = catalog.columns("pressure", operator) if operator != "laplacian" else ["grad2p"]
    return f"with {VOX}, {LOW_PTS}, {P_NODES}, k as ({' union all '.join(parts)}) select pid, kind, " + ", ".join(f"round(sum(w{j} * c0), 6) + 0.0 as {c}" for j, c in enumerate(columns)) + " from k join nodes on ix = jx and iy = jy and iz = jz group by pid, kind"


def _linear(operator: str, order: int, columns: list[str]):
    def run(spark, sf_dir):
        p, n = low_points(spark, sf_dir), nodes(spark, sf_dir, ["p"])
        found = of_kinds(lambda kind: boundary.linear_differences(p, n, kind, order, operator, N))
        return found.select("pid", "kind", *[r6(F.col(f"c0_{j}")).alias(c) for j, c in enumerate(columns)])

    return run


for _name, _operator, _order, _columns in (("sabl_linear_grad", "gradient", 4, catalog.columns("pressure", "gradient")), ("sabl_linear_lap", "laplacian", 6, ["grad2p"]), ("sabl_linear_hess", "hessian", 4, catalog.columns("pressure", "hessian"))):
    QUERIES[_name], SQL[_name] = _linear(_operator, _order, _columns), _linear_sql(_operator, _order)


def _velocity_sql() -> str:
    uv = sql_interp("lag4", "field", ["ux", "uy"], 2, z="z", off_z="-0.5", source="low", node_sql=U_NODES).replace(PTS, LOW_PTS)
    w = sql_interp("lag4", "field", ["uz"], 1, z="z", off_z="-1.0", source="low", node_sql="nodes as (select ix, iy, iz, v as c0 from vox where var = 'uz' and t = 0)").replace(PTS, LOW_PTS)
    return f"select * from ({uv}) join ({w}) using (pid)"


@query(_velocity_sql())
def sabl_velocity_merge(spark, sf_dir):
    found = boundary.velocity(low_points(spark, sf_dir), chunked(spark, sf_dir, ["ux", "uy"]), chunked(spark, sf_dir, ["uz"]), "lag4")
    return found.select("pid", *[r6(F.col(c)).alias(c) for c in ("ux", "uy", "uz")])


# --- Whole requests ---

#: Where the lattice's columns of a request's stored names lie.
LATTICE = {"pressure": "p", "velocity_x": "ux", "velocity_y": "uy", "velocity_z": "uz"}


def source(spark: SparkSession, sf_dir: str, periodic: bool = True, first: int = 1) -> requests.Source:
    """The lattice as the source of a request; first: the number of its first snapshot."""
    of = lambda own: [LATTICE[x] for x in own]
    return requests.Source(N, 1.0, periodic, lambda own, k: nodes(spark, sf_dir, of(own), k - first), lambda own, k: chunked(spark, sf_dir, of(own), k - first))


def _routed_sql(method: str, variable: str, columns: list[str], off_z: str, kind: str, node_sql: str) -> str:
    """Each point by its method, near the ground and the sky by the linear one; columns of one kind."""
    parts = []
    for m in [method, *boundary.STEPS[method]]:
        own = f"(select * from low where {_route(method, variable)} = '{m}')"
        if m == "linear":
            linear = []
            for k, c in enumerate(columns):
                one = f"{node_sql}, one as (select ix, iy, iz, c{k} as c0 from nodes)"
                linear.append("select pid, value as " + c + " from (" + _linear_field_sql(method, one, own).replace("join nodes on", "join one on") + f") where kind = '{kind}'")
            parts.append("select pid, " + ", ".join(columns) + f" from ({linear[0]})" + "".join(f" join ({x}) using (pid)" for x in linear[1:]))
        else:
            parts.append(f"select pid, {', '.join(columns)} from ({sql_interp(m, 'field', columns, len(columns), off_z=off_z, source=own, node_sql=node_sql).replace(PTS, LOW_PTS)})")
    return " union all ".join(parts)


PLACES = "round(x, 6) + 0.0 as x_point, round(y, 6) + 0.0 as y_point, round(z, 6) + 0.0 as z_point"


def named(found: DataFrame) -> DataFrame:
    return found.select("pid", "time", *[r6(F.col(c)).alias(c) for c in found.columns[2:]])


@query(f"with {LOW_PTS} select pid, 1.0::double as time, {PLACES}, p from low join ({_routed_sql('lag8', 'pressure', ['p'], '-0.5', 'uv', P_NODES)}) using (pid)")
def get_data_sabl_pressure(spark, sf_dir):
    return named(requests.get_data(source(spark, sf_dir, False), "sabl2048low", "pressure", 1, "lag8", "field", low_points(spark, sf_dir), limited=False).withColumn("time", F.col("time").cast("double")))


W_NODES = "nodes as (select ix, iy, iz, v as c0 from vox where var = 'uz' and t = 0)"


@query(f"with {LOW_PTS} select pid, 1.0::double as time, {PLACES}, ux, uy, uz from low join ({_routed_sql('lag6', 'velocity', ['ux', 'uy'], '-0.5', 'uv', U_NODES)}) using (pid) join ({_routed_sql('lag6', 'velocity', ['uz'], '-1.0', 'w', W_NODES)}) using (pid)")
def get_data_sabl_velocity(spark, sf_dir):
    return named(requests.get_data(source(spark, sf_dir, False), "sabl2048low", "velocity", 1, "lag6", "field", low_points(spark, sf_dir), limited=False).withColumn("time", F.col("time").cast("double")))


_wanted = [(t, t / 0.002) for t in temporal.series(0.0026, 0.0032, 0.0002)]
_lag4_in_time = SQL["time_series"].split(", a as (select tau")[0]


@query(
    _lag4_in_time + f", w as (select time, tau from {values(_wanted, 'time, tau')}), a as (select tau, tau - floor(tau) as theta, 0 as pid from w), k as ({PCHIP}) "
    f"select s.pid, time, {PLACES}, round(sum(w * v), 6) + 0.0 as p from k join w using (tau) join s using (t) join pts on pts.pid = s.pid group by s.pid, time, x, y, z"
)
def get_data_pchip_series(spark, sf_dir):
    return named(requests.get_data(source(spark, sf_dir, first=0), "isotropic1024coarse", "pressure", 0.0026, "lag4", "field", points(spark, sf_dir), "pchip", 0.0032, 0.0002, limited=False))


@query(
    f"with {VOX}, {U_NODES} select rx::double as x, ry::double as y, rz::double as z, rx + 1 as i, ry + 1 as j, rz + 1 as k, round(c0, 6) + 0.0 as ux, round(c1, 6) + 0.0 as uy, round(c2, 6) + 0.0 as uz "
    "from nodes join range(10, 41) a(rx) on ((rx % 16) + 16) % 16 = ix join range(0, 8, 2) b(ry) on ry = iy join range(-4, 18, 3) c(rz) on ((rz % 16) + 16) % 16 = iz"
)
def get_cutout_strided_tile(spark, sf_dir):
    found = requests.get_cutout(source(spark, sf_dir), "isotropic8192", "velocity", 1, [(11, 41), (1, 8), (-3, 18)], (1, 2, 3))
    return found.select("x", "y", "z", "i", "j", "k", *[r6(F.col(c)).alias(c) for c in ("ux", "uy", "uz")])
