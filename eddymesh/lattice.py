"""The voxel lattice and the points, from the driver's tables; Morton codes; chunks with those around them.

A row of `embeddings` is one 4**3 chunk, 64 chunks (by Morton code) make a 16**3 periodic block, 8 chunks one file.
Blocks 0, 1, 2 are ux, uy, uz at time 0, block b from 3 on is the pressure at time b - 3. The same code takes any chunk
edge that is a power of two.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edge of a chunk and of the lattice, and bits of a Morton code per axis.
CHUNK, N, BITS = 4, 16, 4


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """Morton code: the bits of x, y and z interleaved, x lowest."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        for k, c in enumerate((x, y, z)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), 3 * i + k))
    return out


def unpack(code: Column, k: int, bits: int = BITS) -> Column:
    """Coordinate k (0: x) of a Morton code."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(code.cast("long"), 3 * i + k).bitwiseAND(F.lit(1).cast("long")), i))
    return out


#: Blocks of each variable: the first, and how many snapshots there are (None: all from there on).
BLOCKS = {"ux": (0, 1), "uy": (1, 1), "uz": (2, 1), "p": (3, None)}
#: Up to so many chunks are named to the scan one by one.
NAMED = 1_000


def stored_chunks(spark: SparkSession, sf_dir: str, variables: list[str] | None = None, t: int | tuple[int, int] | None = None, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """var, t, chunk_code and vals of the chunks of some variables, one snapshot or a first and last one, and a box
    (0-based inclusive ranges inside the lattice); all conditions are ranges or lists of the stored key, which the scan
    uses to skip row groups."""
    rows = read(spark, sf_dir, "embeddings")
    first, last = (t, t) if isinstance(t, int) else t or (0, None)
    codes = None if ranges is None else chunk_codes(ranges)
    wanted, spans = None, []
    for v in variables or BLOCKS:
        low, count = BLOCKS[v]
        end = None if count is None and last is None else low + min(x for x in (count, None if last is None else last + 1) if x is not None)
        spans.append((low + first, end))
        if codes is not None and end is not None and len(codes) * (end - low - first) <= NAMED:
            wanted = [*(wanted or []), *(b * 64 + c for b in range(low + first, end) for c in codes)]
    bounds = [F.col("vec_id") >= lo * 64 if end is None else F.col("vec_id").between(lo * 64, end * 64 - 1) for lo, end in spans if end is None or end > lo]
    keep = F.lit(False)
    for bound in bounds:
        keep = bound if len(bounds) == 1 else keep | bound
    rows = rows.where(keep)
    if wanted is not None and len(wanted) <= NAMED and all(end is not None for _, end in spans):
        rows = rows.where(F.col("vec_id").isin(wanted))
    return rows.select(
        F.expr("case vec_id div 64 when 0 then 'ux' when 1 then 'uy' when 2 then 'uz' else 'p' end").alias("var"),
        F.greatest(F.expr("vec_id div 64") - 3, F.lit(0)).cast("long").alias("t"),
        (F.col("vec_id") % 64).alias("chunk_code"),
        F.col("embedding").alias("vals"),
    )


def chunk_codes(ranges: list[tuple[int, int]]) -> list[int]:
    """Codes of the chunks that a box touches."""
    out = []
    for x, y, z in itertools.product(*[range(lo // CHUNK, hi // CHUNK + 1) for lo, hi in ranges]):
        out.append(sum((c >> i & 1) << (3 * i + k) for i in range(BITS) for k, c in enumerate((x, y, z))))
    return sorted(out)


def voxels(spark: SparkSession, sf_dir: str, variables: list[str] | None = None, t: int | tuple[int, int] | None = None, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """var, t, chunk_code, ix, iy, iz, v: a row for each voxel of the chunks that `stored_chunks` finds."""
    chunks = stored_chunks(spark, sf_dir, variables, t, ranges).select("var", "t", "chunk_code", F.posexplode("vals").alias("pos", "e"))
    bits = 2  # of a chunk's place in the block, and of a voxel's in the chunk
    place = lambda k: unpack(F.col("chunk_code"), k, bits) * CHUNK
    return chunks.select(
        "var",
        "t",
        "chunk_code",
        (place(0) + F.col("pos") % 4).cast("long").alias("ix"),
        (place(1) + F.expr("pos div 4") % 4).cast("long").alias("iy"),
        (place(2) + F.expr("pos div 16")).cast("long").alias("iz"),
        F.col("e").cast("double").alias("v"),
    )


def nodes(spark: SparkSession, sf_dir: str, variables: list[str], t: int = 0) -> DataFrame:
    """ix, iy, iz and a column c0, c1, ... for each variable, at one time."""
    if len(variables) == 1:
        return voxels(spark, sf_dir, variables, t).select("ix", "iy", "iz", F.col("v").alias("c0"))
    return out_of_chunks(chunked(spark, sf_dir, variables, t), len(variables))


def snapshots(spark: SparkSession, sf_dir: str, variable: str, times: range) -> DataFrame:
    """cx, cy, cz (of a chunk) and v0, v1, ... (its values) for each of some snapshots of a variable."""
    rows = stored_chunks(spark, sf_dir, [variable], (times[0], times[-1]))
    vals = F.col("vals").cast("array<double>")
    own = rows.groupBy("chunk_code").agg(*[F.max(F.when(F.col("t") == t, vals)).alias(f"v{k}") for k, t in enumerate(times)])
    place = [unpack(F.col("chunk_code"), k, 2).cast("long").alias(f"c{a}") for k, a in enumerate("xyz")]
    return own.select(*place, *[f"v{k}" for k in range(len(times))])


def out_of_chunks(chunks: DataFrame, components: int) -> DataFrame:
    """ix, iy, iz and c0, c1, ... of chunks(cx, cy, cz, v0, v1, ...): columns are matched by chunk, before voxels are
    rows."""
    zipped = F.arrays_zip(*[F.coalesce(F.col(f"v{k}"), F.array()).alias(f"v{k}") for k in range(components)])
    rows = chunks.select("cx", "cy", "cz", F.posexplode(zipped).alias("pos", "at"))
    inside = {"x": F.col("pos") % CHUNK, "y": F.expr(f"pos div {CHUNK}") % CHUNK, "z": F.expr(f"pos div {CHUNK * CHUNK}")}
    return rows.select(*[(F.col(f"c{a}") * CHUNK + inside[a]).cast("long").alias(f"i{a}") for a in "xyz"], *[F.col(f"at.v{k}").cast("double").alias(f"c{k}") for k in range(components)])


def chunked(spark: SparkSession, sf_dir: str, variables: list[str], t: int = 0) -> DataFrame:
    """cx, cy, cz (of a chunk) and v0, v1, ... (its values, x fastest) for each variable, at one time."""
    rows = stored_chunks(spark, sf_dir, variables, t)
    place = [unpack(F.col("chunk_code"), k, 2).cast("long").alias(f"c{a}") for k, a in enumerate("xyz")]
    vals = F.col("vals").cast("array<double>")
    if len(variables) == 1:
        return rows.select(*place, vals.alias("v0"))
    own = rows.groupBy("chunk_code").agg(*[F.max(F.when(F.col("var") == v, vals)).alias(f"v{k}") for k, v in enumerate(variables)])
    return own.select(*place, *[f"v{k}" for k in range(len(variables))])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, x, y, z in [0, 16), a point for each order."""
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as pid",
        "((o_orderkey * 37) % 1552) / 97.0D as x",
        "((o_custkey * 53 + o_orderkey * 5) % 1552) / 97.0D as y",
        "((o_orderkey * 29 + o_custkey * 7) % 1552) / 97.0D as z",
    )


def into_chunks(nodes: DataFrame, components: int, chunk: int = CHUNK) -> DataFrame:
    """cx, cy, cz and v0, v1, ... of nodes(ix, iy, iz, c0, ...), for lattices that aren't stored by chunk."""
    place = (F.col("iz") % chunk * chunk + F.col("iy") % chunk) * chunk + F.col("ix") % chunk
    rows = nodes.select(*[F.expr(f"i{a} div {chunk}").alias(f"c{a}") for a in "xyz"], F.struct(place.alias("at"), *[f"c{k}" for k in range(components)]).alias("voxel"))
    own = rows.groupBy("cx", "cy", "cz").agg(F.array_sort(F.collect_list("voxel")).alias("all"))
    return own.select("cx", "cy", "cz", *[F.col(f"all.c{k}").alias(f"v{k}") for k in range(components)])


def around(wanted: DataFrame, chunks: DataFrame, below: int, above: int, components: int, chunk: int = CHUNK, n: int = N) -> DataFrame:
    """For each wanted chunk the chunks around it (periodic) that its halo reaches, itself too: the columns of wanted,
    rx, ry, rz (how many chunks away) and v0, v1, ... Chunks without points near them aren't passed on."""
    reach = range(-((below + chunk - 1) // chunk), (above + chunk - 1) // chunk + 1)
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"r{a}") for a, v in zip("xyz", r)]) for r in itertools.product(reach, repeat=3)])
    out = wanted.select("*", F.inline(steps))
    for a in "xyz":
        out = out.withColumn(f"n{a}", F.pmod(F.col(f"c{a}") + F.col(f"r{a}"), F.lit(n // chunk)).cast("long"))
    others = chunks.select(*[F.col(f"c{a}").alias(f"n{a}") for a in "xyz"], *[f"v{k}" for k in range(components)])
    return out.join(others, ["nx", "ny", "nz"]).drop("nx", "ny", "nz")
