"""How many rows queries make of their points: one each, whatever the width of a kernel or the number of snapshots."""

import re

import pytest
from pyspark.sql import functions as F

from eddymesh import getdata, lattice
from eddymesh.getdata import evaluate

SCATTERED = "id as pid, (id * 37 % 97) / 6.1D as x, (id * 11 % 89) / 5.7D as y, (id * 5 % 83) / 5.3D as z"


def exploded(df):
    """What a plan explodes, without arrays of the runs and of the chunks around one."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in re.findall(r"Generate (\w+)\((.{0,60})", plan) if not re.match(r"sequence|runs|\[\[-?\d,-?\d,-?\d\],", x[1])]


@pytest.mark.parametrize("method, operator", [("fd4noint", "gradient"), ("fd6noint", "gradient"), ("fd4noint", "laplacian"), ("fd6noint", "laplacian"), ("fd8noint", "laplacian"), ("fd8noint", "gradient"), ("fd4noint", "hessian")])
def test_differences_make_no_row_for_a_tap(spark, sf, monkeypatch, method, operator):
    p, u = spark.sql(f"select {SCATTERED} from range(300)"), ["ux", "uy", "uz"]
    df = evaluate(p, None, method, operator, 3, chunks=lattice.chunked(spark, sf, u))
    assert not exploded(df)
    found = {r.pid: r[1:] for r in df.collect()}
    monkeypatch.setattr(getdata, "WIDE", 99)
    joined = evaluate(p, lattice.nodes(spark, sf, u), method, operator, 3).collect()
    assert len(found) == len(joined) == 300
    for r in joined:
        assert found[r.pid] == pytest.approx(r[1:], abs=1e-12)


def test_nodes_that_are_absent_or_null_add_nothing(spark, sf, monkeypatch):
    p = spark.sql(f"select {SCATTERED} from range(300)")
    holes = F.transform("v0", lambda v, i: F.when(i % 5 > 0, v))
    chunks = lattice.chunked(spark, sf, ["p"]).where("cx + cy + cz != 4").select("cx", "cy", "cz", F.when(F.col("cx") != 2, holes).alias("v0"))
    found = {r.pid: r.c0_0 for r in evaluate(p, None, "fd4noint", "laplacian", chunks=chunks).collect()}
    monkeypatch.setattr(getdata, "WIDE", 99)
    joined = {r.pid: r.c0_0 for r in evaluate(p, lattice.out_of_chunks(chunks, 1), "fd4noint", "laplacian").collect()}
    assert any(v is not None for v in joined.values())
    for pid, v in found.items():
        assert v is None and joined.get(pid) is None or v == pytest.approx(joined[pid], abs=1e-12)


def generators(df):
    """Generators of a plan, without the one that deals out runs and without inlined arrays of structs."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in re.findall(r"Generate (\w+\(.{0,30})", plan) if not re.match(r"inline|explode\(sequence", x)]


@pytest.mark.parametrize("name", ["get_data_sabl_velocity", "pchip_time", "sabl_velocity_merge", "time_series"])
def test_queries_make_no_row_for_a_node(spark, sf, name):
    from eddymesh.queries import QUERIES

    assert generators(QUERIES[name](spark, sf)) == []


@pytest.mark.parametrize("name", ["get_data_pchip_series", "get_data_sabl_pressure"])
def test_jobs_over_whole_tables_are_no_single_calls(spark, sf, monkeypatch, name):
    from eddymesh import catalog, queries, requests

    monkeypatch.setattr(catalog, "MAX_POINTS", 100)
    assert queries.QUERIES[name](spark, sf).select("pid").distinct().count() == 1500
    with pytest.raises(ValueError, match="more than 100"):
        requests.get_data(queries.source(spark, sf), "isotropic8192", "pressure", 1, "lag4", "field", queries.points(spark, sf))


def test_tracks_by_chunk_are_those_of_the_stencil_join(spark, sf, monkeypatch):
    from eddymesh import temporal

    u = ["ux", "uy", "uz"]
    p = spark.sql(f"select {SCATTERED} from range(50)")
    found = {r.pid: r[1:] for r in temporal.track(p, None, "lag4", 0.25, 1, chunks=lattice.chunked(spark, sf, u)).collect()}
    half = {r.pid: r[1:] for r in evaluate(p, lattice.nodes(spark, sf, u), "lag4", "field", 3, quantize=False).collect()}
    moved = spark.createDataFrame([(r.pid, *[a + 0.125 * v for a, v in zip(r[1:], half[r.pid])]) for r in p.collect()], "pid long, x double, y double, z double")
    for r in evaluate(moved, lattice.nodes(spark, sf, u), "lag4", "field", 3, quantize=False).collect():
        start = next(q for q in p.collect() if q.pid == r.pid) if r.pid % 10 == 0 else None
        assert start is None or found[r.pid] == pytest.approx([a + 0.25 * v for a, v in zip(start[1:], r[1:])], abs=1e-12)


def test_the_first_kind_of_velocities_is_evaluated_once(spark, sf):
    from eddymesh.queries import QUERIES

    plan = QUERIES["sabl_velocity_merge"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 2


@pytest.mark.parametrize("name", ["grad_fd8", "grad_fd6", "lap_fd4", "lap_fd6", "lap_fd8", "hess_fd4", "time_series"])
def test_a_point_is_one_row_until_it_has_its_values(spark, sf, name):
    from eddymesh.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1
    assert not re.search(r"Generate explode\((?!sequence)", plan)


@pytest.mark.parametrize("name", ["grad_fd8", "hess_fd4", "time_series", "lap_fd8", "lap_fd6", "lap_fd4", "grad_fd6"])
def test_points_are_read_twice_and_dealt_out_once(spark, sf, name):
    """Once for the count, which both of its uses share, and once for the values, by a join that moves no point."""
    from eddymesh.queries import QUERIES

    df = QUERIES[name](spark, sf)
    assert df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("FileScan parquet [o_orderkey") <= 2 and "ReusedExchange" in ran
    assert re.search(r"Join LeftOuter.*strategy=broadcast", df._jdf.queryExecution().optimizedPlan().toString())


def test_values_are_rounded_as_duckdb_does(spark):
    import duckdb
    import numpy as np

    from eddymesh.queries import r6

    v = [-0.0642285, 0.5221775, -1.3211695, 2.5e-6, -2.5e-6, 0.49999999999999994e-6, 1e305, -1e305, 3e38, 0.1 + 0.2, -0.0, 1e-9, float("inf")]
    want = [r[0] for r in duckdb.sql("select round(v, 6) + 0.0 from (values " + ", ".join(f"({k}, '{x!r}'::double)" for k, x in enumerate(v)) + ") t(k, v) order by k").fetchall()]
    assert getdata.rounded(np.array(v), 6).tolist() == want
    assert [r.v for r in spark.createDataFrame([(x,) for x in v], "v double").select(r6(F.col("v")).alias("v")).collect()] == want
    assert want != [r.v for r in spark.createDataFrame([(x,) for x in v], "v double").select(F.round("v", 6).alias("v")).collect()]


@pytest.mark.parametrize("name", ["grad_fd6", "hess_fd4"])
def test_values_that_are_no_numbers_are_the_sqls(spark, sf, tmp_path, name):
    import duckdb

    from eddymesh.queries import QUERIES, SQL

    spark.read.parquet(f"{sf}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    odd = F.when(F.col("vec_id") % 64 == 5, F.lit(float("nan"))).when(F.col("vec_id") % 64 == 40, F.lit(float("inf")))
    vals = F.transform("embedding", lambda v, i: F.when((i == 21) & odd.isNotNull(), odd.cast("float")).otherwise(v))
    spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("embedding", vals).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("orders", "embeddings"):
        con.execute(f"create view {t} as from '{tmp_path}/{t}.parquet/*.parquet'")
    shown = lambda rows: sorted(tuple(map(str, r)) for r in rows)  # noqa: E731 (nan equals nothing)
    want = shown(con.execute(SQL[name]).fetchall())
    assert any("nan" in r for r in want)
    assert shown(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == want
