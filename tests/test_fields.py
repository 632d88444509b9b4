"""Properties of kernels, point queries, time, catalogs and sinks that need no reference values."""

import itertools
import math
from fractions import Fraction as Q

import pytest
from pyspark.sql import functions as F

from eddymesh import boundary, catalog, cutout, lattice, sinks, temporal, weights
from eddymesh.getdata import evaluate

AT = [Q(0), Q(1, 7), Q(37, 100), Q(99, 100)]


def apply(kernel, at, f):
    return sum(sum(c * at**k for k, c in enumerate(p)) * f(Q(x)) for x, p in kernel.items())


@pytest.mark.parametrize("method, degree", [("lag4", 3), ("lag6", 5), ("lag8", 7), ("m1q4", 2), ("m2q8", 5), ("m2q14", 5), ("fd4lag4", 3)])
def test_kernels_reproduce_polynomials(method, degree):
    kernels = weights.axis(method)
    for at, p in itertools.product(AT, range(degree + 1)):
        assert apply(kernels["w"], at, lambda x: x**p) == at**p
        if method[0] == "m" or p < 4 and method == "fd4lag4":
            assert apply(kernels["d"], at, lambda x: x**p) == (p * at ** (p - 1) if p else 0)


@pytest.mark.parametrize("order", [4, 6, 8])
def test_differences_are_exact_to_their_order(order):
    for p in range(order + 1):
        assert apply(weights.difference(1, order), Q(0), lambda x: x**p) == (p == 1)
    for p in range(order if order < 8 else 7):
        assert apply(weights.difference(2, order), Q(0), lambda x: x**p) == (2 if p == 2 else 0)
    mixed = [(x, y, w[1]) for x, y, z, w in weights.taps(f"fd{order}noint", "hessian") if w[1]]
    assert sum(w * x * y for x, y, w in mixed) == pytest.approx(1) and sum(w * x**3 * y for x, y, w in mixed) == pytest.approx(0)


def wave(spark):
    """A periodic field sin(2 pi x / 16) + cos(4 pi y / 16) * sin(2 pi z / 16)."""
    r = spark.range(0, 4096).select((F.col("id") % 16).alias("ix"), (F.expr("id div 16") % 16).alias("iy"), F.expr("id div 256").alias("iz"))
    k = 2 * math.pi / 16
    return r.withColumn("c0", F.sin(F.col("ix") * k) + F.cos(F.col("iy") * 2 * k) * F.sin(F.col("iz") * k))


POINTS = [(0, 1.3, 2.7, 15.9), (1, 15.99, 0.0, 8.5), (2, 5.0, 6.0, 7.0), (3, 5.0 + 16, 6.0 - 16, 7.0), (4, 3.999, 4.001, 3.5)]


@pytest.mark.parametrize("method", ["lag4", "lag6", "lag8", "m1q4", "m2q8", "m2q14", "none"])
def test_field(spark, method):
    p = spark.createDataFrame(POINTS, "pid long, x double, y double, z double")
    got = {r.pid: r.c0_0 for r in evaluate(p, wave(spark), method, quantize=False).collect()}
    k = 2 * math.pi / 16
    exact = lambda x, y, z: math.sin(k * x) + math.cos(2 * k * y) * math.sin(k * z)
    for pid, x, y, z in POINTS:
        want = exact(*(math.floor(v + 0.5) for v in (x, y, z))) if method == "none" else exact(x, y, z)
        assert got[pid] == pytest.approx(want, abs=0.03 if method in ("lag4", "m1q4") else 0.004)
    assert got[2] == pytest.approx(got[3], abs=1e-12) and got[2] == pytest.approx(exact(5, 6, 7), abs=1e-12)


@pytest.mark.parametrize("method, operator", [("fd8noint", "gradient"), ("m2q8", "gradient"), ("fd4lag4", "gradient"), ("m2q8", "hessian"), ("fd8noint", "hessian"), ("fd6noint", "laplacian"), ("fd4lag4", "laplacian")])
def test_derivatives(spark, method, operator):
    p = spark.createDataFrame(POINTS, "pid long, x double, y double, z double")
    spacing = (0.5, 0.5, 0.5)
    scaled = p.select("pid", *[(F.col(a) * 0.5).alias(a) for a in "xyz"])
    k = 2 * math.pi / 8
    for r in evaluate(scaled, wave(spark), method, operator, spacing=spacing, quantize=False).collect():
        x, y, z = POINTS[r.pid][1:]
        if method.endswith("noint"):
            x, y, z = (math.floor(v + 0.5) for v in (x, y, z))
        x, y, z = x / 2, y / 2, z / 2
        sx, cx, sy, cy, sz, cz = math.sin(k * x), math.cos(k * x), math.sin(2 * k * y), math.cos(2 * k * y), math.sin(k * z), math.cos(k * z)
        want = {
            "gradient": [k * cx, -2 * k * sy * sz, k * cy * cz],
            "hessian": [-k * k * sx, 0, 0, -4 * k * k * cy * sz, -2 * k * k * sy * cz, -k * k * cy * sz],
            "laplacian": [-k * k * sx - 5 * k * k * cy * sz],
        }[operator]
        assert [r[f"c0_{j}"] for j in range(len(want))] == pytest.approx(want, abs=0.08)


def test_wide_path_equals_stencil_join(spark, monkeypatch):
    from eddymesh import getdata

    p = spark.range(0, 300).selectExpr("id as pid", "(id * 37 % 97) / 6.1D as x", "(id * 11 % 89) / 5.7D as y", "(id * 5 % 83) / 5.3D as z")
    wide = {r.pid: r[1] for r in evaluate(p, wave(spark), "lag6").collect()}
    monkeypatch.setattr(getdata, "WIDE", 99)
    for r in evaluate(p, wave(spark), "lag6").collect():
        assert r[1] == pytest.approx(wide[r.pid], abs=1e-12)
    monkeypatch.setattr(getdata, "WIDE", 2)
    monkeypatch.setattr(getdata, "RUN", 3)
    narrow = {r.pid: r[1] for r in evaluate(p, wave(spark), "lag4").collect()}
    monkeypatch.undo()
    for r in evaluate(p, wave(spark), "lag4").collect():
        assert r[1] == pytest.approx(narrow[r.pid], abs=1e-12)


def test_morton_codes_round_trip(spark):
    r = spark.range(0, 4096).select("id", *[lattice.unpack(F.col("id"), k).alias(a) for k, a in enumerate("xyz")])
    assert r.where(lattice.pack(F.col("x"), F.col("y"), F.col("z")) != F.col("id")).count() == 0


@pytest.mark.parametrize("variable", ["velocity", "pressure", "energy"])
def test_bands_give_each_point_one_method(spark, variable):
    z = [0.0, 0.5, 1.49, 1.5, 2.0, 2.5, 3.0, 3.5, 3.999, 4.0, 4.5, 8.0, 11.0, 12.0, 12.5, 13.0, 14.0, 15.5, 15.999]
    for method in boundary.STEPS:
        rows = spark.createDataFrame([(v,) for v in z], "z double").select("z", boundary.routed(F.col("z"), method, variable, 16).alias("m")).collect()
        for r in rows:
            low, high = boundary.band(r.m, variable, 16)
            assert low <= r.z < high
            order = [method, *boundary.STEPS[method]]
            assert all(not b[0] <= r.z < b[1] for b in (boundary.band(m, variable, 16) for m in order[: order.index(r.m)]))
    assert boundary.band("lag8", "velocity", 2048) == (4.0, 2044.5) and boundary.band("fd8noint_g", "energy", 2048) == (4.5, 2043.5)


def test_series():
    assert len(temporal.series(0.1, 0.5, 0.008)) == 51 and temporal.series(0.1, 0.5, 0.008)[-1] == 0.5
    assert temporal.series(1, 4, 2) == [1, 3] and temporal.series(1, 5, 2) == [1, 3, 5]


def test_particles_follow_a_uniform_flow(spark):
    still = wave(spark).select("ix", "iy", "iz", F.lit(1.0).alias("c0"), F.lit(-0.5).alias("c1"), F.lit(0.0).alias("c2"))
    p = spark.createDataFrame(POINTS[:3], "pid long, x double, y double, z double")
    for r in temporal.track(p, still, "lag4", 0.5, 3).collect():
        _, x, y, z = POINTS[r.pid]
        assert (r.x, r.y, r.z) == pytest.approx((x + 1.5, y - 0.75, z))


GOOD = ("channel", "velocity", 1.0, "lag8", "field")


@pytest.mark.parametrize(
    "request_, options",
    [
        (("nowhere", *GOOD[1:]), {}), (("channel", "energy", *GOOD[2:]), {}), (("channel", "velocity", 99.0, "lag8", "field"), {}), (("isotropic8192", "velocity", 1.5, "lag8", "field"), {}),
        (("channel", "pressure", 1.0, "fd4noint", "laplacian"), {}), (("sabl2048low", "velocity", 1, "none", "field"), {}), (("isotropic8192", "velocity", 1, "m2q14", "field"), {}),
        (("channel5200", "velocity", 1, "lag8", "field"), {"temporal": "pchip"}), (GOOD, {"end": 2.0}), (GOOD, {"end": 1.1, "step": 0.2}), (("channel", "position", 1, "", ""), {"cutout": True}),
    ],
)
def test_bad_requests(request_, options):
    with pytest.raises(ValueError):
        catalog.check(*request_, **options)


def test_good_requests():
    catalog.check(*GOOD, temporal="pchip", end=1.2, step=0.1)
    catalog.check("channel", "position", 0.1, "lag6", "field", "pchip", end=0.3, step=0.1)
    for rest in ((), ("none",), ("none", False, 0.3, 0.1), ("pchip",)):  # positions are interpolated in time, over a span
        with pytest.raises(ValueError):
            catalog.check("channel", "position", 0.1, "lag6", "field", *rest)
    for title, variable, operator, method in catalog.capabilities():
        if variable != "position":
            catalog.check(title, variable, catalog.dataset(title)[5][0], method, operator)
    catalog.check_box("channel", [(1, 4), (1, 32), (-5, 3000)], [1, 2, 3], 3)
    for ranges, strides in (([(4, 1), (1, 2), (1, 2)], [1, 1, 1]), ([(1, 2), (0, 2), (1, 2)], [1, 1, 1]), ([(1, 2), (1, 2), (1, 2)], [0, 1, 1]), ([(1, 10**5), (1, 512), (1, 10**5)], [9, 9, 9]), ([(1.0, 2), (1, 2), (1, 2)], [1, 1, 1])):
        with pytest.raises(ValueError):
            catalog.check_box("channel", ranges, strides)
    assert catalog.columns("velocity", "gradient")[1] == "duxdy" and catalog.columns("pressure", "hessian")[2] == "d2pdxdz"


def test_completeness(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "pid long, v double")
    with pytest.raises(ValueError):
        cutout.assert_complete(df, 2, ["v"])
    assert cutout.assert_complete(df.dropna(), 1, ["v"]).count() == 1


def scans(df):
    """The conditions that the Parquet readers of a query get."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.split("PushedFilters: ")[1].split("], ReadSchema")[0] for x in plan.split("\n") if "PushedFilters: " in x and "embedding" in x]


def test_filters_reach_the_scan(spark, sf):
    from eddymesh.queries import QUERIES

    # 36 chunks of a box in each of four blocks, named one by one or by their span.
    box = scans(lattice.voxels(spark, sf, ["p"], 0, [(2, 9), (0, 11), (5, 14)]))
    assert box and all("In(vec_id" in x and "GreaterThanOrEqual(vec_id,192)" in x for x in box)
    for name in ("cutout_box", "interp_lag8", "plane_slice", "visitor_points"):
        found = scans(QUERIES[name](spark, sf))
        assert found and all("vec_id" in x for x in found), name
    assert "label" not in lattice.voxels(spark, sf)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]


def test_one_point_meets_the_chunks_around_it(spark, sf):
    one = spark.createDataFrame([(0, 1, 2)], "cx long, cy long, cz long")
    chunks = lattice.chunked(spark, sf, ["p"])
    assert lattice.around(one, chunks, 3, 4, 1).count() == 27
    plan = evaluate(spark.createDataFrame([(1, 1.5, 2.5, 3.5)], "pid long, x double, y double, z double"), None, "lag8", chunks=chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan  # no voxel rows


def test_requests_are_checked(spark, sf):
    from eddymesh import queries, requests

    at = queries.source(spark, sf, False)
    far = spark.createDataFrame([(1, 1.0, 1.0, 400.0)], "pid long, x double, y double, z double")
    with pytest.raises(ValueError, match="z of a point"):
        requests.get_data(at, "sabl2048low", "pressure", 1, "lag8", "field", far)
    catalog.check_points("isotropic8192", far)
    with pytest.raises(ValueError):
        requests.get_data(at, "sabl2048low", "pressure", 1, "lag12", "field", far)
    with pytest.raises(ValueError):
        requests.get_cutout(at, "channel", "velocity", 1, [(1, 4), (0, 4), (1, 4)])
    none = requests.get_data(at, "sabl2048low", "pressure", 1, "lag4", "field", far.limit(0))
    assert none.count() == 0 and none.columns == ["pid", "time", "x_point", "y_point", "z_point", "p"]


@pytest.mark.parametrize("operator, method", [("gradient", "fd6noint"), ("gradient", "fd4noint"), ("gradient", "m2q8"), ("hessian", "fd6noint"), ("laplacian", "fd4noint"), ("laplacian", "fd4lag4")])
def test_each_method_is_routed_near_the_ground(spark, sf, operator, method):
    from eddymesh import queries, requests

    variable = "velocity" if operator == "laplacian" else "pressure"
    low = queries.low_points(spark, sf).where("pid % 10 = 0")
    found = requests.get_data(queries.source(spark, sf, False), "sabl2048low", variable, 1, method, operator, low)
    assert found.columns[5:] == catalog.columns(variable, operator)
    rows = found.collect()
    assert len(rows) == len({r.pid for r in rows}) == low.count() and all(v is not None and math.isfinite(v) for r in rows for v in r)


def test_coordinates_of_axes(spark):
    from eddymesh import requests

    at = lambda *a, **k: [round(r.coordinate, 7) for r in requests.axis_coordinates(*a, spark, **k).collect()]
    assert at("sabl2048low", "z", 1, 5, 2, "velocity_w") == [0.1953125, 0.5859375, 0.9765625]
    assert at("transition_bl", "x", 1, 2, 1, "pressure") == [30.2185, 30.5107105]
    grid = spark.createDataFrame([(1, -1.0), (2, -0.99)], "i long, coordinate double")
    assert sorted(at("channel", "y", 1, 2, 1, "pressure", grid=grid)) == [-1.0, -0.99]
    with pytest.raises(ValueError, match="irregular"):
        at("channel", "y", 1, 2, 1, "pressure")


def test_sinks(spark, tmp_path):
    rows = [(t, p, 0.5, 1.0, 2.0, -0.25) for t in (1.0, 1.5) for p in (2, 1)]
    sinks.write_tsv(spark.createDataFrame(rows, "time double, pid long, x double, y double, z double, p double"), ["p"], catalog.description(*GOOD), str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out" / "rows")).collect()]
    assert sorted(lines)[0] == "1.0\t0.500000\t1.000000\t2.000000\t-0.250000" and len(lines) == 4
    assert any("time\tx_point" in r.value for r in spark.read.text(str(tmp_path / "out" / "header")).collect())
    assert 'Dimensions="3 2 1 3"' in sinks.xdmf("t", "velocity", 3, (1, 2, 3), "f.h5")
