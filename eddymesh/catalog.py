"""Datasets, variables, methods and output columns; and the checks of a request against them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PI = math.pi
# Title, nodes along x, y, z, spacing (None: irregular), periodic axes, non-periodic domain, times of
# point queries, snapshots of cutouts, time step and index shift, variables, native, pchip allowed, name digits.
DATASETS = [
    ("isotropic1024coarse", (1024, 1024, 1024), (2 * PI / 1024,) * 3, "TTT", {}, (0.0, 10.056), 5024, 0.002, 0, "pressure velocity force position", False, True),
    ("isotropic1024fine", (1024, 1024, 1024), (2 * PI / 1024,) * 3, "TTT", {}, (0.0, 0.0198), 100, 0.0002, 0, "pressure velocity force position", False, True),
    ("isotropic4096", (4096, 4096, 4096), (2 * PI / 4096,) * 3, "TTT", {}, (1.0, 1.0), 1, 1.0, -1, "velocity", False, False),
    ("isotropic8192", (8192, 8192, 8192), (2 * PI / 8192,) * 3, "TTT", {}, (1.0, 6.0), 6, 1.0, -1, "pressure velocity", True, False),
    ("sabl2048low", (2048, 2048, 2048), (0.1953125,) * 3, "TTF", {"z": (0.09765625, 399.90234375)}, (1.0, 20.0), 20, 1.0, -1, "pressure velocity temperature energy", True, False),
    ("sabl2048high", (2048, 2048, 2048), (0.1953125,) * 3, "TTF", {"z": (0.09765625, 399.90234375)}, (0.0, 7.425), 100, 0.075, 1, "pressure velocity temperature energy", True, True),
    ("rotstrat4096", (4096, 4096, 4096), (2 * PI / 4096,) * 3, "TTT", {}, (1.0, 5.0), 5, 1.0, -1, "velocity temperature", False, False),
    ("mhd1024", (1024, 1024, 1024), (2 * PI / 1024,) * 3, "TTT", {}, (0.0, 2.56), 1025, 0.0025, 0, "pressure velocity magneticfield vectorpotential force position", False, True),
    ("mixing", (1024, 1024, 1024), (2 * PI / 1024,) * 3, "TTT", {}, (0.0, 40.44), 1012, 0.04, 0, "pressure velocity density position", False, True),
    ("channel", (2048, 512, 1536), (8 * PI / 2048, None, 3 * PI / 1536), "TFT", {"y": (-1.0, 1.0)}, (0.0, 25.9935), 4000, 0.0065, 0, "pressure velocity position", False, True),
    ("channel5200", (10240, 1536, 7680), (8 * PI / 10240, None, 3 * PI / 7680), "TFT", {"y": (-1.0, 1.0)}, (1.0, 11.0), 11, 1.0, -1, "pressure velocity", False, False),
    ("transition_bl", (3320, 224, 2048), (0.292210466, None, 0.117244748), "FFT", {"x": (30.2185, 1000.065), "y": (0.0, 26.48795)}, (0.0, 1175.0), 4701, 0.25, 0, "pressure velocity position", False, True),
]
NAMES = [d[0] for d in DATASETS]
#: Variables that only point queries offer.
NOT_IN_CUTOUTS = {"force", "position"}
VECTORS = {"velocity": "u", "magneticfield": "b", "vectorpotential": "a", "force": "f", "position": ""}
SCALARS = {"pressure": "p", "energy": "e", "temperature": "theta", "density": "rho"}
SNAPSHOT_TIMES = {d[0] for d in DATASETS if d[7] == 1.0}
MAX_POINTS, MAX_BYTES = 2_000_000, 16 * 1024**3


def dataset(title: str) -> tuple:
    if title not in NAMES:
        raise ValueError(f"{title} isn't a dataset: {', '.join(NAMES)}")
    return DATASETS[NAMES.index(title)]


def operators(variable: str) -> list[str]:
    if variable in ("force", "position"):
        return ["field"]
    return ["field", "gradient", "hessian"] + (["laplacian"] if variable in VECTORS else [])


def methods(title: str, variable: str, operator: str) -> list[str]:
    native, boundary_layer = dataset(title)[10], title == "transition_bl"
    sabl = title.startswith("sabl")
    if variable == "position":
        return ["lag4"] if boundary_layer else ["lag4", "lag6", "lag8"]
    if boundary_layer:
        return ["none", "lag4"] if operator == "field" else ["fd4noint", "fd4lag4"]
    fd, splines = ["fd4noint", "fd6noint", "fd8noint"], [] if native else ["m2q14"]
    if operator == "field":
        return ([] if sabl else ["none"]) + ["lag4", "lag6", "lag8", "m1q4", "m2q8", *splines]
    if operator == "gradient":
        return [*fd, "fd4lag4", "m1q4", "m2q8", *splines]
    if operator == "hessian":
        return [*fd, *([] if native else ["fd4lag4"]), "m2q8", *splines]
    return [*fd, "fd4lag4"]


def capabilities() -> list[tuple[str, str, str, str]]:
    """Every legal (dataset, variable, operator, method)."""
    return [(d[0], v, o, m) for d in DATASETS for v in d[9].split() for o in operators(v) for m in methods(d[0], v, o)]


def columns(variable: str, operator: str) -> list[str]:
    """Names of a result's columns, in order."""
    if variable == "position":
        return ["x", "y", "z"]
    names = [VECTORS[variable] + a for a in "xyz"] if variable in VECTORS else [SCALARS[variable]]
    if operator == "field":
        return names
    if operator == "gradient":
        return [f"d{n}d{a}" for n in names for a in "xyz"]
    if operator == "laplacian":
        return [f"grad2{n}" for n in names]
    return [f"d2{n}d{a}d{b}" for n in names for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]


def description(title: str, variable: str, time: float, method: str, operator: str, temporal: str = "none", end: float | None = None, step: float | None = None) -> str:
    span = f", time end: {end}, delta t: {step}" if end is not None else ""
    return f"dataset: {title}, variable: {variable}, time: {time}{span}, temporal method: {temporal}, spatial method: {method}, spatial operator: {operator}"


def check(title: str, variable: str, time: float, method: str, operator: str, temporal: str = "none", cutout: bool = False, end: float | None = None, step: float | None = None) -> None:
    """Raises ValueError unless the request is legal."""
    d = dataset(title)
    allowed = [v for v in d[9].split() if not (cutout and v in NOT_IN_CUTOUTS)]
    if variable not in allowed:
        raise ValueError(f"{variable} isn't a variable of {title}: {', '.join(allowed)}")
    if cutout or title in SNAPSHOT_TIMES:
        if time != int(time) or not 1 <= time <= d[6]:
            raise ValueError(f"{time} isn't a snapshot from 1 to {d[6]}")
    elif not d[5][0] <= time <= d[5][1]:
        raise ValueError(f"{time} isn't between {d[5][0]} and {d[5][1]}")
    if cutout:
        return
    if operator not in operators(variable):
        raise ValueError(f"{operator} isn't offered for {variable}")
    if method not in methods(title, variable, operator):
        raise ValueError(f"{method} isn't offered for the {operator} of {variable} in {title}")
    if temporal not in (["none", "pchip"] if d[11] and variable != "position" else ["pchip"] if d[11] else ["none"]):
        raise ValueError(f"{temporal} isn't offered for {title}")
    if variable == "position" and (end is None or step is None):
        raise ValueError("position takes an end time and a step")
    if (end is None) != (step is None):
        raise ValueError("an end time and a step are given together")
    if end is not None and (step <= 0 or time + step > end + 1e-9 * abs(end)):
        raise ValueError("the first step goes past the end time")
    if step is not None and title in SNAPSHOT_TIMES and step != int(step):
        raise ValueError("snapshots have whole steps")


def domain(title: str) -> list[tuple[float, float] | None]:
    """Lowest and highest coordinate along x, y, z; None where any is taken by its period."""
    return [dataset(title)[4].get(a) for a in "xyz"]


def check_points(title: str, points: DataFrame, limited: bool = True) -> None:
    """Raises ValueError if there are too many points for one call (limited) or one lies outside the dataset's own
    domain. One pass."""
    limits = [(a, limit) for a, limit in zip("xyz", domain(title)) if limit]
    found = points.agg(F.count("*").alias("n"), *[f(a).alias(f"{k}_{a}") for a, _ in limits for k, f in (("low", F.min), ("high", F.max))]).first()
    if limited and found["n"] > MAX_POINTS:
        raise ValueError(f"{found['n']} points are more than {MAX_POINTS}")
    for a, (low, high) in limits:
        if found["n"] and (found[f"low_{a}"] < low or found[f"high_{a}"] > high):
            raise ValueError(f"{a} of a point isn't between {low} and {high} in {title}")


def offsets(title: str, variable: str) -> tuple[float, float, float]:
    """Coordinates of the first node."""
    x = 30.2185 if title == "transition_bl" else 0.0
    if not title.startswith("sabl"):
        return x, 0.0, 0.0
    return x, 0.0, 0.1953125 if variable in ("energy", "velocity_w") else 0.1953125 / 2


def check_box(title: str, ranges: list[tuple[int, int]], strides: list[int], components: int = 1) -> None:
    """1-based inclusive ranges along x, y, z."""
    d = dataset(title)
    for (lo, hi), n, periodic, stride in zip(ranges, d[1], d[3], strides):
        if not all(isinstance(v, int) and not isinstance(v, bool) for v in (lo, hi, stride)):
            raise ValueError("ranges and strides are integers")
        if lo > hi or stride < 1 or periodic == "F" and (lo < 1 or hi > n):
            raise ValueError(f"{lo}..{hi} by {stride} isn't a range of the axis")
    if math.prod(hi - lo + 1 for lo, hi in ranges) * 4 * components > MAX_BYTES:
        raise ValueError("the cutout is larger than 16 GB")
