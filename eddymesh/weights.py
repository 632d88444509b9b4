"""One-dimensional interpolation and difference weights, as exact polynomials of the fractional position.

A kernel maps a node's offset to the coefficients (constant first) of its weight. All are derived: Lagrange bases from
their roots, splines as Hermite polynomials whose nodal derivatives are centred differences, differences from their
Taylor systems. Only the eighth-order Laplacian is a fixed value.
"""

from __future__ import annotations

from fractions import Fraction as Q
from functools import lru_cache

Kernel = dict[int, list[Q]]

# The nine-point second difference of fd8noint, which isn't the standard one.
FD8_SECOND = [Q(9, 3152), Q(-104, 8865), Q(-207, 2955), Q(792, 591), Q(-35777, 14184), Q(792, 591), Q(-207, 2955), Q(-104, 8865), Q(9, 3152)]
# Weights of the corner taps (+-k, +-k) of mixed second differences, from the outermost k to 1.
CORNERS = {4: [Q(-1, 48), Q(1, 3)], 6: [Q(1, 360), Q(-3, 80), Q(3, 8)], 8: [Q(-1, 2240), Q(2, 315), Q(-1, 20), Q(14, 35)]}


def times(a: list[Q], b: list[Q]) -> list[Q]:
    out = [Q(0)] * (len(a) + len(b) - 1)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] += x * y
    return out


def slope(poly: list[Q]) -> list[Q]:
    return [c * k for k, c in enumerate(poly)][1:] or [Q(0)]


def solved(matrix: list[list[Q]], right: list[list[Q]]) -> list[list[Q]]:
    """X with matrix * X = right, by elimination."""
    rows = [list(a) + list(b) for a, b in zip(matrix, right)]
    n = len(rows)
    for c in range(n):
        p = next(r for r in range(c, n) if rows[r][c])
        rows[c], rows[p] = rows[p], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    return [r[n:] for r in rows]


@lru_cache
def centred(derivative: int, half: int) -> tuple[Q, ...]:
    """Weights on offsets -half..half of the derivative at 0, exact to the highest possible order."""
    nodes = range(-half, half + 1)
    fact = 1
    for k in range(2, derivative + 1):
        fact *= k
    moments = [[Q(x) ** p for x in nodes] for p in range(2 * half + 1)]
    return tuple(r[0] for r in solved(moments, [[Q(fact if p == derivative else 0)] for p in range(2 * half + 1)]))


@lru_cache
def lagrange(n: int) -> Kernel:
    nodes = range(1 - n // 2, n // 2 + 1)
    out = {}
    for k in nodes:
        poly = [Q(1)]
        for j in nodes:
            if j != k:
                poly = times(poly, [Q(-j, k - j), Q(1, k - j)])
        out[k] = poly
    return out


@lru_cache
def spline(k: int, n: int) -> Kernel:
    """m{k}q{n}: between nodes 0 and 1 the polynomial of degree 2k+1 that has f and its first k derivatives there."""
    degree, half = 2 * k + 1, n // 2 - 1
    # Rows: derivative j at 0 and at 1 of each monomial.
    rows, data = [], []
    for at in (0, 1):
        for j in range(k + 1):
            row = []
            for p in range(degree + 1):
                fall = Q(1)
                for q in range(j):
                    fall *= p - q
                row.append(fall * (Q(at) ** (p - j) if p >= j else 0) if fall else Q(0))
            rows.append(row)
            weights = centred(j, half) if j else tuple(Q(int(x == 0)) for x in range(-half, half + 1))
            data.append([weights[x - at + half] if -half <= x - at <= half else Q(0) for x in range(-half, half + 2)])
    coefficients = solved(rows, data)
    return {x: [coefficients[p][x + half] for p in range(degree + 1)] for x in range(-half, half + 2)}


def difference(derivative: int, order: int) -> Kernel:
    """Constant centred differences at the nearest node."""
    if (derivative, order) == (2, 8):
        return {x - 4: [w] for x, w in enumerate(FD8_SECOND)}
    half = order // 2
    return {x - half: [w] for x, w in enumerate(centred(derivative, half))}


def convolved(a: Kernel, b: Kernel) -> Kernel:
    """Interpolating by a the values that b makes at the nodes."""
    out: Kernel = {}
    for i, p in a.items():
        for j, q in b.items():
            old = out.get(i + j, [])
            new = times(p, q)
            out[i + j] = [x + (old[k] if k < len(old) else 0) for k, x in enumerate(new)]
    return out


def field(method: str) -> Kernel:
    if method == "none":
        return {0: [Q(1)]}
    if method.startswith("lag"):
        return lagrange(int(method[3:]))
    k, n = method[1:].split("q")
    return spline(int(k), int(n))


def axis(method: str) -> dict[str, Kernel]:
    """Kernels of one axis: w (value), d (first derivative), s (second)."""
    if method.startswith("fd") and method.endswith("noint"):
        order = int(method[2])
        return {"w": {0: [Q(1)]}, "d": difference(1, order), "s": difference(2, order)}
    if method == "fd4lag4":
        return {"w": lagrange(4), "d": convolved(lagrange(4), difference(1, 4)), "s": convolved(lagrange(4), difference(2, 4))}
    w = field(method)
    d = {x: slope(p) for x, p in w.items()}
    return {"w": w, "d": d, "s": {x: slope(p) for x, p in d.items()}}


#: Kernels along x, y, z of each output of an operator; a Laplacian is a sum of three.
TERMS = {
    "field": [["www"]],
    "gradient": [["dww"], ["wdw"], ["wwd"]],
    "laplacian": [["sww", "wsw", "wws"]],
    "hessian": [["sww"], ["ddw"], ["dwd"], ["wsw"], ["wdd"], ["wws"]],
}


def nearest(method: str) -> bool:
    """Whether the method works at the nearest node, without interpolation."""
    return method == "none" or method.endswith("noint")


def taps(method: str, operator: str) -> list[tuple[int, int, int, list[float]]]:
    """Constant taps (dx, dy, dz, a weight for each output) of a method at the nearest node."""
    found: dict[tuple[int, int, int], list[Q]] = {}
    kernels, outputs = axis(method), TERMS[operator]
    for out, terms in enumerate(outputs):
        for term in terms:
            if term.count("d") == 2:  # mixed: corners, not products
                a, b = (i for i, c in enumerate(term) if c == "d")
                ws = CORNERS[int(method[2])]
                parts = []
                for k, w in zip(range(len(ws), 0, -1), ws):
                    for i, j in ((k, k), (-k, k), (-k, -k), (k, -k)):
                        at = [0, 0, 0]
                        at[a], at[b] = i, j
                        parts.append((tuple(at), w if i * j > 0 else -w))
            else:
                parts = [((x, y, z), kernels[term[0]][x][0] * kernels[term[1]][y][0] * kernels[term[2]][z][0]) for x in kernels[term[0]] for y in kernels[term[1]] for z in kernels[term[2]]]
            for at, w in parts:
                if w:
                    found.setdefault(at, [Q(0)] * len(outputs))[out] += w
    return [(*at, [float(w) for w in ws]) for at, ws in sorted(found.items())]
