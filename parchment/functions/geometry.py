"""Affine matrices (row vectors: x' = a*x + c*y + e) and boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = tuple[Column, Column, Column, Column, Column, Column]


def concat(p: Matrix, q: Matrix) -> Matrix:
    """First p, then q."""
    a, b, c, d, e, f = p
    g, h, i, j, k, m = q
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + m)


def point(m: Matrix, x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def box(m: Matrix, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column, Column]:
    """Bounds of the transformed box."""
    corners = [point(m, x, y) for x in (x0, x1) for y in (y0, y1)]
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def determinant(m: Matrix) -> Column:
    return m[0] * m[3] - m[1] * m[2]


def inverse(m: Matrix) -> Matrix:
    """Nulls where the determinant is under 1e-12."""
    det = determinant(m)
    ok = lambda x: F.when(F.abs(det) >= 1e-12, x / det)
    a, b, c, d, e, f = m
    return ok(d), ok(-b), ok(-c), ok(a), ok(c * f - d * e), ok(b * e - a * f)


def expansion(m: Matrix) -> Column:
    return F.sqrt(F.abs(determinant(m)))


def turn(degrees: Column) -> tuple[Column, Column]:
    """(cosine, sine) of a page rotation in right angles, exact; others count as the angle below."""
    quarter = F.pmod(F.floor(degrees / 90), F.lit(4))
    return (F.when(quarter == 0, 1.0).when(quarter == 2, -1.0).otherwise(0.0), F.when(quarter == 1, 1.0).when(quarter == 3, -1.0).otherwise(0.0))


def page_size(width: Column, height: Column, rotate: Column, dpi: Column) -> tuple[Column, Column]:
    """Pixels of a page box turned by right angles: sides rounded outward, a thousandth forgiven."""
    across = F.pmod(F.floor(rotate / 90), F.lit(2)) == 1
    w, h = F.when(across, height).otherwise(width), F.when(across, width).otherwise(height)
    side = lambda x: F.ceil(x * dpi / 72.0 - 0.001).cast("int")
    return side(w), side(h)


def rounded(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, ...]:
    """Integer box: floor(x + .001) and ceil(x - .001)."""
    return tuple(F.floor(v + 0.001).cast("int") for v in (x0, y0)) + tuple(F.ceil(v - 0.001).cast("int") for v in (x1, y1))


def outer(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, ...]:
    return tuple(F.floor(v).cast("int") for v in (x0, y0)) + tuple(F.ceil(v).cast("int") for v in (x1, y1))


def intersect(p: tuple[Column, ...], q: tuple[Column, ...]) -> tuple[Column, ...]:
    return F.greatest(p[0], q[0]), F.greatest(p[1], q[1]), F.least(p[2], q[2]), F.least(p[3], q[3])


def empty(b: tuple[Column, ...]) -> Column:
    return (b[0] >= b[2]) | (b[1] >= b[3])


def union(p: tuple[Column, ...], q: tuple[Column, ...]) -> tuple[Column, ...]:
    """Bounds of both; an empty box adds nothing."""
    pick = lambda f, i: F.when(empty(p), q[i]).when(empty(q), p[i]).otherwise(f(p[i], q[i]))
    return pick(F.least, 0), pick(F.least, 1), pick(F.greatest, 2), pick(F.greatest, 3)


def rectilinear(m: Matrix, eps: float = 1e-9) -> Column:
    small = lambda x: F.abs(x) < eps
    return (small(m[1]) & small(m[2])) | (small(m[0]) & small(m[3]))


def upright(m: Matrix, eps: float = 1e-3) -> Column:
    return (F.abs(m[1]) < eps) & (F.abs(m[2]) < eps) & (m[0] > 0) & (F.abs(m[3]) >= eps)


def clamp32(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-2147483648)), F.lit(2147483647)).cast("int")


def row_bytes(bits: Column, colors: Column, columns: Column) -> Column:
    return F.ceil(bits * colors * columns / 8).cast("int")


def pixel_bytes(bits: Column, colors: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(bits * colors / 8).cast("int"))
