"""Column expressions shared by the operators: rounding rules, angles, rays, cameras and plan coordinates.

World axes are metres with z up; yaw is 0 along +y and grows towards +x, pitch grows upwards, both in degrees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(x: Column | str, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity: floor(x + 0.5) at the given digit."""
    p = 10.0**digits
    return F.floor(col(x) * p + 0.5) / p


def half_even(x: Column | str, digits: int = 0) -> Column:
    return F.bround(col(x), digits)


def zero_padded(number: Column, digits: int = 2) -> Column:
    """A number as text with at least so many digits; longer ones stay whole."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(digits)), F.lit("0"))


def snap(x: Column | str, step: float) -> Column:
    return F.rint(col(x) / step) * step


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def direction(yaw: Column | str, pitch: Column | str) -> Vec:
    """Unit vector of a view direction."""
    y, p = F.radians(col(yaw)), F.radians(col(pitch))
    return F.sin(y) * F.cos(p), F.cos(y) * F.cos(p), F.sin(p)


def view(dx: Column, dy: Column, dz: Column) -> tuple[Column, Column, Column]:
    """(yaw, pitch, range) of an offset; pitch is 0 where the offset has no length."""
    r = F.sqrt(dx * dx + dy * dy + dz * dz)
    pitch = F.when(r > 0, F.degrees(F.asin(clamp(dz / F.when(r > 0, r), -1.0, 1.0)))).otherwise(F.lit(0.0))
    return F.degrees(F.atan2(dx, dy)), pitch, r


def angle_between(yaw_a: Column, pitch_a: Column, yaw_b: Column, pitch_b: Column) -> Column:
    """Great-circle angle in degrees; handles the wrap at 180."""
    pa, pb, dy = F.radians(pitch_a), F.radians(pitch_b), F.radians(yaw_a - yaw_b)
    return F.degrees(F.acos(clamp(F.sin(pa) * F.sin(pb) + F.cos(pa) * F.cos(pb) * F.cos(dy), -1.0, 1.0)))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def closest_approach(o1: Vec, d1: Vec, o2: Vec, d2: Vec) -> dict[str, Column]:
    """Of two rays with unit directions: distances t and s along them, gap and midpoint there, and their angle.

    All null where the rays are parallel.
    """
    w = tuple(a - b for a, b in zip(o1, o2, strict=True))
    b, d, e = dot(d1, d2), dot(d1, w), dot(d2, w)
    m = F.when(1 - b * b >= 1e-9, 1 - b * b)
    t, s = (b * e - d) / m, (e - b * d) / m
    p1 = tuple(o + t * x for o, x in zip(o1, d1, strict=True))
    p2 = tuple(o + s * x for o, x in zip(o2, d2, strict=True))
    gap = F.sqrt(sum(((a - c) * (a - c) for a, c in zip(p1, p2, strict=True)), F.lit(0.0)))
    mid = {f"m{n}": (a + c) / 2 for n, a, c in zip("xyz", p1, p2, strict=True)}
    return {"t": t, "s": s, "gap": gap, "angle": F.when(m.isNotNull(), F.degrees(F.acos(clamp(F.abs(b), 0.0, 1.0)))), **mid}


def lsq_sums(o: Vec, d: Vec) -> list[Column]:
    """The nine sums whose normal equations give the point nearest to a group's rays."""
    n = "xyz"
    out = []
    for i in range(3):
        for j in range(i, 3):
            out.append(F.sum((1.0 if i == j else 0.0) - d[i] * d[j]).alias(f"a{n[i]}{n[j]}"))
    along = dot(o, d)
    return out + [F.sum(o[i] - along * d[i]).alias(f"b{n[i]}") for i in range(3)]


def det3(r: Sequence[Sequence[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = r
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def lsq_solution() -> dict[str, Column]:
    """x, y, z by determinants of the sums above; null where the rays don't fix a point."""
    c = F.col
    rows = [[c("axx"), c("axy"), c("axz")], [c("axy"), c("ayy"), c("ayz")], [c("axz"), c("ayz"), c("azz")]]
    rhs = [c("bx"), c("by"), c("bz")]
    whole = det3(rows)
    safe = F.when(F.abs(whole) >= 1e-12, whole)
    return {n: det3([[rhs[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]) / safe for k, n in enumerate("xyz")}


def rotate(q: tuple[Column, Column, Column, Column], v: Vec) -> Vec:
    """A vector turned by a unit quaternion (w, x, y, z)."""
    w, x, y, z = q
    return ((1 - 2 * (y * y + z * z)) * v[0] + 2 * (x * y - w * z) * v[1] + 2 * (x * z + w * y) * v[2],
            2 * (x * y + w * z) * v[0] + (1 - 2 * (x * x + z * z)) * v[1] + 2 * (y * z - w * x) * v[2],
            2 * (x * z - w * y) * v[0] + 2 * (y * z + w * x) * v[1] + (1 - 2 * (x * x + y * y)) * v[2])


def rigid(q: tuple[Column, Column, Column, Column], t: Vec, v: Vec) -> Vec:
    return tuple(a + b for a, b in zip(rotate(q, v), t, strict=True))


def pinhole_direction(u: Column, v: Column, focal: Column, pixel: Column, cx: Column, cy: Column) -> Vec:
    """Camera-frame unit direction (x right, y up, looking along -z) of an image point."""
    x, y, z = (u - cx) * pixel / focal, -(v - cy) * pixel / focal, F.lit(-1.0)
    n = F.sqrt(x * x + y * y + 1.0)
    return x / n, y / n, z / n


def pinhole_point(d: Vec, focal: Column, pixel: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """Image point of a camera-frame direction; null behind the camera."""
    ahead = F.when(d[2] < 0, -d[2])
    return cx + d[0] / ahead * focal / pixel, cy - d[1] / ahead * focal / pixel


def turned_back(q: tuple[Column, Column, Column, Column], v: Vec) -> Vec:
    """A vector turned by the inverse of a unit quaternion: from the world into the camera's frame."""
    w, x, y, z = q
    return rotate((w, -x, -y, -z), v)


def equirect_direction(u: Column, v: Column, width: int, height: int) -> tuple[Column, Column]:
    """(yaw, pitch) of a point of an equirectangular picture."""
    return (u / width - 0.5) * 360, (0.5 - v / height) * 180


def equirect_pixel(yaw: Column, pitch: Column, width: int, height: int) -> tuple[Column, Column]:
    return (yaw / 360 + 0.5) * width, (0.5 - pitch / 180) * height


def plan_pixel(x: Column, y: Column, x_min: Column | float, y_max: Column | float, mpp: Column | float) -> tuple[Column, Column]:
    return (x - x_min) / mpp, (y_max - y) / mpp


def plan_world(px: Column, py: Column, x_min: float, y_max: float, mpp: float) -> tuple[Column, Column]:
    return px * mpp + x_min, y_max - py * mpp


def box_area(b: Sequence[Column]) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def box_overlap(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column]:
    """(intersection over union, part of ``a`` that ``b`` covers)."""
    both = box_area([F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])])
    union = box_area(a) + box_area(b) - both
    return F.when(union > 0, both / F.when(union > 0, union)).otherwise(0.0), F.when(box_area(a) > 0, both / F.when(box_area(a) > 0, box_area(a))).otherwise(0.0)


def blank_to_null(x: Column | str) -> Column:
    t = F.trim(col(x))
    return F.when(t != "", t)


def iso_date(x: Column | str) -> Column:
    """A date in the form yyyy-mm-dd that the calendar has; null otherwise."""
    return F.when(col(x).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_to_date({})".format(x)) if isinstance(x, str) else F.try_to_date(x))


def finite(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) < float("inf"))
    return out
