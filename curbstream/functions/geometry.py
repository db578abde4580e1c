"""Scalar geometry as column expressions. Pixels, y down."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOOTPRINT = 0.35


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def size_px(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    return F.sqrt(F.greatest(c(x2) - c(x1), F.lit(1.0)) * F.greatest(c(y2) - c(y1), F.lit(1.0)))


def border(width="width", height="height", x1="x1", y1="y1", x2="x2", y2="y2", frac: float = 0.005) -> Column:
    """Whether a box is cut off by the frame border."""
    mx, my = F.greatest(F.lit(2.0), F.lit(frac) * c(width)), F.greatest(F.lit(2.0), F.lit(frac) * c(height))
    return (c(y1) <= my) | (c(y2) >= c(height) - my) | (c(x1) <= mx) | (c(x2) >= c(width) - mx)


def row_scale(y, a="sc_a", b="sc_b", low="sc_min") -> Column:
    """Typical vehicle size (px) at image row ``y``: one body length."""
    return F.greatest(c(low), c(a) + c(b) * c(y))


def box_iou(a: tuple, b: tuple) -> Column:
    ax1, ay1, ax2, ay2 = (c(v) for v in a)
    bx1, by1, bx2, by2 = (c(v) for v in b)
    z = F.lit(0.0)
    inter = F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), z) * F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), z)
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter
    return F.when(union > 0, inter / union).otherwise(z)


def foot_top(y1="y1", y2="y2", frac: float = FOOTPRINT) -> Column:
    """Upper edge of the footprint, the lower part of a box."""
    return c(y2) - F.lit(frac) * (c(y2) - c(y1))


def overlaps(a: tuple, b: tuple) -> Column:
    """Strict overlap of two boxes."""
    ax1, ay1, ax2, ay2 = (c(v) for v in a)
    bx1, by1, bx2, by2 = (c(v) for v in b)
    return (F.least(ax2, bx2) > F.greatest(ax1, bx1)) & (F.least(ay2, by2) > F.greatest(ay1, by1))


def angle_diff(a, b) -> Column:
    """Signed difference a - b in degrees, in [-180, 180)."""
    return F.pmod(c(a) - c(b) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def heading(vx, vy) -> Column:
    return F.degrees(F.atan2(c(vy), c(vx)))


def with_first_overlap(df: DataFrame, out: str, a: tuple, b: tuple, rvx: Column, rvy: Column, horizon: float = 3.0, step: float = 0.1) -> DataFrame:
    """Add the time to collision of box ``a`` moving at (rvx, rvy) px/s relative to box ``b``: the first multiple of
    ``step`` at which they overlap, 0 when they overlap now, null when they do not within ``horizon``.

    The overlap of moving boxes is an open time interval, so the first step inside it is computed, not searched.
    The steps are separate columns, and the result passes through a generator, so that a filter on it does not
    repeat the whole computation.
    """
    n, big = int(round(horizon / step)), F.lit(1e18)
    box = [f"__{s}{i}" for s in "ab" for i in range(4)]
    d = df.withColumns({**dict(zip(box, [c(v) for v in (*a, *b)])), "__vx": rvx, "__vy": rvy})
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = [F.col(k) for k in box[:4]], [F.col(k) for k in box[4:]]

    def axis(name: str, lo: Column, hi: Column, v: Column) -> dict[str, Column]:
        # The times with lo < v * t < hi.
        still = F.when((lo < 0) & (hi > 0), big).otherwise(-big)
        enter = F.when(v > 0, lo / v).when(v < 0, hi / v).otherwise(-still)
        leave = F.when(v > 0, hi / v).when(v < 0, lo / v).otherwise(still)
        return {f"__e{name}": enter, f"__l{name}": leave}

    d = d.withColumns({**axis("x", bx1 - ax2, bx2 - ax1, F.col("__vx")), **axis("y", by1 - ay2, by2 - ay1, F.col("__vy"))})
    d = d.withColumns({"__e": F.greatest("__ex", "__ey"), "__l": F.least("__lx", "__ly")})
    d = d.withColumn("__k", F.greatest(F.floor(F.least(F.greatest("__e", F.lit(-1.0)), F.lit(horizon + 1.0)) / F.lit(step)) + 1, F.lit(1)))

    def meets(j: Column) -> Column:
        dx, dy = F.col("__vx") * (j * F.lit(step)), F.col("__vy") * (j * F.lit(step))
        return j.between(1, n) & overlaps((ax1 + dx, ay1 + dy, ax2 + dx, ay2 + dy), (bx1, by1, bx2, by2))

    # The division may be off by one step, and grazing boxes only meet if they do so in plain arithmetic.
    k = F.col("__k")
    hit = F.when(meets(k - 1), k - 1).when(meets(k), k).when(meets(k + 1), k + 1)
    ttc = F.when(overlaps((ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2)), F.lit(0.0)).when(F.col("__e") < F.col("__l"), hit * F.lit(step))
    return d.select(*df.columns, F.explode(F.array(ttc)).alias(out))


def project(x, y, p: str = "x", q: str = "y", h: str = "h") -> tuple[Column, Column]:
    """Point (x, y) under the 3x3 matrix in the array column ``h`` (row order)."""
    m = [F.element_at(c(h), i + 1) for i in range(9)]
    w = m[6] * c(x) + m[7] * c(y) + m[8]
    return (m[0] * c(x) + m[1] * c(y) + m[2]) / w, (m[3] * c(x) + m[4] * c(y) + m[5]) / w


def plausible_warp(h: str = "h") -> Column:
    """Whether the unit square stays convex and keeps between half and twice its area under the matrix."""
    pts = [project(F.lit(float(x)), F.lit(float(y)), h=h) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]
    area = F.lit(0.0)
    turns = []
    for i in range(4):
        (x0, y0), (x1, y1), (x2, y2) = pts[i], pts[(i + 1) % 4], pts[(i + 2) % 4]
        area = area + x0 * y1 - x1 * y0
        turns.append((x1 - x0) * (y2 - y1) - (y1 - y0) * (x2 - x1))
    convex = (F.greatest(*turns) < 0) | (F.least(*turns) > 0)
    area = F.abs(area) / 2
    return convex & (area > 0.5) & (area < 2.0)


def poly_contains(x, y, pts: str = "pts") -> Column:
    """Even-odd test of (x, y) against the closed polygon in the array column ``pts`` of struct(x, y)."""
    px, py, a = c(x), c(y), c(pts)
    n = F.size(a)
    crossings = F.aggregate(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            ((F.get(a, i)["y"] > py) != (F.get(a, (i + n - 1) % n)["y"] > py))
            & (px < (F.get(a, (i + n - 1) % n)["x"] - F.get(a, i)["x"]) * (py - F.get(a, i)["y"]) / F.nullif(F.get(a, (i + n - 1) % n)["y"] - F.get(a, i)["y"], F.lit(0.0)) + F.get(a, i)["x"]),
            1,
        ).otherwise(0),
    )
    return (n >= 3) & (crossings % 2 == 1)


def _segment(a: Column, i: Column, closed: bool) -> tuple[Column, Column]:
    p = F.get(a, i)
    q = F.get(a, (i + 1) % F.size(a)) if closed else F.get(a, i + 1)
    return p, q


def segment_distance(px: Column, py: Column, p: Column, q: Column) -> Column:
    ux, uy = q["x"] - p["x"], q["y"] - p["y"]
    den = F.greatest(ux * ux + uy * uy, F.lit(1e-9))
    t = F.least(F.greatest(((px - p["x"]) * ux + (py - p["y"]) * uy) / den, F.lit(0.0)), F.lit(1.0))
    return hypot(px - p["x"] - t * ux, py - p["y"] - t * uy)


def line_distance(x, y, pts: str = "pts", closed: bool = False) -> Column:
    """Distance to a polyline (or to the closed outline of a polygon)."""
    px, py, a = c(x), c(y), c(pts)
    last = F.size(a) - (1 if closed else 2)
    return F.array_min(F.transform(F.sequence(F.lit(0), last), lambda i: segment_distance(px, py, *_segment(a, i, closed))))


def line_side(x, y, pts: str = "pts") -> Column:
    """Side (+1 or -1) of the nearest segment; on the line counts as +1, the first of equally near segments wins."""
    px, py, a = c(x), c(y), c(pts)

    def one(i: Column) -> Column:
        p, q = _segment(a, i, False)
        cross = (q["x"] - p["x"]) * (py - p["y"]) - (q["y"] - p["y"]) * (px - p["x"])
        return F.struct(segment_distance(px, py, p, q).alias("d"), i.alias("i"), F.when(cross < 0, -1.0).otherwise(1.0).alias("s"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(a) - 2), one))["s"]


def path_crosses(x0, y0, x1, y1, pts: str = "pts") -> Column:
    """Whether the step (x0, y0)-(x1, y1) crosses a polyline; a point on a line counts as its positive side."""
    a = c(pts)
    ax, ay, bx, by = c(x0), c(y0), c(x1), c(y1)

    def orient(px, py, qx, qy, rx, ry) -> Column:
        return (qx - px) * (ry - py) - (qy - py) * (rx - px) >= 0

    def one(i: Column) -> Column:
        p, q = _segment(a, i, False)
        return (orient(ax, ay, bx, by, p["x"], p["y"]) != orient(ax, ay, bx, by, q["x"], q["y"])) & (
            orient(p["x"], p["y"], q["x"], q["y"], ax, ay) != orient(p["x"], p["y"], q["x"], q["y"], bx, by)
        )

    return F.exists(F.sequence(F.lit(0), F.size(a) - 2), one)


def cell_of(v, cell: Column, n: Column) -> Column:
    """Grid index of a coordinate, clipped to the grid."""
    return F.least(F.greatest((c(v) / cell).cast("int"), F.lit(0)), n - 1)


def mmss(sec) -> Column:
    """Seconds as ``m:ss.s``."""
    s = c(sec)
    m = F.floor(s / 60)
    return F.format_string("%d:%04.1f", m, s - m * 60)


def pretty_label(label) -> Column:
    return F.regexp_replace(c(label), "_", " ")
