"""Column builders for boxes, polygons and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corners(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    """x1, y1, x2, y2 of a box given by centre and size."""
    return [(cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2")]


def points_of(flat: Column) -> Column:
    """Pairs of a flat list of an even number of at least six coordinates; null for other lists."""
    n = F.size(flat)
    xs, ys = F.filter(flat, lambda _, i: i % 2 == 0), F.filter(flat, lambda _, i: i % 2 == 1)
    return F.when((n >= 6) & (n % 2 == 0), F.zip_with(xs, ys, lambda x, y: F.struct(x.alias("x"), y.alias("y"))))


def enclosing(points: Column) -> list[Column]:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return [F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")]


def twice_area(points: Column) -> Column:
    """Twice the area by the shoelace formula; whole for whole coordinates. Each point meets the next in one pass, as a
    lookup by number would make the list again for every point."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    pairs = F.zip_with(points, following, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    step = lambda acc, s: acc + s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"]
    return F.abs(F.aggregate(pairs, F.lit(0.0), step))


def to_absolute(points: Column, width: Column, height: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y")))


def to_normalized(points: Column, width: Column, height: Column) -> Column:
    """Null where the image has no size."""
    return F.when((width > 0) & (height > 0), F.transform(points, lambda p: F.struct((p["x"] / width).alias("x"), (p["y"] / height).alias("y"))))


def clip(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    """A box cut to the image: floor of the start, ceiling of the end, within the image."""
    within = lambda v, most: F.greatest(F.lit(0), F.least(most.cast("bigint"), v))
    return [within(F.floor(x1), width).alias("x1"), within(F.floor(y1), height).alias("y1"), within(F.ceil(x2), width).alias("x2"), within(F.ceil(y2), height).alias("y2")]


def overlap(a: list[Column], b: list[Column]) -> tuple[Column, Column]:
    """Intersection and union of two boxes (x1, y1, x2, y2)."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = w * h
    return inter, (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter


def iou(a: list[Column], b: list[Column]) -> Column:
    inter, union = overlap(a, b)
    return F.when(union > 0, inter / union).otherwise(0.0)


def display_scale(width: Column, height: Column, most: int) -> Column:
    return F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))


# Edges of the aspect histogram.
EDGES = [0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0]


def aspect_bucket(width: Column, height: Column) -> Column:
    """Half-open bucket of width / height; compared without division, so it is exact."""
    out = F.when(width < height * EDGES[0], f"<{EDGES[0]}")
    for a, b in zip(EDGES, EDGES[1:]):
        out = out.when(width < height * b, f"{a}-{b}")
    return out.otherwise(f">={EDGES[-1]}")


def unusual_size(width: Column, height: Column, min_side: int = 100, max_aspect: float = 3.0) -> Column:
    return (F.least(width, height) < min_side) | (width > height * max_aspect) | (height > width * max_aspect)


def bit_hash(bits: Column) -> Column:
    """64 booleans, the first in the highest bit, as a signed BIGINT."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(F.when(b, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))


def average_hash(grid: Column) -> Column:
    """Hash of an 8 x 8 grid: cells above the mean."""
    d = F.transform(grid, lambda x: x.cast("double"))
    total = F.aggregate(d, F.lit(0.0), lambda a, x: a + x)
    return bit_hash(F.transform(d, lambda x: x * F.size(grid) > total))


def difference_hash(grid: Column, columns: int = 9) -> Column:
    """Hash of a grid of 8 rows of 9: cells brighter than the one to their right."""
    cells = F.filter(F.sequence(F.lit(0), F.size(grid) - 2), lambda i: (i + 1) % columns != 0)
    return bit_hash(F.transform(cells, lambda i: F.get(grid, i) > F.get(grid, i + 1)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def box_problem(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """``reversed`` for a box whose second corner lies before its first; null for any other, also an empty one."""
    return F.when((x2 < x1) | (y2 < y1), "reversed")
