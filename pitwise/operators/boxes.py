"""Annotation boxes: O76, O106-O108 (row-level array expressions; no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET_SIZE = 224.0
BOX_FIELDS = ("height", "width", "x", "y")


def largest_box(annotations) -> Column:
    """The box with the largest height*width (ties: the later one, as a stable sort's last)."""
    a = F.col(annotations) if isinstance(annotations, str) else annotations
    keyed = F.transform(a, lambda b, i: F.struct((b["height"] * b["width"]).alias("area"), i.alias("i"),
                                                 b.alias("box")))
    return F.array_max(keyed)["box"]


def shape_to_box(shape_type, shape_desc) -> Column:
    """O106: circle/rect 'x y w h'; polygon 'x,y x,y ...' -> bounding box; other types -> null.

    Returns struct(height, width, x, y) of doubles.
    """
    t = F.col(shape_type) if isinstance(shape_type, str) else shape_type
    d = F.col(shape_desc) if isinstance(shape_desc, str) else shape_desc
    p = F.split(d, " ")
    rect = F.struct(p[3].cast("double").alias("height"), p[2].cast("double").alias("width"),
                    p[0].cast("double").alias("x"), p[1].cast("double").alias("y"))
    xs = F.transform(p, lambda s: F.split(s, ",")[0].cast("float").cast("double"))
    ys = F.transform(p, lambda s: F.split(s, ",")[1].cast("float").cast("double"))
    poly = F.struct((F.array_max(ys) - F.array_min(ys)).alias("height"),
                    (F.array_max(xs) - F.array_min(xs)).alias("width"),
                    F.array_min(xs).alias("x"), F.array_min(ys).alias("y"))
    return F.when(t.isin(1, 2), rect).when(t == 4, poly)


def rescale_box(box, size_w, size_h, target: float = TARGET_SIZE) -> Column:
    """O107: scale to a target x target image; x and y clamped at 0."""
    b = F.col(box) if isinstance(box, str) else box
    cx = F.lit(target) / size_w
    cy = F.lit(target) / size_h
    return F.struct((b["height"] * cy).alias("height"), (b["width"] * cx).alias("width"),
                    F.greatest(b["x"] * cx, F.lit(0.0)).alias("x"), F.greatest(b["y"] * cy, F.lit(0.0)).alias("y"))


def with_default_box(files: DataFrame, boxes: DataFrame, key: str = "filename", box: str = "box") -> DataFrame:
    """O108: files without an annotation get a zero box."""
    zero = F.struct(*[F.lit(0.0).alias(f) for f in BOX_FIELDS])
    return files.join(boxes, key, "left").withColumn(box, F.coalesce(F.col(box), zero))
