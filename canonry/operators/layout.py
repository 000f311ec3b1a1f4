"""Geometry of recognised boxes: rectangles as ``x0``, ``y0``, ``x1``, ``y1``. Only greedy chains leave the native path, one image at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def iou(a: str, b: str) -> Column:
    """Intersection over union of the rectangles of two aliases."""
    c = lambda t, k: F.col(f"{t}.{k}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))
    area = lambda t: (c(t, "x1") - c(t, "x0")) * (c(t, "y1") - c(t, "y0"))
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def overlap_share(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """How much of the shorter of two spans lies in the other."""
    return F.coalesce(F.try_divide(F.greatest(F.lit(0.0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b)), F.least(hi_a - lo_a, hi_b - lo_b)), F.lit(0.0))


def reading_order(boxes: DataFrame, image: str = "image", row_share: float = 0.6) -> DataFrame:
    """``place`` from 0: by rows of about the median height, then from left to right."""
    height = F.median(F.col("y1") - F.col("y0")).over(Window.partitionBy(image))
    band = F.floor(F.col("y0") / F.greatest(F.lit(1.0), height * row_share))
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy(image).orderBy(band, "x0", "y0")) - 1)


def suppressed(boxes: DataFrame, schema: str, most: float = 0.85, image: str = "image", order: str = "rank") -> DataFrame:
    """Boxes in order, without those that overlap a kept earlier one; ``schema`` is the frame's own."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in part.sort_values(order).itertuples():
            area = (r.x1 - r.x0) * (r.y1 - r.y0)
            for k in kept:
                meet = max(0, min(r.x1, k.x1) - max(r.x0, k.x0)) * max(0, min(r.y1, k.y1) - max(r.y0, k.y0))
                if meet > most * (area + (k.x1 - k.x0) * (k.y1 - k.y0) - meet):
                    break
            else:
                kept.append(r)
        return part.loc[[k.Index for k in kept]]

    return boxes.groupBy(image).applyInPandas(run, schema)


def columns_of(boxes: DataFrame, schema: str, least: float = 0.3, image: str = "image") -> DataFrame:
    """``column`` of each box: greedy clusters of overlapping horizontal spans, from the widest box on."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        spans: list[list[float]] = []
        found = {}
        for r in part.assign(w=part.x0 - part.x1).sort_values(["w", "x0", "y0"]).itertuples():
            for k, (a, b) in enumerate(spans):
                if min(b, r.x1) - max(a, r.x0) >= least * min(b - a, r.x1 - r.x0):
                    spans[k], found[r.Index] = [min(a, r.x0), max(b, r.x1)], k
                    break
            else:
                found[r.Index] = len(spans)
                spans.append([r.x0, r.x1])
        return part.assign(column=pd.Series(found, dtype="int64"))

    return boxes.groupBy(image).applyInPandas(run, schema + ", column long")


def panels(anchors: DataFrame, lines: DataFrame, image: str = "image", least: float = 0.3) -> DataFrame:
    """Each anchor's panel reaches down to the next anchor in its column; its lines are those inside. Density is their share of the panel's height."""
    a, b = anchors.alias("a"), anchors.alias("b")
    same = (F.col(f"a.{image}") == F.col(f"b.{image}")) & (F.col("b.y0") > F.col("a.y0")) & (overlap_share(F.col("a.x0"), F.col("a.x1"), F.col("b.x0"), F.col("b.x1")) >= least)
    ends = a.join(b, same, "left").groupBy(f"a.{image}", "a.section", "a.x0", "a.x1", "a.y0").agg(F.min("b.y0").alias("end"))
    p, t = ends.alias("p"), lines.alias("t")
    inside = (F.col(f"p.{image}") == F.col(f"t.{image}")) & (F.col("t.y0") >= F.col("p.y0")) & (F.col("p.end").isNull() | (F.col("t.y0") < F.col("p.end"))) & (overlap_share(F.col("p.x0"), F.col("p.x1"), F.col("t.x0"), F.col("t.x1")) >= least)
    return p.join(t, inside, "left").groupBy(f"p.{image}", "section", "p.y0").agg(F.count("t.y0").alias("lines"), F.max("t.y1").alias("bottom"), F.median(F.col("t.y1") - F.col("t.y0")).alias("line_height"), F.coalesce(F.try_divide(F.sum(F.col("t.y1") - F.col("t.y0")), F.max("t.y1") - F.min("t.y0")), F.lit(0.0)).alias("density"))


def symbol_texts(symbols: DataFrame, texts: DataFrame, image: str = "image", reach: float = 0.15) -> DataFrame:
    """Texts whose centre lies near a symbol's, joined in reading order; sizes are shares of the image."""
    s, t = symbols.alias("s"), texts.alias("t")
    near = lambda a, b: F.abs((F.col(f"s.{a}") + F.col(f"s.{b}")) / 2 - (F.col(f"t.{a}") + F.col(f"t.{b}")) / 2) < reach
    met = s.join(t, (F.col(f"s.{image}") == F.col(f"t.{image}")) & near("x0", "x1") & near("y0", "y1"), "left")
    return met.groupBy(f"s.{image}", "s.symbol").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("t.text").isNotNull(), F.struct("t.y0", "t.x0", "t.text")))), lambda x: x["text"]), " ").alias("nearby"))
