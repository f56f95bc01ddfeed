"""Boxes on pages (J10-J12, J30, A19, F30-F34). Coordinates run from 0 to 1000, y before x."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOOTER = 975.0


def next_tops(rows: DataFrame) -> DataFrame:
    """Each row with ``next_top``, the nearest prompt that starts below its options in the same column of its page."""
    # A page has some ten rows, and some hundred at most: they meet in one array, which is shuffled once.
    row = F.struct(*(c for c in rows.columns if c not in ("run_id", "page")))
    pages = rows.groupBy("run_id", "page").agg(F.collect_list(row).alias("all"))
    near = lambda r: lambda o: (o["row_id"] != r["row_id"]) & (o["py0"] > r["oy0"]) & (o["px1"] > r["ox0"]) & (o["px0"] < r["ox1"])
    below = lambda r: F.array_min(F.transform(F.filter("all", near(r)), lambda o: o["py0"]))
    each = F.explode(F.transform("all", lambda r: F.struct(r.alias("row"), below(r).alias("next_top"))))
    return pages.select("run_id", "page", each.alias("r")).select("run_id", "page", "r.row.*", "r.next_top").select(*rows.columns, "next_top")


def page_boundary(rows: DataFrame) -> DataFrame:
    """Rows with nothing below their options, but for a run's last page."""
    last = rows.groupBy("run_id").agg(F.max("page").alias("last_page"))
    return next_tops(rows).filter("next_top is null").join(last, "run_id").filter("page < last_page").select("run_id", "row_id", "page")


def extended_options(rows: DataFrame) -> DataFrame:
    """Options boxes grown down to the next prompt (or the footer) and out to the prompt's column, never shrunk."""
    n = next_tops(rows)
    floor = F.least(F.coalesce("next_top", F.lit(FOOTER)), F.lit(FOOTER))
    return n.select("run_id", "row_id", "oy0", F.least("ox0", "px0").alias("ox0"), F.greatest(F.col("oy1"), floor).alias("oy1"), F.greatest("ox1", "px1").alias("ox1"))


def continuation_strips(rows: DataFrame) -> DataFrame:
    """How far down the next page a row's options may go on; none on the last page."""
    tops = rows.groupBy("run_id", (F.col("page") - 1).alias("page")).agg(F.min("py0").alias("top"))
    last = rows.groupBy("run_id").agg(F.max("page").alias("last_page"))
    r = rows.join(last, "run_id").filter("page < last_page").join(tops, ["run_id", "page"], "left")
    bottom = F.when(F.col("top").isNull(), 1000.0).otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(250.0), F.col("top") + 30)))
    return r.select("run_id", "row_id", (F.col("page") + 1).alias("page"), bottom.alias("bottom"))


def region_union(rows: DataFrame, pad: float = 30.0) -> DataFrame:
    """The box around prompt and options, padded, within the page."""
    lo = lambda a, b: F.greatest(F.lit(0.0), F.least(a, b) - pad)
    hi = lambda a, b: F.least(F.lit(1000.0), F.greatest(a, b) + pad)
    return rows.select("run_id", "row_id", lo("py0", "oy0").alias("y0"), lo("px0", "ox0").alias("x0"), hi("py1", "oy1").alias("y1"), hi("px1", "ox1").alias("x1"))


def crop_box(y0: Column, x0: Column, y1: Column, x1: Column, width: int, height: int) -> Column:
    """Pixels of a box, rounded outwards and kept on the page; null where nothing is left."""
    at = lambda v, n: v / 1000 * n
    left, top = F.greatest(F.lit(0), F.floor(at(x0, width))), F.greatest(F.lit(0), F.floor(at(y0, height)))
    right, bottom = F.least(F.lit(width), F.ceil(at(x1, width))), F.least(F.lit(height), F.ceil(at(y1, height)))
    return F.when((right > left) & (bottom > top), F.struct(left.alias("left"), top.alias("top"), (right - left).alias("width"), (bottom - top).alias("height")))


def rounded_crop(y0: Column, x0: Column, y1: Column, x1: Column, width: int, height: int) -> Column:
    """pixels of a box, each edge rounded half up, one pixel wide at least and not beyond the page."""
    at = lambda v, n: F.floor(v / 1000 * n + 0.5)
    left, top = at(x0, width), at(y0, height)
    return F.struct(left.alias("left"), top.alias("top"), F.greatest(F.lit(1), F.least(width - left, at(x1 - x0, width))).alias("width"), F.greatest(F.lit(1), F.least(height - top, at(y1 - y0, height))).alias("height"))


def answer_focus(rows: DataFrame, pad: float = 25.0) -> DataFrame:
    """the box around an answer's marks: the union of prompt and options, padded by ``pad``."""
    return region_union(rows, pad)


def clamped(c: Column) -> Column:
    """within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def dpi_scale(dpi: Column) -> Column:
    """a page's points are 1/72 inch."""
    return dpi / 72


def solver_requests(rows: Column, per_request: int) -> Column:
    """F35."""
    return F.ceil(rows / per_request)
