"""Boxes on pages: reading order, coverage, nearest styles, groups of figures, columns.

Boxes are (x0, y0, x1, y1) in points. Everything happens within a page, which bounds what
windows and pairs hold. Rows without a page or a box are left out."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import normalized
from folioflow.operators.graph import components


def boxes(blocks: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, id, page, x0, y0, x1, y1, keep...) of each block's first place."""
    r = F.try_element_at("source_refs", F.lit(1))
    b = blocks.select("doc_id", "id", *keep, r["page"].alias("page"), *(F.try_element_at(r["bbox"], F.lit(i + 1)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))
    return b.where("page is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null")


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(a1, b1) - F.greatest(a0, b0)


def reading_order(b: DataFrame, columns: int = 2, width: float | None = None, gap: float = 20.0) -> DataFrame:
    """(doc_id, id, page, place): top to bottom; with two columns, bands that a vertical gap
    parts are read one by one: what spans above, left column, right column, what spans between,
    what spans below."""
    page = Window.partitionBy("doc_id", "page")
    if columns <= 1:
        return b.withColumn("place", F.row_number().over(page.orderBy("y0", "x0", "id"))).select("doc_id", "id", "page", "place")
    by_y = page.orderBy("y0", "x0", "id")
    wide = F.lit(width) if width else F.max("x1").over(page) + F.min("x0").over(page)
    b = b.withColumn("_w", wide).withColumn("_top", F.max("y1").over(by_y.rowsBetween(Window.unboundedPreceding, -1)))
    b = b.withColumn("_band", F.sum(F.coalesce(F.col("y0") > F.col("_top") + gap, F.lit(False)).cast("int")).over(by_y.rowsBetween(Window.unboundedPreceding, 0)))
    mid = F.col("_w") / 2
    b = b.withColumn("_span", (F.col("x1") - F.col("x0") > F.col("_w") * 0.55) | ((F.col("x0") < mid - 30) & (F.col("x1") > mid + 30)))
    band = Window.partitionBy("doc_id", "page", "_band")
    low = F.min(F.when(~F.col("_span"), F.col("y0"))).over(band)
    high = F.max(F.when(~F.col("_span"), F.col("y1"))).over(band)
    b = b.withColumn("_low", low).withColumn("_high", high)
    rank = F.when(F.col("_span"), F.when(F.col("_low").isNull() | (F.col("y1") <= F.col("_low") + 10), 0).when(F.col("y0") >= F.col("_high") - 10, 4).otherwise(3)).when((F.col("x0") + F.col("x1")) / 2 < mid, 1).otherwise(2)
    place = F.row_number().over(page.orderBy("_band", rank, "y0", "x0", "id"))
    return b.withColumn("place", place).select("doc_id", "id", "page", "place")


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.select("doc_id", "page", *(F.col(c).alias(f"a_{c}") for c in a.columns if c not in ("doc_id", "page")))
    y = b.select("doc_id", "page", *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in ("doc_id", "page")))
    return x.join(y, ["doc_id", "page"])


def covered(items: DataFrame, containers: DataFrame, share: float = 0.8, pad: float = 3.0) -> DataFrame:
    """Items of which a container of their page, widened by ``pad``, covers at least the share;
    boxes without area are covered by nothing."""
    p = _pairs(items, containers)
    w = F.greatest(overlap(F.col("a_x0"), F.col("a_x1"), F.col("b_x0") - pad, F.col("b_x1") + pad), F.lit(0.0))
    h = F.greatest(overlap(F.col("a_y0"), F.col("a_y1"), F.col("b_y0") - pad, F.col("b_y1") + pad), F.lit(0.0))
    area = F.greatest(F.col("a_x1") - F.col("a_x0"), F.lit(0.0)) * F.greatest(F.col("a_y1") - F.col("a_y0"), F.lit(0.0))
    hit = p.where((area > 0) & (F.col("a_id") != F.col("b_id"))).where(w * h >= share * area).select("doc_id", F.col("a_id").alias("id")).distinct()
    return items.join(hit, ["doc_id", "id"], "left_semi")


def same_figure(p: DataFrame, row_gap: float = 90.0, column_gap: float = 36.0) -> Column:
    """Whether two boxes (a_, b_) belong to one figure: one holds the other, they stand in one
    row, or one above the other."""
    h = overlap(F.col("a_x0"), F.col("a_x1"), F.col("b_x0"), F.col("b_x1"))
    v = overlap(F.col("a_y0"), F.col("a_y1"), F.col("b_y0"), F.col("b_y1"))
    wa, ha, wb, hb = (F.col(f"{s}_{d}1") - F.col(f"{s}_{d}0") for s, d in (("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")))
    small = F.least(wa * ha, wb * hb)
    held = (small > 0) & (F.greatest(h, F.lit(0.0)) * F.greatest(v, F.lit(0.0)) >= 0.85 * small)
    return held | ((v >= 0.5 * F.least(ha, hb)) & (-h <= row_gap)) | ((h >= 0.5 * F.least(wa, wb)) & (-v <= column_gap))


def figure_groups(figures: DataFrame) -> DataFrame:
    """(doc_id, page, figure, n, x0, y0, x1, y1): connected groups of a page's figures with the
    box around them; ``figure`` is the least id of the group."""
    name = lambda d, i: F.concat_ws("\0", d, i)
    p = _pairs(figures, figures).where("a_id < b_id")
    edges = p.where(same_figure(p)).select(name("doc_id", "a_id").alias("a"), name("doc_id", "b_id").alias("b"))
    roots = components(figures.select(name("doc_id", "id").alias("node")).distinct(), edges)
    f = figures.withColumn("node", name("doc_id", "id")).join(roots, "node")
    g = f.groupBy("doc_id", "page", "root").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return g.select("doc_id", "page", F.element_at(F.split("root", "\0"), -1).alias("figure"), "n", "x0", "y0", "x1", "y1")


def nearest(items: DataFrame, value: str, levels: list[float]) -> Column:
    """The number of the level whose value is closest; of two, the first."""
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(value) - v).alias("d"), F.lit(i + 1).alias("i")) for i, v in enumerate(levels))))
    return best["i"]


def page_style(b: DataFrame) -> DataFrame:
    """(doc_id, n_pages, left, top, right, bottom, height): margins and the usual height of a
    block, by the most frequent value of rounded heights weighted by text, ties to the smaller."""
    m = b.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"), F.min("x0").alias("left"), F.min("y0").alias("top"), F.max("x1").alias("right"), F.max("y1").alias("bottom"))
    w = b.groupBy("doc_id", F.round(F.col("y1") - F.col("y0"), 1).alias("height")).agg(F.sum(F.least(F.lit(300), F.length("text"))).alias("k"))
    h = w.groupBy("doc_id").agg(F.max_by("height", F.struct("k", -F.col("height"))).alias("height"))
    return m.join(h, "doc_id")


def page_columns(b: DataFrame, least: int = 3, chars: int = 35) -> DataFrame:
    """(doc_id, page, columns): 2 where both halves have at least three blocks of prose and a
    gutter lies between the medians of their inner edges."""
    w = F.max("x1").over(Window.partitionBy("doc_id", "page")) + F.min("x0").over(Window.partitionBy("doc_id", "page"))
    p = b.where(F.length("text") >= chars).withColumn("_w", w)
    left, right = F.col("x1") <= F.col("_w") * 0.54, F.col("x0") >= F.col("_w") * 0.45
    g = p.groupBy("doc_id", "page").agg(F.count_if(left).alias("nl"), F.count_if(right).alias("nr"), F.median(F.when(left, F.col("x1"))).alias("l"), F.median(F.when(right, F.col("x0"))).alias("r"))
    two = (F.col("nl") >= least) & (F.col("nr") >= least) & (F.col("r") - F.col("l") > 2)
    return g.select("doc_id", "page", F.when(two, 2).otherwise(1).alias("columns"))


def page_route(b: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_thin, n_chars, scan_like): a book is like a scan if 35 % of its pages
    have under 20 characters, or all of it under 12 a page or 80."""
    p = b.groupBy("doc_id", "page").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("k"))
    g = p.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("k") < 20).alias("n_thin"), F.sum("k").alias("n_chars"))
    return g.withColumn("scan_like", (F.col("n_thin") >= 0.35 * F.col("n_pages")) | (F.col("n_chars") < F.greatest(F.lit(80), 12 * F.col("n_pages"))))


def likely_page(items: DataFrame, lines: DataFrame, least: float = 0.35) -> DataFrame:
    """(doc_id, id, found): of an item's page and the next one the page with the line that
    resembles its text most, if that is alike enough; ties to the first."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if x and y else 0.0 for x, y in zip(a, b)])

    i = items.select("doc_id", "id", normalized(F.col("text")).alias("a"), F.explode(F.array("page", F.col("page") + 1)).alias("page"))
    j = i.join(lines.select("doc_id", "page", normalized(F.col("text")).alias("b")), ["doc_id", "page"]).withColumn("r", ratio("a", "b"))
    best = j.groupBy("doc_id", "id").agg(F.max(F.struct("r", -F.col("page"))).alias("m"))
    return best.select("doc_id", "id", F.when(F.col("m.r") >= least, -F.col("m.col2")).alias("found"))


def heading_sizes(b: DataFrame, above: float = 1.15, most: int = 6) -> DataFrame:
    """(doc_id, size, place): the heights of a book's heading boxes that are so much above the usual
    height of its blocks, the ``most`` greatest of them from the greatest down."""
    usual = page_style(b).select("doc_id", "height")
    sizes = b.where("kind = 'heading'").select("doc_id", F.round(F.col("y1") - F.col("y0"), 1).alias("size")).distinct().join(usual, "doc_id").where(F.col("size") >= above * F.col("height"))
    top = F.slice(F.sort_array(F.collect_set("size"), asc=False), 1, most)
    return sizes.groupBy("doc_id").agg(top.alias("t")).select("doc_id", F.posexplode("t").alias("place", "size")).select("doc_id", "size", (F.col("place") + 1).alias("place"))


def column_mode(pages: DataFrame) -> DataFrame:
    """(doc_id, columns): of a book's pages (doc_id, page, columns) the usual number, of two as usual the smaller."""
    n = pages.groupBy("doc_id", "columns").agg(F.count("*").alias("k"))
    return n.groupBy("doc_id").agg(F.max_by("columns", F.struct("k", -F.col("columns"))).alias("columns"))


def routed_pages(b: DataFrame, thin: int = 20) -> DataFrame:
    """(doc_id, page, route): ``scan`` for pages with hardly any text in books that look like
    scans, ``layout`` for those with formulas or two columns, else ``text``."""
    p = b.groupBy("doc_id", "page").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("k"), F.count_if(F.col("kind") == "formula").alias("f"))
    p = p.join(page_columns(b), ["doc_id", "page"], "left").join(page_route(b).select("doc_id", "scan_like"), "doc_id")
    return p.select("doc_id", "page", F.when(F.col("scan_like") & (F.col("k") < thin), "scan").when((F.col("f") > 0) | (F.col("columns") == 2), "layout").otherwise("text").alias("route"))


def embedded_labels(b: DataFrame, chars: int = 120, pad: float = 0.0) -> DataFrame:
    """(doc_id, page, figure, id): short texts, but no captions, that overlap a figure of their page, or
    stand less than ``pad`` above or below it."""
    f = b.where("kind = 'figure'").select("doc_id", "page", F.col("id").alias("figure"), *(F.col(c).alias("f" + c) for c in ("x0", "y0", "x1", "y1")))
    t = b.where((F.col("kind") == "text") & (F.length(F.trim("text")).between(1, chars)) & ~F.col("text").rlike(CAPTION_START))
    j = t.join(f, ["doc_id", "page"]).where((overlap(F.col("x0"), F.col("x1"), F.col("fx0"), F.col("fx1")) > 0) & (overlap(F.col("y0"), F.col("y1"), F.col("fy0"), F.col("fy1")) > -pad))
    return j.select("doc_id", "page", "figure", "id")


def caption_records(b: DataFrame) -> DataFrame:
    """(doc_id, page, record, n_parts, text, x0, y0, x1, y1): captions of a page from left to right and
    down, one that begins like a caption with those after it that do not; what stands before the first
    such is left out, unless there is none on the page."""
    c = b.where((F.col("kind") == "caption") & (F.trim("text") != "")).withColumn("starts", F.col("text").rlike(CAPTION_START).cast("int"))
    page = Window.partitionBy("doc_id", "page")
    c = c.withColumn("record", F.sum("starts").over(page.orderBy("x0", "y0", "id"))).withColumn("_any", F.max("starts").over(page)).where("record > 0 or _any = 0")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "y0", "id", F.trim("text").alias("t")))), lambda x: x["t"]), " ")
    return c.groupBy("doc_id", "page", F.col("record").cast("int").alias("record")).agg(F.count("*").alias("n_parts"), parts.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


#: Fixed value: how captions begin.
CAPTION_START = r"^\s*(?i:fig(?:ure)?|table|图|表)\.?\s*\d"


def grown_boxes(boxes: list[tuple[float, ...]], near: float = 10.0) -> list[list[float]]:
    """Boxes of which any two no more than ``near`` apart have become one box around both, again
    and again, until no two are. The result does not depend on their order."""
    todo, done = [list(b) for b in boxes], []
    while todo:
        a = todo.pop()
        for i, m in enumerate(done):
            if a[0] <= m[2] + near and m[0] - near <= a[2] and a[1] <= m[3] + near and m[1] - near <= a[3]:
                del done[i]
                todo.append([min(a[0], m[0]), min(a[1], m[1]), max(a[2], m[2]), max(a[3], m[3])])
                break
        else:
            done.append(a)
    return sorted(done)


def image_boxes(b: DataFrame, width: float | None = None, height: float | None = None, near: float = 10.0) -> DataFrame:
    """(doc_id, page, n, x0, y0, x1, y1): figures' boxes of each page, grown together. Given the page's
    size, boxes of three quarters of it and more, which are scanned pages, are left out."""
    if width and height:
        b = b.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) < 0.75 * width * height)
    every = b.groupBy("doc_id", "page").agg(F.collect_list(F.array("x0", "y0", "x1", "y1")).alias("b"))

    @F.pandas_udf("array<array<double>>")
    def grown(s: pd.Series) -> pd.Series:
        return pd.Series([grown_boxes([tuple(x) for x in page], near) for page in s])

    r = every.select("doc_id", "page", F.posexplode(grown("b")).alias("n", "m"))
    return r.select("doc_id", "page", (F.col("n") + 1).alias("n"), *(F.col("m")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


def figure_runs(b: DataFrame, row_gap: float = 90.0, column_gap: float = 36.0) -> DataFrame:
    """(doc_id, page, run, n): figures of a page in reading order (y0, x0, id); one joins the run before
    it if it stands beside or below the figure before it (``same_figure`` of neighbours only)."""
    page = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "id")
    p = b.select("doc_id", "page", "id", *(F.col(c) for c in ("x0", "y0", "x1", "y1")), *(F.lag(c).over(page).alias("_" + c) for c in ("x0", "y0", "x1", "y1")))
    h, v = overlap(F.col("x0"), F.col("x1"), F.col("_x0"), F.col("_x1")), overlap(F.col("y0"), F.col("y1"), F.col("_y0"), F.col("_y1"))
    row = (v >= 0.5 * F.least(F.col("y1") - F.col("y0"), F.col("_y1") - F.col("_y0"))) & (-h <= row_gap)
    column = (h >= 0.5 * F.least(F.col("x1") - F.col("x0"), F.col("_x1") - F.col("_x0"))) & (-v <= column_gap)
    p = p.withColumn("_new", F.when(F.coalesce(row | column, F.lit(False)), 0).otherwise(1))
    return p.withColumn("run", F.sum("_new").over(page)).groupBy("doc_id", "page", F.col("run").cast("int").alias("run")).agg(F.count("*").alias("n"))
