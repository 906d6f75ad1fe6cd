"""Editions as rows: each block's HTML in order; languages; metadata of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code, language of the page, title of the contents, font.
LANGUAGES = [("zh", "zh-CN", "目录", "Noto Serif SC"), ("en", "en", "Table of Contents", "Georgia"), ("ja", "ja", "目次", "Noto Serif JP"), ("ko", "ko", "목차", "Noto Serif KR"), ("fr", "fr", "Table des matières", "Georgia"), ("de", "de", "Inhaltsverzeichnis", "Georgia"), ("es", "es", "Índice", "Georgia")]


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "code string, html_lang string, toc_title string, font string")


def escaped(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def edition(blocks: DataFrame) -> DataFrame:
    """(doc_id, id, ord, html): a book as rows in order, so that it can be written as it is;
    text is escaped, formulas and tables are taken as they stand."""
    t = F.coalesce("text", F.lit(""))
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(6)).cast("string")
    wrap = lambda tag, body, cls="": F.concat(F.lit(f"<{tag}{cls}>"), body, F.lit(f"</{tag}>"))
    html = (
        F.when(F.col("kind") == "heading", F.concat(F.lit("<h"), level, F.lit(' id="'), F.col("id"), F.lit('">'), escaped(t), F.lit("</h"), level, F.lit(">")))
        .when(F.col("kind") == "formula", wrap("div", t, ' class="formula"')).when(F.col("kind") == "table", F.when(t.startswith("<table"), t).otherwise(wrap("pre", escaped(t))))
        .when(F.col("kind") == "caption", wrap("figcaption", escaped(t))).when(F.col("kind") == "footnote", wrap("p", escaped(t), ' class="footnote"'))
        .when(F.col("kind") == "figure", F.concat(F.lit('<figure><img src="'), escaped(F.regexp_extract(t, r"\(([^)]*)\)", 1)), F.lit('" alt="'), escaped(F.regexp_extract(t, r"!\[([^\]]*)\]", 1)), F.lit('"></figure>')))
        .otherwise(wrap("p", escaped(t)))
    )
    return blocks.select("doc_id", "id", "ord", html.alias("html"))


def _inner(markup: Column, tag: str) -> Column:
    raw = F.regexp_extract(markup, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.nullif(F.trim(F.regexp_replace(raw, r"<[^>]*>", "")), F.lit(""))


def html_title(markup: Column, stem: Column) -> Column:
    """The page's title, else its first h1, else the file's stem."""
    return F.coalesce(_inner(markup, "title"), _inner(markup, "h1"), stem)


def html_author(markup: Column) -> Column:
    return F.regexp_extract(markup, r"(?is)<meta\s[^>]*name=[\"']author[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)


def bilingual_edition(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """(doc_id, id, ord, html): each block in both languages where it has a translation (doc_id, id,
    body), figures and formulas once, the others as they stand."""
    b = blocks.join(translations.select("doc_id", "id", F.col("body").alias("_body")).dropDuplicates(["doc_id", "id"]), ["doc_id", "id"], "left")
    t = F.coalesce("text", F.lit(""))
    both = F.concat(F.lit('<div class="orig">'), escaped(t), F.lit('</div><div class="trans">'), escaped(F.col("_body")), F.lit("</div>"))
    once = F.when(F.col("kind").isin("figure", "formula"), t).otherwise(escaped(t))
    shown = F.when(F.col("_body").isNotNull() & ~F.col("kind").isin("figure", "formula"), both).otherwise(once)
    return b.select("doc_id", "id", "ord", F.concat(F.lit('<section class="block '), F.coalesce("kind", F.lit("text")), F.lit('">'), shown, F.lit("</section>")).alias("html"))


def edition_css(style: DataFrame, font: str = "Georgia") -> DataFrame:
    """(doc_id, css): a sheet for each row of ``geometry.page_style``: margins and the size of type
    measured there; a block is one line and a half high."""
    size = F.greatest(F.lit(8.0), F.least(F.lit(16.0), F.round(F.col("height") / 1.5, 1)))
    css = F.format_string("@page { margin: %.1fpt %.1fpt; }\nbody { font-family: %s; font-size: %.1fpt; line-height: 1.5; }\n", F.col("top"), F.col("left"), F.lit(font), size)
    return style.select("doc_id", css.alias("css"))


def ebook_html(markup: Column, css: Column) -> Column:
    """A page as e-book makers want it: the sheet within its head, one being made if there is none,
    and nothing underlined. Null gives null."""
    sheet = F.concat(F.lit("<style>\n"), css, F.lit("</style>"))
    plain = F.regexp_replace(markup, r"(?i)text-decoration\s*:\s*underline\s*;?", "")
    plain = F.regexp_replace(plain, r"(?i)\s*style\s*=\s*([\"'])\s*\1", "")
    head, html = r"(?i)<head(?:\s[^>]*)?>", r"(?i)<html(?:\s[^>]*)?>"
    put = lambda tag, what: F.concat(F.split(plain, tag, 2)[0], F.regexp_substr(plain, F.lit(tag)), what, F.split(plain, tag, 2)[1])
    made = F.concat(F.lit("<head>"), sheet, F.lit("</head>"))
    return F.when(plain.rlike(head), put(head, sheet)).when(plain.rlike(html), put(html, made)).otherwise(F.concat(made, plain))
