"""Page formats from their line tables: headings by size, printed pages, styles, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import constants as K
from lectern.functions import text as X
from lectern.operators import structure
from lectern.operators.joins import attached, cut
from lectern.operators.prefix import numbered

HEADING_RATIO = 1.18
#: OCR: headings and body stand between these shares of the page's height; a heading is so much higher than body lines.
TOP_BAND, BOTTOM_BAND, OCR_RATIO = 1 / 16, 0.95, 1.18
LEAST_PAGE_CHARS = 20
VERTICAL_RATIO, LARGE, SMALL = 0.3, 1.15, 0.85


def body_size(lines: DataFrame, book: str = "book") -> DataFrame:
    """book, body: the size at half of all sizes in order."""
    return structure.upper_median(lines, [book], "size", "body")


def headings(lines: DataFrame, sizes: DataFrame, book: str = "book") -> DataFrame:
    """book, page, y, text: short lines well above the body's size that hold a word; the last line of each height counts."""
    words = F.col("text").rlike(K.CJK) | F.col("text").rlike("[A-Za-z0-9_]+")
    usable = lines.join(sizes, book).where((F.length("text") <= K.HEADING_CHARS) & words & ~F.col("text").rlike("^[0-9]+$") & (F.col("size") >= HEADING_RATIO * F.col("body")))
    return usable.groupBy(book, "page", "y").agg(F.max_by("text", "ord").alias("text"))


def span_styles(spans: DataFrame, sizes: DataFrame, keys: tuple[str, ...] = ("book", "page", "block")) -> DataFrame:
    """spans (keys, ord, text, size, flags, y [, font]) with style: bold and italic by flags or the font's name; raised or lowered by flags, or against the block's baseline (that of its
    largest span, the first of several); large or small against the body, unless raised or lowered."""
    font = F.lower(F.coalesce("font", F.lit(""))) if "font" in spans.columns else F.lit("")
    known = F.when(F.col("size") > 0, F.col("y"))
    base = F.max_by(known, F.when(known.isNotNull(), F.struct("size", -F.col("ord")))).over(Window.partitionBy(*keys))
    shift, ratio = (F.col("__base") - F.col("y")) / F.nullif("size", F.lit(0)), F.nullif("size", F.lit(0)) / F.nullif("body", F.lit(0))
    flagged = F.col("flags").bitwiseAND(1) != 0
    up, down = F.coalesce(flagged | (shift > VERTICAL_RATIO), F.lit(False)), F.coalesce(~flagged & (shift < -VERTICAL_RATIO), F.lit(False))
    tokens = F.array_compact(
        F.array(
            F.when((F.col("flags").bitwiseAND(16) != 0) | font.rlike("bold|black$|-heavy$"), "b"),
            F.when((F.col("flags").bitwiseAND(2) != 0) | font.rlike("italic|oblique"), "i"),
            F.when(up, "sup").when(down, "sub"),
            F.when(up | down, None).when(ratio >= LARGE, "lg").when(ratio <= SMALL, "sm"),
        )
    )
    # Sizes first: what follows may go on by the keys.
    return attached(spans, sizes, [keys[0]]).withColumn("__base", base).withColumn("style", tokens).drop("body", "__base")


def in_band(y0: Column, y1: Column, height: Column) -> Column:
    return (y0 >= height * TOP_BAND) & (y1 <= height * BOTTOM_BAND)


def ocr_rows(ocr_lines: DataFrame, book: str = "book") -> DataFrame:
    """book, page, ord, text, heading: what OCR read of each page within its band, in reading order; a heading looks like one and is high."""
    sized = ocr_lines.withColumn("height", F.col("y1") - F.col("y0"))
    tall = sized.join(structure.body_height(sized, book).withColumnRenamed("height", "body"), book, "left").where(in_band(F.col("y0"), F.col("y1"), F.col("page_h")))
    looks = F.col("text").rlike(K.PAGE_CHAPTER_TITLE) | F.col("text").rlike(K.SECTION_TITLE)
    heading = looks & (F.length("text") <= K.HEADING_CHARS) & (F.col("height") >= OCR_RATIO * F.col("body"))
    place = F.row_number().over(Window.partitionBy(book, "page").orderBy("y0", "x0", "ord"))
    return tall.withColumn("place", place).select(book, "page", F.col("place").alias("ord"), "text", F.coalesce(heading, F.lit(False)).alias("heading"))


def printed_numbers(ocr_lines: DataFrame, book: str = "book") -> DataFrame:
    """book, page, ord, number: lines outside the band that are numbers alone."""
    bare = X.strip(F.col("text"))
    return ocr_lines.where(~in_band(F.col("y0"), F.col("y1"), F.col("page_h")) & bare.rlike("^[0-9]{1,4}$")).select(book, "page", "ord", bare.cast("int").alias("number"))


def ocr_book(ocr_lines: DataFrame, book: str = "book") -> DataFrame:
    """book, chapter, page (as printed), kind, paragraph, text: pages of LEAST_PAGE_CHARS or more, headings apart, body lines reflowed between them."""
    rows = ocr_rows(ocr_lines, book)
    full = rows.groupBy(book, "page").agg(F.sum(F.length("text")).alias("chars")).where(F.col("chars") >= LEAST_PAGE_CHARS).select(book, "page")
    offset = structure.page_offset(printed_numbers(ocr_lines, book), book)
    kept = rows.join(full, [book, "page"], "left_semi")
    upto = Window.partitionBy(book).orderBy("page", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chapters = F.greatest(F.sum((F.col("heading") & F.col("text").rlike(K.PAGE_CHAPTER_TITLE)).cast("int")).over(upto), F.lit(1))
    placed = kept.withColumn("chapter", chapters).withColumn("run", F.sum(F.col("heading").cast("int")).over(upto)).withColumn("pos", F.row_number().over(Window.partitionBy(book).orderBy("page", "ord")))
    key = F.struct(book, "chapter", "page", "run")
    body = structure.reflow(placed.where(~F.col("heading")).withColumn("k", key), None, "k").select("k.*", "paragraph", "text", F.lit("p").alias("kind"))
    titles = placed.where("heading").select(book, "chapter", "page", "run", F.lit(-1).cast("long").alias("paragraph"), "text", F.lit("heading").alias("kind"))
    return body.unionByName(titles).join(offset, book, "left").withColumn("page", F.greatest(F.col("page") + F.coalesce("page_offset", F.lit(0)), F.lit(1))).drop("page_offset")


def without_title(paragraphs: DataFrame, title: str = "title", text: str = "text", runs: str | None = None) -> DataFrame:
    """paragraphs whose text does not repeat the title before it, whatever spaces either has; a text that is the title alone stays. runs lose the same characters."""
    solid = F.length(F.replace(F.col(title), F.lit(" "), F.lit("")))
    same = (solid > 0) & F.startswith(F.replace(F.col(text), F.lit(" "), F.lit("")), F.replace(F.col(title), F.lit(" "), F.lit("")))
    # As many signs as the title has, with the spaces before, between and after them.
    lost = F.length(F.call_function("regexp_extract", F.col(text), F.concat(F.lit("^(?: *[^ ]){"), solid.cast("string"), F.lit("} *")), F.lit(0)))
    out = paragraphs.withColumn("__lost", F.when(same, lost).otherwise(0)).withColumn("__lost", F.when(F.col("__lost") < F.length(text), F.col("__lost")).otherwise(0))
    if runs:
        out = out.withColumn(runs, F.when(F.col("__lost") > 0, stripped_runs(F.col(runs), F.col("__lost"))).otherwise(F.col(runs)))
    return out.withColumn(text, F.substr(F.col(text), F.col("__lost") + 1)).drop("__lost")


def bookmarks(marks: DataFrame, book: str = "book") -> DataFrame:
    """Marks (book, page, title, level, ord), each page and title once, noise titles gone."""
    first = F.row_number().over(Window.partitionBy(book, "page", "title").orderBy("ord"))
    return marks.where(~X.is_noise_title(F.col("title"))).withColumn("__n", first).where("__n = 1").drop("__n")


def stripped_runs(runs: Column, count: Column) -> Column:
    """runs (text, style) without their first characters, so that they stay in step with a text that has lost them."""
    before = F.transform(runs, lambda r, i: F.struct(F.aggregate(F.slice(runs, 1, i), F.lit(0), lambda n, x: n + F.length(x["text"])).alias("at"), r["text"].alias("text"), r["style"].alias("style")))
    cut = F.transform(before, lambda r: F.struct(F.substr(r["text"], F.greatest(count - r["at"], F.lit(0)) + 1).alias("text"), r["style"].alias("style")))
    return F.filter(cut, lambda r: r["text"] != "")


def chapter_starts(lines: DataFrame, marks: DataFrame, pages: DataFrame, title: str = K.NO_TITLE, book: str = "book") -> DataFrame:
    """book, num, title, page_start, page_end (from 0): by the outline (marks: book, ord, level, title, page from 1), else by large lines of the first
    HEADING_PAGES pages below the page's head, else the whole book. lines: book, page (from 0), y, ord, size, height, text; pages: book, pages."""
    levels = structure.page_chapter_level(structure.level_counts(marks.withColumnRenamed("title", "text"), book=book), book=book)
    chosen = bookmarks(marks, book).join(levels, book).where(F.col("level") == F.col("chapter_level")).join(pages, book)
    page = F.least(F.greatest(F.col("page") - 1, F.lit(0)), F.col("pages") - 1).cast("int")
    outline = chosen.select(book, page.alias("page"), X.strip(F.col("title")).alias("title"), F.col("ord").cast("double").alias("place"))
    outline = outline.groupBy(book, "page", "title").agg(F.min("place").alias("place"))
    heights = lines.groupBy(book, "page").agg(F.max("height").alias("height"))
    large = headings(lines.where(F.col("page") < K.HEADING_PAGES), body_size(lines, book), book).join(heights, [book, "page"]).where(F.col("y") >= F.col("height") * TOP_BAND)
    large = large.join(outline.select(book).distinct(), book, "left_anti").select(book, F.col("page").cast("int").alias("page"), F.col("text").alias("title"), F.col("y").cast("double").alias("place"))
    told = outline.unionByName(large)
    whole = pages.join(told.select(book).distinct(), book, "left_anti").select(book, F.lit(0).alias("page"), F.lit(title).alias("title"), F.lit(0.0).alias("place"))
    order = Window.partitionBy(book).orderBy("page", "place")
    placed = told.unionByName(whole).withColumn("num", F.row_number().over(order)).withColumn("next", F.lead("page").over(order)).join(pages, book)
    return placed.select(book, "num", "title", F.col("page").alias("page_start"), F.greatest(F.coalesce(F.col("next") - 1, F.col("pages") - 1), F.col("page")).cast("int").alias("page_end"))


def page_book(lines: DataFrame, marks: DataFrame, assets: DataFrame, title: str = K.NO_TITLE, book: str = "book", spans: DataFrame | None = None) -> DataFrame:
    """book, num, title, page_start, page_end, seq, page (from 1), kind, text: a book of pages, with images and tables where they stand.

    assets: book, page, y, kind (image or table), text, area. Small images go, and tables of books over TABLE_PAGES pages. Lines that recur on a chapter's pages
    go, lines are joined to paragraphs page by page, and a chapter's first paragraph loses the chapter's title. Chapters that share a page both have it.
    spans (book, page, block, ord of the line, span, text, size, flags, y [, font]): with them a column runs has each paragraph's text in pieces of one style."""
    counted = lines.select(book, "page").unionByName(assets.select(book, "page")).groupBy(book).agg((F.max("page") + 1).cast("int").alias("pages"))
    starts = cut(chapter_starts(lines, marks, counted, title, book))
    # A chapter's pages, so that lines and assets meet their chapters by page.
    held = cut(starts.select(book, "num", F.explode(F.sequence("page_start", "page_end")).alias("page")))
    placed = lines.join(held, [book, "page"]).select(F.struct(F.col(book).alias("book"), "num").alias("k"), "page", "y", "ord", "text")
    margins = structure.margin_lines(placed, "k")
    bare = placed.withColumn("line", X.line_form(F.col("text"))).join(margins, ["k", "line"], "left_anti").withColumn("p", F.struct("k", "page"))
    bare = bare.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy("y", "ord")))
    if spans is None:
        body = structure.reflow(bare, None, "p", "n", least=["y"])
    else:
        bare = cut(bare)
        styled = span_styles(spans.withColumnRenamed("ord", "__line").withColumnRenamed("span", "ord"), body_size(lines, book), (book, "page", "block"))
        runs = bare.select("p", "n", F.col("k.book").alias(book), "page", F.col("ord").alias("__line")).join(styled.select(book, "page", "__line", F.col("ord").alias("span"), "text", "style"), [book, "page", "__line"])
        body = structure.reflow_runs(bare, runs.select("p", "n", "span", "text", "style"), None, "p", "n", least=["y"])
    more = ["runs"] if spans is not None else []
    body = body.select("p.k", "p.page", "y", F.col("paragraph").alias("ord"), F.when(X.looks_like_formula(F.col("text")), "formula").otherwise("p").alias("kind"), "text", *more)
    used = assets.join(counted, book).where(((F.col("kind") == "image") & (F.col("area") >= 4000)) | ((F.col("kind") == "table") & (F.col("pages") <= K.TABLE_PAGES)))
    shown = used.join(held, [book, "page"]).select(F.struct(F.col(book).alias("book"), "num").alias("k"), "page", "y", F.lit(1 << 40).alias("ord"), "kind", F.when(F.col("kind") == "image", K.IMAGE_TEXT).otherwise(F.col("text")).alias("text"), *[F.array().cast("array<struct<text:string,style:array<string>>>").alias(c) for c in more])
    every = numbered(body.unionByName(shown), ["k"], ["page", "y", "ord", "kind", "text"], "seq")
    named = every.select(F.col("k.book").alias(book), "k.num", "seq", "page", "kind", "text", *more).join(starts, [book, "num"])
    first = without_title(named, runs="runs" if more else None).select(*named.columns)
    whole = first.where("seq = 1").unionByName(named.where("seq > 1"))
    return whole.select(book, "num", "title", (F.col("page_start") + 1).alias("page_start"), (F.col("page_end") + 1).alias("page_end"), "seq", (F.col("page") + 1).cast("int").alias("page"), "kind", "text", *more)
