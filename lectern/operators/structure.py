"""From lines to books: levels, chapters, sections, pages, paragraphs.

Rows of a book are ordered by pos; every operator works on all books at once. Loops over rows are running sums (prefix.running, in two levels, so that a
book of any size is spread over many tasks) and gaps-and-islands; what belongs to a book or a chapter is an aggregate that is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import constants as K
from lectern.functions import text as X
from lectern.operators.joins import attached, cut, small
from lectern.operators.prefix import PART, numbered, running


def lines(texts: DataFrame, text: str = "text", book: str = "book") -> DataFrame:
    """book, pos, raw of each line."""
    return texts.select(book, F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")).alias("pos", "raw"))


def outline_rows(rows: DataFrame, dialect: str = "a", book: str = "book") -> DataFrame:
    """book, pos, text, level of lines (book, pos, raw) in Markdown or plain text. A heading's level is its number of # signs (6 at most in dialect a,
    9 in b); fence lines go; what is fenced is body text in dialect a and goes in dialect b."""
    bare = X.strip(F.col("raw"))
    fenced = rows.withColumn("text", bare).withColumn("mark", F.col("text").startswith("```") | F.col("text").startswith("~~~"))
    fenced = running(fenced, [book], "pos", {"marks": F.col("mark").cast("int")}).withColumn("inside", (F.col("marks") % 2) == 1).where(~F.col("mark"))
    most = 6 if dialect == "a" else 9
    pattern = f"^(#{{1,{most}}})\\s+(.*?)\\s*#*\\s*$"
    heading = ~F.col("inside") & F.col("text").startswith("#") & F.col("text").rlike(pattern)
    out = fenced.withColumn("level", F.when(heading, F.length(F.regexp_extract("text", pattern, 1))).otherwise(0)).withColumn("text", F.when(heading, F.regexp_extract("text", pattern, 2)).otherwise(F.col("text")))
    if dialect == "b":
        out = out.where(~F.col("inside"))
    return out.select(book, "pos", "text", "level")


def level_counts(rows: DataFrame, pattern: str = K.CHAPTER_TITLE, book: str = "book") -> DataFrame:
    """book, level, n, hits: headings by level, and those that look like a chapter's title."""
    usable = rows.where((F.col("level") >= 1) & ~X.blank(F.col("text")) & ~X.is_noise_title(F.col("text")))
    return usable.groupBy(book, "level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").rlike(pattern)).alias("hits"))


def page_chapter_level(counts: DataFrame, most: int = 80, least: int = 3, book: str = "book") -> DataFrame:
    """book, chapter_level, from bookmarks: the shallowest level with least hits that are half of it; else the shallowest, unless it has one entry and a deeper one has least to most."""
    first = F.min("level")
    hit = F.min(F.when((F.col("hits") >= least) & (F.col("hits") * 2 >= F.col("n")), F.col("level")))
    some = F.min(F.when(F.col("n").between(least, most), F.col("level")))
    return counts.groupBy(book).agg(F.coalesce(hit, F.when(F.min_by("n", "level") < 2, F.coalesce(some, first)).otherwise(first)).alias("chapter_level"))


def outline_levels(rows: DataFrame, book: str = "book") -> DataFrame:
    """book, chapter_level of rows (book, pos, text, level), from each book's outline; null means that chapters are told by the text of body lines."""
    title = F.col("text").rlike(K.CHAPTER_TITLE)
    usable = (F.col("level") >= 1) & ~X.blank(F.col("text")) & ~X.is_noise_title(F.col("text"))
    counts = rows.groupBy(book, "level").agg(F.count_if(usable).alias("n"), F.count_if(usable & title).alias("hits"), F.count_if(title).alias("titles"))

    def least(condition: Column) -> Column:
        return F.min(F.when((F.col("n") > 0) & condition, F.col("level")))

    clear, some, first = least((F.col("hits") >= 2) & (F.col("hits") * 2 >= F.col("n"))), least(F.col("hits") >= 1), least(F.lit(True))
    alone = F.min_by("n", F.when(F.col("n") > 0, F.col("level"))) == 1
    lone = alone & (F.coalesce(F.max(F.when(F.col("level") == 0, F.col("titles"))), F.lit(0)) >= 2)
    return counts.groupBy(book).agg(F.coalesce(clear, some, F.when(~F.coalesce(lone, F.lit(False)), first)).alias("chapter_level"))


def leveled(rows: DataFrame, book: str = "book") -> DataFrame:
    """rows (book, pos, text, level) with chapter_level (see outline_levels). rows is read twice: cut it before if it is costly."""
    return attached(rows, cut(outline_levels(rows, book)), [book])


def chapter_level(rows: DataFrame, book: str = "book") -> DataFrame:
    """book, chapter_level (see leveled)."""
    return outline_levels(rows, book)


def titled(rows: DataFrame, book: str = "book") -> DataFrame:
    """book, title: the first level-1 heading of a book whose chapters are deeper; empty otherwise."""
    # Of a book only its first heading meets the book's level, not its rows.
    first = rows.groupBy(book).agg(F.min_by("text", F.when((F.col("level") == 1) & F.col("text").isNotNull(), F.col("pos"))).alias("top"))
    return attached(first, outline_levels(rows, book), [book]).select(book, F.coalesce(X.strip(F.when(F.col("chapter_level") > 1, F.col("top"))), F.lit("")).alias("title"))


def _begins(fragments: DataFrame, book: str, amounts: Sequence[str], *carried: Column) -> DataFrame:
    """A row a part of a book, with the sums of amounts over the parts before it. fragments: what a part has of a chapter."""
    earlier = Window.partitionBy(book).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = fragments.groupBy(book, "__part").agg(*[F.sum(a).alias(a) for a in amounts], *carried)
    return parts.withColumns({a: F.coalesce(F.sum(a).over(earlier), F.lit(0)) for a in amounts} | {"__rank": F.lit(0)})


def _counts(fragments: DataFrame, nums: DataFrame, book: str) -> DataFrame:
    """fragments with their chapter's num and its rows in earlier parts."""
    earlier = Window.partitionBy(book, "chapter").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = fragments.select(book, "__part", "chapter", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__rows"), F.lit(1).alias("__rank"))
    return attached(before, nums, [book, "chapter"])


def _outlined(rows: DataFrame, levels: DataFrame | None, book: str, part: int, counted: bool) -> DataFrame:
    """book, pos, chapter, title, kind, text of the rows that are no chapter's title, and, if counted, num, seq, page.

    Chapters are told on rows without their texts first. What a part of a book has to know of the parts before it, and of its book, are rows that stand before its own, so
    texts are shuffled once, by parts, and never written. rows is read several times: cut it before if it is costly."""
    by_text, noise = F.col("chapter_level").isNull(), X.is_noise_title(F.col("text"))
    shallow = F.coalesce((F.col("level") >= 1) & (F.col("level") < F.col("chapter_level")), F.lit(False))
    starts = F.when(by_text, F.col("text").rlike(K.CHAPTER_TITLE)).otherwise(F.col("level") == F.col("chapter_level")) & ~noise
    dealt = F.floor(F.col("pos") / part)
    bare = rows.where(~X.blank(F.col("text"))).select(book, "pos", X.strip(F.col("text")).alias("text"), "level")

    # Of a line: whether its text may be a title, and its length.
    titles = {"__may": ~noise, "__like": F.col("text").rlike(K.CHAPTER_TITLE), "__size": F.length("text")}
    thin = bare.select(book, "pos", "level", *[c.alias(n) for n, c in titles.items()])
    placed = thin.join(levels, book) if levels is not None else attached(thin, cut(outline_levels(rows, book)), [book])
    kept = placed.where(~shallow).withColumn("starts", F.when(by_text, F.col("__like")).otherwise(F.col("level") == F.col("chapter_level")) & F.col("__may"))
    chaptered = running(kept, [book], "pos", {"chapter": F.col("starts").cast("int")}, part=part).withColumn("chapter", F.greatest("chapter", F.lit(1)))
    fragments = cut(
        chaptered.groupBy(book, dealt.alias("__part"), "chapter").agg(
            F.count_if("starts").alias("__starts"), F.count_if(~F.col("starts")).alias("__rows"), F.coalesce(F.sum(F.when(~F.col("starts"), F.col("__size"))), F.lit(0)).alias("__chars"),
            F.max(F.when(F.col("starts"), F.col("pos"))).alias("__title"), F.max("chapter_level").alias("chapter_level"),
        )
    )

    # A title that stands in another part than some of its chapter's rows.
    titled_at = fragments.withColumn("__at", F.max("__title").over(Window.partitionBy(book, "chapter")))
    lacking = small(titled_at.where(F.col("__title").isNull() & F.col("__at").isNotNull()).select(F.col(book).alias("__book"), "__part", "chapter", "__at", "chapter_level"))
    carried = bare.join(lacking, F.col(book).eqNullSafe(F.col("__book")) & (F.col("pos") == F.col("__at"))).where(starts).select(book, "__part", "chapter", F.col("text").alias("title"), F.lit(1).alias("__rank"))

    heads = [_begins(fragments, book, ["__starts", "__chars"], F.max("chapter_level").alias("chapter_level")), carried]
    if counted:
        nums = running(fragments.where("__rows > 0").select(book, "chapter").distinct(), [book], "chapter", {"num": F.lit(1)}, part=part)
        heads.append(_counts(fragments, nums, book))
    every = bare.withColumns({"__part": dealt, "__rank": F.lit(2)})
    for head in heads:
        every = every.unionByName(head, allowMissingColumns=True)
    row, inside = F.col("__rank") == 2, Window.partitionBy(book, "__part").orderBy("__rank", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = every.withColumns({"chapter_level": F.max("chapter_level").over(inside), "__met": F.min("__rank").over(inside) == 0})
    known = met.where(~row | (F.col("__met") & ~shallow)).withColumn("starts", F.when(row, starts))
    body = row & ~F.col("starts")
    own = F.when(body, F.length("text")).otherwise(F.coalesce("__chars", F.lit(0)))
    summed = known.withColumns({"__upto": F.sum(F.coalesce(F.col("starts").cast("int"), "__starts", F.lit(0))).over(inside), "__before": F.sum(own).over(inside) - own})
    summed = summed.withColumns({"chapter": F.coalesce("chapter", F.greatest("__upto", F.lit(1))), "title": F.when(F.col("starts"), F.col("text")).otherwise(F.col("title"))})
    of = Window.partitionBy(book, "__part", "chapter")
    found = summed.withColumn("title", F.coalesce(F.max("title").over(of), F.lit("")))
    numbers = []
    if counted:
        found = found.withColumns({"num": F.max("num").over(of), "seq": F.sum(F.when(body, 1).otherwise(F.coalesce("__rows", F.lit(0)))).over(of.orderBy("__rank", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))})
        numbers = [F.col("num").cast("int").alias("num"), F.col("seq").cast("int").alias("seq"), (F.lit(1) + F.floor(F.col("__before") / K.PAGE_CHARS)).cast("int").alias("page")]
    heading = F.when(by_text, (F.length("text") <= K.HEADING_CHARS) & F.col("text").rlike(K.SECTION_TITLE)).otherwise(F.col("level") > F.col("chapter_level"))
    kind = F.when(heading, "heading").when(X.looks_like_formula(F.col("text")), "formula").otherwise("p")
    return found.where(body).select(book, "pos", "chapter", "title", kind.alias("kind"), "text", *numbers)


def blocks(rows: DataFrame, levels: DataFrame | None = None, book: str = "book", part: int = PART) -> DataFrame:
    """book, pos, chapter, title, kind, text: rows (book, pos, text, level) dealt to chapters. Rows before the first chapter belong to it; a chapter's title is no row of its own.
    rows is read several times: cut it before if it is costly."""
    return _outlined(rows, levels, book, part, counted=False)


def assembled(rows: DataFrame, levels: DataFrame | None = None, book: str = "book", part: int = PART) -> DataFrame:
    """As assemble of the blocks of rows (book, pos, text, level), with one shuffle of texts for both."""
    return _outlined(rows, levels, book, part, counted=True).select(book, "num", "title", "seq", "page", "kind", "text")


def pipeline_chapters(rows: DataFrame, book: str = "book") -> DataFrame:
    """book, chapter, nth, pos, title, text: the pipeline's chapters; a title is its chapter's first paragraph, before what stands in front of the first chapter."""
    kept = rows.where(~X.blank(F.col("text")))
    starts = (F.col("level") == 1) | F.col("text").rlike(K.PIPELINE_CHAPTER_TITLE)
    dealt = cut(running(kept.withColumn("starts", starts), [book], "pos", {"chapter": F.col("starts").cast("int")}).withColumn("chapter", F.greatest("chapter", F.lit(1))))
    titles = dealt.where("starts").groupBy(book, "chapter").agg(F.max("text").alias("title"), F.min("pos").alias("__title"))
    # What stands before the first chapter's title comes after it: the title's place is before all.
    shown = attached(dealt, titles, [book, "chapter"]).withColumn("__place", F.when(F.col("pos") == F.col("__title"), F.lit(-1)).otherwise(F.col("pos")))
    nth = running(shown, [book, "chapter"], "__place", {"nth": F.lit(1)})
    return nth.select(book, "chapter", F.col("nth").cast("int").alias("nth"), "pos", F.coalesce("title", F.lit("")).alias("title"), "text")


def virtual_pages(paragraphs: DataFrame, book: str = "book", order: str = "pos", text: str = "text", size: int = K.PAGE_CHARS) -> DataFrame:
    """paragraphs with page: 1 + the characters before the paragraph, in pages of so many."""
    return running(paragraphs, [book], order, {"page": F.length(text)}, before=True).withColumn("page", (F.lit(1) + F.floor(F.col("page") / size)).cast("int"))


def assemble(found: DataFrame, book: str = "book", part: int = PART) -> DataFrame:
    """book, num, title, seq, page, kind, text: blocks with pages; an image stands as a short text, chapters without text go, chapters and sections are numbered from 1.
    found is read twice: cut it before if it is costly."""
    shown = F.when(X.blank(F.col("text")) & (F.col("kind") == "image"), F.lit(K.IMAGE_TEXT)).otherwise(F.col("text"))
    rows = found.withColumn("text", shown).where(~X.blank(F.col("text"))).select(book, "pos", "chapter", "title", "kind", "text", F.floor(F.col("pos") / part).alias("__part"), F.lit(2).alias("__rank"))
    fragments = cut(rows.groupBy(book, "__part", "chapter").agg(F.count(F.lit(1)).alias("__rows"), F.sum(F.length("text")).alias("__chars")))
    nums = numbered(fragments.select(book, "chapter").distinct(), [book], ["chapter"], "num")
    # What a part has to know of the parts before it stands before its rows, so texts are shuffled once.
    every = rows.unionByName(_begins(fragments, book, ["__chars"]), allowMissingColumns=True).unionByName(_counts(fragments, nums, book), allowMissingColumns=True)
    row, upto = F.col("__rank") == 2, (Window.unboundedPreceding, Window.currentRow)
    own = F.when(row, F.length("text")).otherwise(F.coalesce("__chars", F.lit(0)))
    paged = every.withColumn("__before", F.sum(own).over(Window.partitionBy(book, "__part").orderBy("__rank", "pos").rowsBetween(*upto)) - own)
    of = Window.partitionBy(book, "__part", "chapter")
    counted = paged.withColumns({"num": F.max("num").over(of), "seq": F.sum(F.when(row, 1).otherwise(F.coalesce("__rows", F.lit(0)))).over(of.orderBy("__rank", "pos").rowsBetween(*upto))})
    page = (F.lit(1) + F.floor(F.col("__before") / K.PAGE_CHARS)).cast("int")
    return counted.where(row).select(book, "num", "title", F.col("seq").cast("int").alias("seq"), page.alias("page"), "kind", "text")


def page_ranges(starts: DataFrame, last: Column, book: str = "book") -> DataFrame:
    """Chapters (book, num, page_start) with page_end: the page before the next chapter, not before the own."""
    following = F.lead("page_start").over(Window.partitionBy(book).orderBy("page_start", "num"))
    return starts.withColumn("page_end", F.greatest(F.coalesce(following - 1, last), F.col("page_start")))


def margin_lines(page_lines: DataFrame, book: str = "book", page: str = "page", text: str = "text", least: int = K.MARGIN_PAGES, ratio: float = K.MARGIN_RATIO) -> DataFrame:
    """book, line: lines, without white space, that occur in a book as often as in a share of its pages. Occurrences are counted, not pages."""
    pages = page_lines.groupBy(book).agg(F.count_distinct(page).alias("pages")).where(F.col("pages") >= least)
    counted = page_lines.select(book, X.line_form(F.col(text)).alias("line")).where(F.col("line") != "").groupBy(book, "line").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(pages, book).where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("pages") * ratio))).select(book, "line")


def page_set(paragraphs: DataFrame, keys: Sequence[str], page: str = "page") -> DataFrame:
    """keys, pages: the pages that a group's paragraphs stand on, in order; page 0 is none."""
    return paragraphs.groupBy(*keys).agg(F.sort_array(F.collect_set(F.when(F.col(page) != 0, F.col(page)))).alias("pages"))


def paragraph_lines(page_lines: DataFrame, margins: DataFrame | None = None, book: str = "book", order: str = "pos", text: str = "text") -> DataFrame:
    """The lines that paragraphs are made of, with t (their text, bare) and paragraph (numbered from 0 in a book). A paragraph ends at a blank line and after a line over 6
    characters that ends a sentence; margins and noise go before. order: a line's number in its book."""
    bare = page_lines.withColumn("t", X.strip(F.col(text)))
    if margins is not None:
        bare = bare.withColumn("line", X.line_form(F.col("t"))).join(margins, [book, "line"], "left_anti").drop("line")
    used = bare.where(~X.is_noise_line(F.col("t")) | (F.col("t") == ""))
    ends = (F.col("t") == "") | (X.ends_sentence(F.col("t")) & (F.length("t") > 6))
    return running(used, [book], order, {"paragraph": ends.cast("int")}, before=True).where(F.col("t") != "")


def tidied(body: Column) -> Column:
    """A paragraph's text without what a page's foot has left at its end, and without white space around."""
    return X.strip(F.regexp_replace(body, "(?U)" + K.URL_AFTER_CJK, ""))


def reflow(page_lines: DataFrame, margins: DataFrame | None = None, book: str = "book", order: str = "pos", text: str = "text", least: Sequence[str] = ()) -> DataFrame:
    """book, paragraph, text, and of the columns least their least value in the paragraph: lines joined to paragraphs (see paragraph_lines)."""
    parted = paragraph_lines(page_lines, margins, book, order, text)
    joined = parted.groupBy(book, "paragraph").agg(F.array_sort(F.collect_list(F.struct(order, "t"))).alias("parts"), *[F.min(c).alias(c) for c in least])
    body = F.array_join(F.transform("parts", lambda p: p["t"]), "")
    return joined.select(book, "paragraph", tidied(body).alias("text"), *least).where(F.col("text") != "")


def reflow_runs(page_lines: DataFrame, runs: DataFrame, margins: DataFrame | None = None, book: str = "book", order: str = "pos", text: str = "text", least: Sequence[str] = ()) -> DataFrame:
    """As reflow, with runs (array of text and style) whose texts are the paragraph's text when joined.

    runs: book, order, span, text, style: a line's runs in order. Each has its place in the paragraph's characters (a running sum); what the text loses at its ends
    (white space, an address), the runs lose by place. A line without runs is one without style. The paragraph's text is that of its runs, with the white space that
    they have at the ends of lines."""
    lines = paragraph_lines(page_lines, margins, book, order, text)
    given = runs.select(book, order, F.col("span").alias("__span"), F.col("text").alias("__text"), "style")
    none = F.array().cast("array<string>")
    parts = lines.join(given, [book, order], "left").select(book, "paragraph", order, F.coalesce("__span", F.lit(0)).alias("__span"), F.coalesce("__text", "t").alias("__text"), F.coalesce("style", none).alias("style"), *least)
    # A paragraph's runs are shuffled once; all that follows is told within its task.
    keys = [book, "paragraph"]
    joined = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "__span", "__text", "style"))).alias("__parts"), *[F.min(c).alias(c) for c in least])
    body = F.array_join(F.transform("__parts", lambda p: p["__text"]), "")
    texts = joined.withColumn("__body", body).select(*keys, tidied(F.col("__body")).alias("text"), F.length(F.regexp_extract("__body", r"(?U)^[\s\x1c-\x1f]*", 0)).alias("__from"), "__parts", *least).where(F.col("text") != "")
    each = texts.select(*keys, "text", F.length("text").alias("__size"), "__from", *least, F.posexplode("__parts").alias("__nth", "__part"))
    # The paragraph's text stays with its first run alone.
    each = each.select(*keys, "__nth", F.when(F.col("__nth") == 0, F.col("text")).alias("text"), "__size", "__from", *least, "__part.__text", "__part.style")
    at = F.coalesce(F.sum(F.length("__text")).over(Window.partitionBy(*keys).orderBy("__nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Of a run's characters those from __from on, and no more than the text has.
    start, end = F.greatest(F.col("__from") - F.col("__at"), F.lit(0)), F.least(F.col("__from") + F.col("__size") - F.col("__at"), F.length("__text"))
    cropped = each.withColumn("__at", at).withColumn("__text", F.substr("__text", (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))).withColumn("__live", F.col("__text") != "")
    w = Window.partitionBy(*keys, "__live").orderBy("__nth")
    marked = cropped.withColumn("__new", (~F.col("style").eqNullSafe(F.lag("style").over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    numbered_runs = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    piece = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__nth", "__text"))), lambda s: s["__text"]), "")
    merged = numbered_runs.groupBy(*keys, "__live", "__run").agg(piece.alias("__text"), F.first("style").alias("style"), F.max("text").alias("text"), *[F.min(c).alias(c) for c in least])
    of = F.transform(F.array_sort(F.collect_list(F.when(F.col("__live"), F.struct("__run", "__text", "style")))), lambda s: F.struct(s["__text"].alias("text"), s["style"].alias("style")))
    return merged.groupBy(*keys).agg(F.max("text").alias("text"), *[F.min(c).alias(c) for c in least], of.alias("runs")).select(*keys, "text", *least, "runs")


def merged_runs(runs: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """keys, runs: a paragraph's runs in order, adjacent ones of one style joined, empty ones gone."""
    w = Window.partitionBy(*keys).orderBy(order)
    live = runs.where(F.col("text") != "").withColumn("__new", (~F.col("style").eqNullSafe(F.lag("style").over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    numbered = live.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]), "")
    joined = numbered.groupBy(*keys, "__run").agg(text.alias("text"), F.first("style").alias("style"))
    lists = joined.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__run", "text", "style"))), lambda s: F.struct(s["text"].alias("text"), s["style"].alias("style"))).alias("runs"))
    none = F.array().cast("array<struct<text:string,style:array<string>>>")
    return attached(runs.select(*keys).distinct(), lists, keys).select(*keys, F.coalesce("runs", none).alias("runs"))


def probe(pages: DataFrame, book: str = "book") -> DataFrame:
    """book, pages, chars_per_page, scanned, from about PROBE_PAGES pages of each book. pages: book, page (from 0), text."""
    total = pages.groupBy(book).agg(F.count(F.lit(1)).alias("pages"))
    step = F.greatest(F.lit(1), F.floor(F.col("pages") / K.PROBE_PAGES))
    sampled = pages.join(total, book).where(F.pmod(F.col("page"), step) == 0)
    out = sampled.groupBy(book).agg(F.first("pages").alias("pages"), F.avg(F.length(X.strip(F.col("text")))).alias("chars_per_page"))
    return out.withColumn("scanned", (F.col("chars_per_page") < K.SPARSE_CHARS_PER_PAGE) & (F.col("pages") >= 3))


def upper_median(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """keys, name: of a group's values (nulls aside) the one at half their number in ascending order. Values are counted first, so a group is as large as its different values."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*keys)
    upto = F.sum("__n").over(group.orderBy("__value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn("__upto", upto).withColumn("__all", F.sum("__n").over(group)).where(F.col("__upto") > F.floor(F.col("__all") / 2)).groupBy(*keys).agg(F.min("__value").alias(name))


def body_height(ocr_lines: DataFrame, book: str = "book") -> DataFrame:
    """book, height: the median height of lines, again without those over 1.5 times of it."""
    rough = upper_median(ocr_lines, [book], "height", "rough")
    return upper_median(ocr_lines.join(rough, book).where(F.col("height") <= 1.5 * F.col("rough")), [book], "height", "height")


def page_offset(numbers: DataFrame, book: str = "book", samples: int = 3, most: int = 100) -> DataFrame:
    """book, page_offset: the median of printed less physical page numbers, 0 where there are few or it is large. numbers: book, page, ord, number; a page's last number counts."""
    last = numbers.groupBy(book, "page").agg(F.max_by("number", "ord").alias("number")).withColumn("off", F.col("number") - F.col("page"))
    found = last.groupBy(book).agg(F.count(F.lit(1)).alias("n")).join(upper_median(last, [book], "off", "offset"), book, "left")
    return found.select(book, F.when((F.col("n") >= samples) & (F.abs("offset") <= most), F.col("offset")).otherwise(0).alias("page_offset"))


def ocr_text(ocr_lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: a page's lines in reading order."""
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", "ord", "text")))
    return ocr_lines.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("text"))


def text_statistics(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, cjk, chars_no_ws, en_words, tokens: sums over texts, and the estimate of tokens from them."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = texts.groupBy(*by).agg(F.coalesce(F.sum(X.cjk_count(t)), F.lit(0)).cast("long").alias("cjk"), F.coalesce(F.sum(X.solid_count(t)), F.lit(0)).cast("long").alias("chars_no_ws"), F.coalesce(F.sum(X.word_count(t)), F.lit(0)).cast("long").alias("en_words"))
    return out.withColumn("tokens", F.col("cjk") + F.floor(F.col("en_words") / 4))
