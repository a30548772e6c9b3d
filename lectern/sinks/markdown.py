"""Books as Markdown, manifests, outlines and page-ready structures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import constants as K
from lectern.functions import text as X


def _or(name: str, default: str):  # noqa: ANN202
    return F.when(X.blank(F.col(name)), F.lit(default)).otherwise(F.col(name))


def _block():  # noqa: ANN202
    """A section (page, kind, text) as Markdown."""
    body = X.strip(F.col("text"))
    page = F.concat(F.lit("<!-- page: "), F.col("page").cast("string"), F.lit(" -->\n"))
    return F.when(F.col("kind") == "heading", F.concat(page, F.lit("### "), body)).when(F.col("kind") == "formula", F.concat(page, F.lit("```\n"), body, F.lit("\n```"))).otherwise(F.concat(page, F.replace(body, F.lit("\n"), F.lit("  \n"))))


def _headed(books: DataFrame, of_book: DataFrame) -> DataFrame:
    """book_id, markdown: the books' heads and their chapters (book_id, chapters)."""
    head = [F.concat(F.lit("# "), _or("title", K.NO_TITLE)), F.when(~X.blank(F.col("note")), F.concat(F.lit("> "), X.strip(F.col("note")))), F.when(~X.blank(F.col("content_warning")), F.concat(F.lit("> ⚠️ "), X.strip(F.col("content_warning"))))]
    joined = books.join(of_book, F.col("id") == F.col("book_id"), "left")
    return joined.select(F.col("id").alias("book_id"), F.concat(F.regexp_replace(F.concat_ws("\n\n", *head, F.col("chapters")), "\\s+$", ""), F.lit("\n")).alias("markdown"))


def markdown(books: DataFrame, chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """book_id, markdown. books: id, title, note, content_warning; chapters: id, book_id, num, title; sections: chapter_id, seq, page, kind, text."""
    of_chapter = sections.where(~X.blank(F.col("text"))).groupBy("chapter_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", _block().alias("b")))), lambda s: s["b"]), "\n\n").alias("body"))
    titled = chapters.join(of_chapter, F.col("id") == F.col("chapter_id"), "left").select("book_id", "num", F.concat_ws("\n\n", F.concat(F.lit("## "), _or("title", K.NO_CHAPTER_TITLE)), F.col("body")).alias("c"))
    of_book = titled.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("num", "c"))), lambda s: s["c"]), "\n\n").alias("chapters"))
    return _headed(books, of_book)


def assembled_markdown(books: DataFrame, assembled: DataFrame, book: str = "book") -> DataFrame:
    """As markdown of the bundle of assembled books (book, num, title, seq, page, kind, text): every chapter has a first section, which brings its title, so that texts are gathered once, by book."""
    piece = F.when(F.col("seq") == 1, F.concat(F.lit("## "), _or("title", K.NO_CHAPTER_TITLE), F.lit("\n\n"), _block())).otherwise(_block())
    of_book = assembled.groupBy(F.col(book).cast("string").alias("book_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("num", "seq", piece.alias("b")))), lambda s: s["b"]), "\n\n").alias("chapters"))
    return _headed(books, of_book)


def manifest(paragraphs: DataFrame, book: str = "book") -> DataFrame:
    """book, manifest: chapters of parts of paragraphs (anchor, text), nested. paragraphs: book, chapter, title, part, nth, text. Anchors count through a chapter's parts."""
    anchored = paragraphs.withColumn("paragraph", F.struct("nth", F.concat(F.lit("ch"), F.col("chapter").cast("string"), F.lit("-p"), F.lpad(F.col("nth").cast("string"), 3, "0")).alias("anchor"), "text"))
    parts = anchored.groupBy(book, "chapter", "title", "part").agg(F.transform(F.array_sort(F.collect_list("paragraph")), lambda p: F.struct(p["anchor"].alias("anchor"), p["text"].alias("text"))).alias("paragraphs"))
    chapters = parts.groupBy(book, "chapter", "title").agg(F.array_sort(F.collect_list(F.struct("part", "paragraphs"))).alias("parts"))
    return chapters.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("chapter", "title", "parts"))).alias("chapters")).select(book, F.struct(F.lit(1).alias("version"), "chapters").alias("manifest"))


def mind_map(nodes: DataFrame, title: str) -> DataFrame:
    """outline: chapters by number, below each its concepts, those with fewest prerequisites first. nodes: chapter, chapter_title, concept, prerequisites."""
    number = F.coalesce(F.expr("try_cast(regexp_replace(chapter, '[^0-9]', '') AS int)"), F.lit(0))
    leaf = F.struct(F.size("prerequisites").alias("needs"), "concept")
    listed = nodes.groupBy("chapter", "chapter_title", number.alias("number")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(leaf)), lambda s: F.concat(F.lit("    - "), s["concept"])), "\n").alias("leaves"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("number", "chapter", "chapter_title", "leaves"))), lambda s: F.concat(F.lit("  - "), s["chapter_title"], F.lit("\n"), s["leaves"]))
    return listed.agg(F.concat(F.lit(f"- {title}\n"), F.array_join(lines, "\n")).alias("outline"))


def graph_html(graph: DataFrame, template: str = '<script id="graph" type="application/json">{data}</script>') -> DataFrame:
    """html of a graph (one row) with its JSON embedded; '</' is escaped so that no text ends the script."""
    before, after = template.split("{data}")
    return graph.select(F.concat(F.lit(before), F.replace(F.to_json(F.struct("*")), F.lit("</"), F.lit("<\\/")), F.lit(after)).alias("html"))


def segments(sections: DataFrame) -> DataFrame:
    """sections with what a reader shows: type by kind (the first of a chapter is its definition), runs or the plain text."""
    first = F.col("seq") == 1
    kind = F.when(F.col("kind").isin("heading", "formula", "image", "table"), F.col("kind")).when(first, "definition").otherwise("paragraph")
    return sections.withColumn("type", kind).withColumn("segments", F.array(F.struct(F.col("text"), F.array().cast("array<string>").alias("style"))))


def book_cards(books: DataFrame, chapters: DataFrame, progress: DataFrame) -> DataFrame:
    """id, title, progress text, chapters in order with state: as recorded, else the first 'doing' and others 'todo'."""
    state = chapters.join(progress.select(F.col("chapter_id").alias("id"), "status"), "id", "left")
    listed = state.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("num", "id", "title", F.coalesce("status", F.when(F.col("num") == 1, "doing").otherwise("todo")).alias("status"), (F.col("num") == 1).alias("is_today")))).alias("chapters"))
    shown = F.concat(F.lit("已学 "), F.bround(F.coalesce("progress_pct", F.lit(0.0)), 0).cast("int").cast("string"), F.lit("%"))
    return books.join(listed, F.col("id") == F.col("book_id"), "left").select("id", "title", shown.alias("progress"), "chapters")


def disposition(title: str = "title"):  # noqa: ANN201
    """A Content-Disposition value with an ASCII name and the full one percent-encoded."""
    ascii_name = F.regexp_replace(F.col(title), "[^A-Za-z0-9._-]+", "_")
    return F.concat(F.lit('attachment; filename="'), ascii_name, F.lit(".md\"; filename*=UTF-8''"), F.replace(F.url_encode(F.col(title)), F.lit("+"), F.lit("%20")), F.lit(".md"))


def publish(tables: dict[str, DataFrame], folder: str, snapshot: str) -> str:
    """Tables written below a snapshot of their own; readers get its path once all are there, so they never see half of them."""
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{folder}/{snapshot}/{name}")
    return f"{folder}/{snapshot}"


def write_split(paragraphs: DataFrame, folder: str, book: str = "book") -> None:
    """The split book: a folder of text files for each chapter's part, and the manifests as JSON. paragraphs: book, chapter, title, part, nth, text."""
    lines = paragraphs.groupBy(book, "chapter", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda s: s["text"]), "\n").alias("value"))
    lines.write.mode("overwrite").partitionBy(book, "chapter", "part").text(f"{folder}/parts")
    manifest(paragraphs, book).write.mode("overwrite").json(f"{folder}/manifest")


def write_lessons(lessons: DataFrame, folder: str, chapter: str = "chapter_id") -> None:
    """Lessons as JSON, a partition a chapter, and an index of their titles and numbers of steps."""
    lessons.write.mode("overwrite").partitionBy(chapter).json(f"{folder}/lessons")
    lessons.select(chapter, "title", F.size("steps").alias("steps")).write.mode("overwrite").json(f"{folder}/index")


def capabilities(spark, **known: bool) -> DataFrame:  # noqa: ANN001
    """name, available of optional parts."""
    return spark.createDataFrame(sorted(known.items()) or [], "name string, available boolean")
