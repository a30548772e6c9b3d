"""Files as rows: format detection, decoding, text, docx, manifests, knowledge bases."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import constants as K
from lectern.operators import structure
from lectern.operators.joins import cut, small

#: Suffixes and content types by format (fixed values).
SUFFIXES = {"pdf": (".pdf",), "docx": (".docx",), "doc": (".doc",), "text": (".txt", ".md", ".markdown", ".text")}
MOST_UPLOAD_BYTES = 200 << 20


def format_of(name: Column, content_type: Column) -> Column:
    """pdf, docx, doc, text or null: by the suffix, else by the content type."""
    suffix = F.lower(F.regexp_extract(name, "[^/](\\.[^./]+)$", 1))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for fmt, suffixes in SUFFIXES.items():
        out = out.when(suffix.isin(*suffixes), fmt)
    return out.when(kind == "application/pdf", "pdf").when(F.contains(kind, F.lit("wordprocessingml")), "docx").when(kind == "application/msword", "doc").when(kind.startswith("text/"), "text")


def upload_status(size: Column, fmt: Column, long_texts: bool = False) -> Column:
    """long_texts: text files may be of any size, where they are read in splits (text_lines)."""
    over = (size > MOST_UPLOAD_BYTES) & ~F.coalesce((fmt == "text") & F.lit(long_texts), F.lit(False))
    return F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(over, "too large").when(fmt.isNull(), "unknown format").when(fmt == "doc", "unavailable").otherwise("ok")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, format, status, content of files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    fmt = format_of(F.col("path"), F.lit(""))
    return raw.select("path", fmt.alias("format"), upload_status(F.col("length"), fmt).alias("status"), "content")


def decode(raw: bytes | None) -> str:
    """UTF-8 (with or without mark), else GB18030, else UTF-8 with replacements."""
    raw = raw or b""
    for encoding in ("utf-8-sig", "gb18030"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def decoded(content: Column | str) -> Column:
    return F.pandas_udf(lambda raw: raw.map(decode), T.StringType())(content)


def text_books(found: DataFrame, dialect: str = "a") -> DataFrame:
    """book, pos, text, level of the text files among files."""
    texts = found.where((F.col("format") == "text") & (F.col("status") == "ok")).select(F.col("path").alias("book"), decoded("content").alias("text"))
    return structure.outline_rows(structure.lines(texts), dialect)


# ---- text files in splits ----


def _ends_in_a_break(spark: SparkSession, path: str) -> bool:
    """Whether a file's last byte ends a line."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size, stream = fs.getFileStatus(at).getLen(), fs.open(at)
    try:
        stream.seek(max(size - 1, 0))
        return stream.read() in (10, 13)
    finally:
        stream.close()


def literal(paths: Sequence[str]) -> list[str]:
    """Paths as Spark's readers take them literally."""
    return [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]


def text_lines(spark: SparkSession, paths: Sequence[str], folder: str) -> DataFrame:
    """book, pos, raw of the lines of text files (some; each has a byte or more), as decoded() and structure.lines give them. A file is read in splits, so one of any size is
    spread over many tasks; its bytes are lines of the table in folder, where a line's place is its split's beginning and its place in the split."""
    # Rows tell their file by its URI.
    uri = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    wanted = F.broadcast(spark.createDataFrame([(uri(p).toUri().toString(), p, _ends_in_a_break(spark, p)) for p in paths], "uri string, book string, more boolean"))
    read = spark.read.text(literal(paths)).select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"), F.is_valid_utf8("value").alias("utf8"))
    read.withColumn("at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(folder)
    kept = spark.read.parquet(folder).join(wanted, "uri")
    blocks = kept.groupBy("book", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("from"), F.bool_and("utf8").alias("utf8"))
    earlier = Window.partitionBy("book").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("book")
    blocks = cut(blocks.select("book", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("from")).alias("shift"), F.sum("n").over(whole).alias("lines"), F.bool_and("utf8").over(whole).alias("whole")))
    placed = kept.join(small(blocks), ["book", "block"]).select("book", (F.col("at") + F.col("shift")).cast("int").alias("pos"), "line", "whole")
    rows = placed.where("whole").select("book", "pos", F.col("line").cast("string").alias("raw"))
    if blocks.where("NOT whole").limit(1).count():
        rows = rows.unionByName(_other_lines(placed.where("NOT whole").select("book", "pos", "line")))
    # The last break is followed by an empty line; a file that is a mark alone is one.
    ends = wanted.drop("uri").join(blocks.groupBy("book").agg(F.max("lines").alias("lines")), "book", "left").where(F.col("more") | F.col("lines").isNull())
    return rows.unionByName(ends.select("book", F.coalesce("lines", F.lit(0)).cast("int").alias("pos"), F.lit("").alias("raw")))


def _other_lines(lines: DataFrame) -> DataFrame:
    """book, pos, raw of lines (book, pos, line) of books that aren't UTF-8 throughout: all of a book's as GB18030, or else as UTF-8 with replacements. No sign of either goes over a line's end."""

    def fits(raw: bytes) -> bool:
        try:
            raw.decode("gb18030")
        except UnicodeDecodeError:
            return False
        return True

    ok = F.pandas_udf(lambda raw: raw.map(fits), T.BooleanType())("line")
    books = cut(lines.groupBy("book").agg(F.min(ok).alias("gb")))
    as_gb = F.pandas_udf(lambda raw: raw.map(lambda b: b.decode("gb18030", "replace")), T.StringType())("line")
    as_utf8 = F.pandas_udf(lambda raw: raw.map(lambda b: b.decode("utf-8", "replace")), T.StringType())("line")
    told = lines.join(small(books), "book")
    return told.where("gb").select("book", "pos", as_gb.alias("raw")).unionByName(told.where("NOT gb").select("book", "pos", as_utf8.alias("raw")))


# ---- docx ----

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_HEADING = re.compile(r"(?i)^heading\s*(\d+)$")


def style_level(style: str) -> int:
    """A style's outline level, 0 for body text and for titles."""
    m = _HEADING.match(style.strip())
    return min(int(m[1]), 9) if m else 0


#: Styles of a book's title (fixed values).
TITLE_STYLES = ("title", "subtitle")
_BREAKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}


def _text(element: ElementTree.Element) -> str:
    return "".join(t.text or "" if t.tag == f"{_W}t" else _BREAKS.get(t.tag, "") for t in element.iter())


def _on(marks: ElementTree.Element | None, name: str) -> bool:
    mark = marks.find(f"{_W}{name}") if marks is not None else None
    return mark is not None and mark.get(f"{_W}val", "1") not in ("0", "false", "off")


def _run(run: ElementTree.Element) -> dict:
    marks = run.find(f"{_W}rPr")
    size, place = (marks.find(f"{_W}{n}") if marks is not None else None for n in ("sz", "vertAlign"))
    return {"text": _text(run), "size": float(size.get(f"{_W}val", "0")) / 2 if size is not None else None, "bold": _on(marks, "b"), "italic": _on(marks, "i"), "position": place.get(f"{_W}val") if place is not None else None}


class Docx:
    """An open document: its body, the names of its styles, and the files its relations lead to."""

    def __init__(self, content: bytes) -> None:
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        self.body = ElementTree.fromstring(self.archive.read("word/document.xml")).find(f"{_W}body")
        self.names, self.targets = {}, {}
        there = set(self.archive.namelist())
        if "word/styles.xml" in there:
            for style in ElementTree.fromstring(self.archive.read("word/styles.xml")).iter(f"{_W}style"):
                label = style.find(f"{_W}name")
                self.names[style.get(f"{_W}styleId", "")] = label.get(f"{_W}val", "") if label is not None else ""
        if "word/_rels/document.xml.rels" in there:
            for relation in ElementTree.fromstring(self.archive.read("word/_rels/document.xml.rels")):
                path = "word/" + relation.get("Target", "")
                if path in there:
                    self.targets[relation.get("Id", "")] = path

    def style(self, paragraph: ElementTree.Element) -> str:
        style = paragraph.find(f"{_W}pPr/{_W}pStyle")
        return self.names.get(style.get(f"{_W}val", ""), style.get(f"{_W}val", "")) if style is not None else "Normal"

    def items(self) -> Iterator[dict]:
        """The body's children in order: images (those that the archive has) before their paragraph's text, paragraphs with their runs, tables without empty rows."""
        images = 0
        for child in self.body if self.body is not None else ():
            if child.tag == f"{_W}p":
                for blip in child.iter(f"{_A}blip"):
                    if path := self.targets.get(blip.get(f"{_R}embed", "")):
                        yield {"kind": "image", "asset": f"img{images}.{(path.rpartition('.')[2] or 'png').lower()}", "content": self.archive.read(path)}
                        images += 1
                if text := _text(child).strip():
                    style = self.style(child)
                    runs = [_run(r) for r in child.findall(f"{_W}r")]
                    # Runs within links are no runs of the paragraph's own; where they hold text, no styles are told.
                    yield {"kind": "p", "text": text, "style": style, "level": style_level(style), "runs": runs if "".join(r["text"] for r in runs) == _text(child) else []}
            elif child.tag == f"{_W}tbl":
                cells = [[" ".join("".join(t.text or "" for t in cell.iter(f"{_W}t")).split()) for cell in row.iter(f"{_W}tc")] for row in child.iter(f"{_W}tr")]
                if any(any(row) for row in cells):
                    yield {"kind": "table", "text": "\n".join(" | ".join(row) for row in cells), "cells": [row for row in cells if any(row)]}

    def skipped(self) -> tuple[int, int]:
        """How many text boxes and drawings there are, whose words are not read."""
        return sum(1 for _ in self.body.iter(f"{_W}txbxContent")), sum(1 for _ in self.body.iter(f"{_W}drawing"))


DOCX_SCHEMA = "book string, pos int, kind string, text string, style string, level int, cells array<array<string>>, runs array<struct<text:string,size:double,bold:boolean,italic:boolean,position:string>>, asset string, content binary"
_BROKEN = (zipfile.BadZipFile, KeyError, ElementTree.ParseError)


def _docx(found: DataFrame) -> DataFrame:
    return found.where((F.col("format") == "docx") & (F.col("status") == "ok")).select("path", "content")


def docx_rows(found: DataFrame, tables: bool = True) -> DataFrame:
    """Rows of DOCX_SCHEMA of the docx files among files, in the order of the documents; a broken file gives one row of kind 'error'. tables=False: paragraphs only.
    Images are rows with their name and bytes."""
    names = [part.split()[0] for part in DOCX_SCHEMA.split(", ")]
    blank = {"text": "", "style": "", "level": 0, "cells": None, "runs": [], "asset": None, "content": None}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    items = [item for item in Docx(content).items() if tables or item["kind"] == "p"]
                except _BROKEN as broken:
                    items = [{"kind": "error", "text": str(broken)}]
                rows = [blank | {"book": path, "pos": pos} | item for pos, item in enumerate(items)]
                yield pd.DataFrame(rows, columns=names).astype({"pos": "int32", "level": "int32"})

    return _docx(found).mapInPandas(run, DOCX_SCHEMA)


def docx_notes(found: DataFrame) -> DataFrame:
    """book, boxes, drawings, notes of the docx files among files: what their rows leave out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append((path, *Docx(content).skipped()))
                except _BROKEN:
                    continue
            yield pd.DataFrame(rows, columns=["book", "boxes", "drawings"]).astype({"boxes": "int32", "drawings": "int32"})

    counted = _docx(found).mapInPandas(run, "book string, boxes int, drawings int")
    said = [F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {label}"))) for n, label in (("boxes", K.BOX_NOTE), ("drawings", K.DRAWING_NOTE))]
    return counted.withColumn("notes", F.array_compact(F.array(*said)))


def docx_titles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(book, title: the first paragraph in a title style; the other rows, without all of these) of docx_rows."""
    title = F.lower("style").isin(*TITLE_STYLES) & (F.col("kind") == "p")
    titles = rows.groupBy("book").agg(F.coalesce(F.min_by("text", F.when(title, F.col("pos"))), F.lit("")).alias("title"))
    return titles, rows.where(~title)


def docx_content(rows: DataFrame) -> DataFrame:
    """book, pos, runs (text, style; empty where no run has a style) of the paragraphs of docx_rows."""
    split = rows.where(F.col("kind") == "p").select("book", "pos", F.posexplode_outer("runs").alias("ord", "r")).select("book", "pos", "ord", "r.*")
    styled = run_styles(split.where(F.col("text").isNotNull()))
    merged = structure.merged_runs(styled, ["book", "pos"])
    plain = ~F.exists("runs", lambda r: F.size(r["style"]) > 0)
    return merged.select("book", "pos", F.when(plain, F.slice("runs", 1, 0)).otherwise(F.col("runs")).alias("runs"))


def table_content(cells: Column) -> Column:
    """A table's rows of cells as structures, and whether its first row heads it."""
    return F.struct(F.transform(cells, lambda row: F.transform(row, lambda c: F.struct(c.alias("text")))).alias("rows"), (F.size(cells) > 1).alias("header"))


def books(found: DataFrame, dialect: str = "a", texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(book, title; book, pos, text, level) of the text and docx files among files, whatever their format; a title is that of a title style, or the lone heading above the chapters.
    texts: the rows of the text files, if they are read already."""
    titles, rows = docx_titles(docx_rows(found, tables=False))
    texts = text_books(found, dialect) if texts is None else texts
    every = texts.unionByName(rows.where(F.col("kind") == "p").select("book", "pos", "text", "level"))
    return titles.unionByName(structure.titled(texts)), every


# ---- line and run tables of page formats ----


def body_size(runs: DataFrame, book: str = "book") -> DataFrame:
    """book, body: the size of most runs (not of most characters), the smaller of several; runs without a size don't count."""
    counted = runs.where(F.col("size") > 0).groupBy(book, "size").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(book).agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body"))


def run_styles(runs: DataFrame, large: float = 1.15, small: float = 0.9, book: str = "book") -> DataFrame:
    """runs (book, text, size, bold, italic, position) with style: b, i, sup or sub, lg or sm against the body's size."""
    ratio = F.col("size") / F.col("body")
    tokens = F.array_compact(F.array(F.when(F.col("bold"), "b"), F.when(F.col("italic"), "i"), F.when(F.col("position") == "superscript", "sup").when(F.col("position") == "subscript", "sub"), F.when(F.col("position").isNull() | ~F.col("position").isin("superscript", "subscript"), F.when(ratio >= large, "lg").when(ratio <= small, "sm"))))
    return runs.join(body_size(runs, book), book, "left").withColumn("style", tokens).drop("body")


def page_items(lines: DataFrame, images: DataFrame, tables: DataFrame, keys: list[str], least_area: float = 4000.0) -> DataFrame:
    """keys, ord, kind, text: a page's lines, images (not the small ones) and tables from top to bottom."""
    parts = [lines.select(*keys, "y", F.lit("line").alias("kind"), "text"), images.where(F.col("area") >= least_area).select(*keys, "y", F.lit("image").alias("kind"), F.lit("").alias("text")), tables.select(*keys, "y", F.lit("table").alias("kind"), "text")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("y", "kind", "text"))).select(*keys, "ord", "kind", "text")


# ---- manifests ----

MANIFEST = "struct<version:int,chapters:array<struct<chapter:int,title:string,parts:array<struct<part:int,paragraphs:array<struct<anchor:string,text:string>>>>>>>"


def manifest_rows(manifests: DataFrame, book: str = "book") -> DataFrame:
    """book, chapter, title, part, nth, anchor, text of manifests (book, manifest)."""
    chapters = manifests.select(book, F.explode("manifest.chapters").alias("c"))
    parts = chapters.select(book, "c.chapter", "c.title", F.explode("c.parts").alias("p"))
    return parts.select(book, "chapter", "title", "p.part", F.posexplode("p.paragraphs").alias("nth", "g")).select(book, "chapter", "title", "part", "nth", "g.anchor", "g.text")
