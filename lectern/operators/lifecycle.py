"""Books through their life: bundles, replacement, deletion, orphans, threads, notes, tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import constants as K
from lectern.functions import text as X
from lectern.operators.containment import contained


def bundle(assembled: DataFrame, book: str = "book") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chapters, sections, anchors) of assembled books; ids are made of the book's, an anchor is its section's twin."""
    b = F.col(book).cast("string")
    chapter_id = F.concat(b, F.lit("-ch"), F.col("num").cast("string"))
    section_id = F.concat(b, F.lit("-s"), F.col("num").cast("string"), F.lit("-"), F.col("seq").cast("string"))
    sections = assembled.select(section_id.alias("id"), b.alias("book_id"), chapter_id.alias("chapter_id"), "seq", "text", "page", "kind")
    body = F.array_sort(F.collect_list(F.when(F.col("kind") != "heading", F.struct("seq", "text"))))
    chapters = assembled.groupBy(b.alias("book_id"), chapter_id.alias("id"), "num", "title").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.array_join(F.transform(body, lambda s: s["text"]), "\n").alias("full_text"))
    return chapters, sections, sections.select("id", "book_id", "chapter_id", F.col("id").alias("section_id"), "text", "page")


def content_warning(books: DataFrame, sections: DataFrame, notes: Column | None = None) -> DataFrame:
    """books (id) with chars and warning: too little body text, and what the parser noted."""
    body = sections.where(F.col("kind") != "heading").groupBy("book_id").agg(F.sum(F.length("text")).alias("chars"))
    out = books.join(body, F.col("id") == F.col("book_id"), "left").drop("book_id").withColumn("chars", F.coalesce("chars", F.lit(0)))
    low = F.when(F.col("chars") < K.LOW_CONTENT_CHARS, F.concat(F.lit("整本教材只解析出 "), F.col("chars").cast("string"), F.lit(" 个字的正文，内容可能大部分没被读出来")))
    return out.withColumn("warning", F.concat_ws("；", low, *([notes] if notes is not None else [])))


def replaced(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """key, state: updated, added or removed, of an old and a new list."""
    o, n = old.select(key, F.lit(True).alias("o")), new.select(key, F.lit(True).alias("n"))
    return o.join(n, key, "full").select(key, F.when(F.col("o") & F.col("n"), "updated").when(F.col("n"), "added").otherwise("removed").alias("state"))


def dropped_counts(children: dict[str, DataFrame], gone: DataFrame, key: str) -> DataFrame:
    """name, n: how many rows of each child table belong to what is gone."""
    out = None
    for name, rows in children.items():
        one = rows.join(gone.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def without(rows: DataFrame, gone: DataFrame, key: str, via: DataFrame | None = None, via_key: str | None = None) -> DataFrame:
    """rows that do not belong to what is gone, directly or by way of another table that holds key and via_key."""
    if via is None:
        return rows.join(gone.select(key).distinct(), key, "left_anti")
    return rows.join(via.join(gone.select(key).distinct(), key, "left_semi").select(via_key).distinct(), via_key, "left_anti")


def reanchored(records: DataFrame, old_anchors: DataFrame, new_anchors: DataFrame, record: str = "id") -> DataFrame:
    """records (record, chapter_id, anchor_id, quoted) with new_anchor_id and state: kept where the anchor still exists; else moved to the
    paragraph of the same chapter that holds the anchor's text; else unanchored."""
    live = records.join(new_anchors.select(F.col("id").alias("anchor_id")).distinct().withColumn("live", F.lit(True)), "anchor_id", "left")
    lost = live.where(F.col("live").isNull()).join(old_anchors.select(F.col("id").alias("anchor_id"), F.col("text").alias("old_text")), "anchor_id", "left")
    needles = lost.select(record, "chapter_id", F.coalesce(F.nullif(X.strip(F.coalesce("quoted", F.lit(""))), F.lit("")), "old_text").alias("needle"))
    found = contained(needles, new_anchors.select(F.col("id").alias("found_id"), "chapter_id", "text", "ord"), ["chapter_id"], record, "found_id", ["ord"])
    out = live.join(found, record, "left")
    target = F.when(F.col("live"), F.col("anchor_id")).otherwise(F.coalesce("found_id", F.lit("")))
    state = F.when(F.coalesce("anchor_id", F.lit("")) == "", "none").when(F.col("live"), "kept").when(F.col("found_id").isNotNull(), "moved").otherwise("unanchored")
    return out.withColumn("new_anchor_id", target).withColumn("state", state).drop("live", "found_id")


def orphans(files: DataFrame, books: DataFrame) -> DataFrame:
    """path, state of files that no live book has: orphan, or unrecognized where the name holds no book's id."""
    keyed = files.withColumn("book_id", F.regexp_extract("path", "(?:^|/)([0-9A-Za-z]+)(?:[-.][^/]*)?$", 1))
    return keyed.join(books.select(F.col("id").alias("book_id")), "book_id", "left_anti").select("path", F.when(F.col("book_id").rlike("^[0-9]+$"), "orphan").otherwise("unrecognized").alias("state"))


def thread_titles(messages: DataFrame, threads: DataFrame | None = None, key: str = "thread_id", order: str = "id", default: str = "新对话", most: int = 24) -> DataFrame:
    """key, title, messages: a thread's selection, else its first question, else a default, cut off."""
    first = messages.groupBy(key).agg(F.min_by("text", F.when((F.col("role") == "user") & ~X.blank(F.col("text")), F.col(order))).alias("first"), F.count(F.lit(1)).alias("messages"))
    joined = first if threads is None else threads.select(key, "selected_text").join(first, key, "left")
    selection = F.nullif(X.strip(F.coalesce("selected_text", F.lit(""))), F.lit("")) if threads is not None else F.lit(None).cast("string")
    return joined.select(key, X.clip(F.coalesce(selection, X.strip(F.col("first")), F.lit(default)), most).alias("title"), F.coalesce("messages", F.lit(0)).alias("messages"))


def conversation(messages: DataFrame, key: str = "thread_id", order: str = "id") -> DataFrame:
    """key, messages in order, with their sources and detail read from JSON; bad JSON counts as none."""
    detail = F.coalesce(F.from_json("detail", "map<string,string>"), F.create_map().cast("map<string,string>"))
    sources = F.coalesce(F.from_json("sources", "array<string>"), F.array().cast("array<string>"))
    return messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), "role", "text", sources.alias("sources"), detail["status"].alias("status")))).alias("messages"))


def recent(rows: DataFrame, group: Sequence[str], updated: str, order: str) -> DataFrame:
    """rows with their place, newest first; of the same time, the later row."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(updated).desc(), F.col(order).desc())))


def owned_notes(notes: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a note's anchor, if it has one, must be of its chapter."""
    mine = anchors.select("chapter_id", F.col("id").alias("anchor_id"))
    free = F.coalesce("anchor_id", F.lit("")) == ""
    return notes.where(free).unionByName(notes.where(~free).join(mine, ["chapter_id", "anchor_id"], "left_semi")), notes.where(~free).join(mine, ["chapter_id", "anchor_id"], "left_anti")


def task_view(tasks: DataFrame) -> DataFrame:
    """tasks with percent."""
    return tasks.withColumn("percent", F.when(F.col("total") > 0, F.bround(F.col("done") * 100.0 / F.col("total"), 0)).otherwise(0.0).cast("int"))


def failed_stale(tasks: DataFrame, error: str = "interrupted") -> DataFrame:
    """Tasks that were waiting or running when the application ended have failed."""
    stale = F.col("status").isin("pending", "running")
    return tasks.withColumn("error", F.when(stale, error).otherwise(F.col("error"))).withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))
