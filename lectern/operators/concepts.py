"""Concepts: extraction by rules, normalisation, the concept graph, lessons, quizzes and plans."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import constants as K
from lectern.functions import text as X
from lectern.operators.joins import cut, first_rows, small
from lectern.operators.prefix import numbered


# ---- extraction ----


def concept_paragraphs(anchors: DataFrame, sections: DataFrame) -> DataFrame:
    """Anchors that are neither headings nor formulas, of LEAST_PARAGRAPH characters or more; an anchor without section counts as a paragraph."""
    kinds = sections.select(F.col("id").alias("section_id"), "kind")
    joined = anchors.join(kinds, "section_id", "left").withColumn("kind", F.coalesce("kind", F.lit("p")))
    return joined.where(~F.col("kind").isin("heading", "formula") & (F.length(X.strip(F.col("text"))) >= K.LEAST_PARAGRAPH))


def rule_name(after: Column) -> Column:
    """The name that follows a marker: its first clause without filler, or what stands after the last 的 in it."""
    clause = X.strip_filler(X.first_clause(X.tidy(after)))
    tail = X.strip_filler(X.first_clause(F.substring_index(clause, "的", -1)))
    chosen = F.when(F.contains(clause, F.lit("的")) & F.length(tail).between(2, K.MAX_NAME), tail).otherwise(clause)
    return X.clean_name(X.strip_filler(chosen))


def rule_concepts(paragraphs: DataFrame, chapter: str = "chapter_id", order: str = "seq", markers: str = K.MARKERS_A) -> DataFrame:
    """chapter, id, concept, definition, anchors of definition sentences, MAX_CONCEPTS a chapter, the first of each name. paragraphs: chapter, order, anchor, text."""
    before = F.regexp_extract("text", f"(?s)^(.*?)({markers})", 1)
    marker = F.regexp_extract("text", f"(?s)^.*?({markers})", 1)
    found = paragraphs.where(F.col("text").rlike(markers)).withColumn("at", F.length(before)).withColumn("after", F.substr("text", F.col("at") + F.length(marker) + 1))
    named = found.withColumn("concept", rule_name(F.col("after"))).where(F.col("concept") != "").withColumn("definition", X.tidy(X.sentence_at(F.col("text"), F.col("at"))))
    first = first_rows(named.withColumn("key", F.lower("concept")), 1, [chapter, "key"], [order])
    ten = first_rows(first, K.MAX_CONCEPTS, [chapter], [order], "ord")
    return ten.select(chapter, "ord", F.concat(F.col(chapter), F.lit("-kp"), F.lpad(F.col("ord").cast("string"), 3, "0")).alias("id"), "concept", "definition", F.array("anchor").alias("anchors"))


def rule_concepts_b(paragraphs: DataFrame, markers: str = K.MARKERS_B) -> DataFrame:
    """The pipeline's rule: a paragraph's first 14 characters are the name, a window about the marker the definition; nothing is deduplicated or capped."""
    at = F.length(F.regexp_extract("text", f"(?s)^(.*?)({markers})", 1))
    end = at + F.length(F.regexp_extract("text", f"(?s)^.*?({markers})", 1))
    start = F.greatest(at - 40, F.lit(0))
    name = F.regexp_replace(F.substring("text", 1, 14), "^[，。；: ：\t#]+|[，。；: ：\t#]+$", "")
    return paragraphs.where(F.col("text").rlike(markers)).withColumn("concept", name).withColumn("definition", X.strip(F.substr("text", start + 1, end + 160 - start))).where(F.col("concept") != "")


CONCEPT_JSON = "array<struct<concept:string,definition:string,prerequisites:array<string>,example:string,anchors:array<string>>>"


def normalized_concepts(replies: DataFrame, known: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """Concepts from a model's reply (chapter, reply): names cleaned, texts cut, anchors that the chapter has, six of them; the first of each name. known: chapter, anchors."""
    parsed = replies.select(chapter, F.from_json(X.json_text(F.col("reply"), "[", "]"), CONCEPT_JSON).alias("items")).join(known, chapter, "left")
    rows = parsed.select(chapter, "anchors", F.posexplode("items").alias("pos", "c")).withColumn("concept", X.clean_name(F.col("c.concept"))).where(F.col("concept") != "")
    rows = rows.withColumn("used", F.slice(F.filter(F.col("c.anchors"), lambda a: F.array_contains(F.col("anchors"), a)), 1, K.MAX_ANCHORS))
    first = first_rows(rows.withColumn("key", F.lower("concept")), 1, [chapter, "key"], ["pos"])
    kept = first_rows(first, K.MAX_CONCEPTS, [chapter], ["pos"], "ord")
    prerequisites = F.slice(F.filter(F.transform(F.coalesce("c.prerequisites", F.array().cast("array<string>")), X.clean_name), lambda p: p != ""), 1, K.MAX_PREREQUISITES)
    return kept.select(chapter, "ord", "concept", F.substring(F.coalesce("c.definition", F.lit("")), 1, K.MAX_TEXT).alias("definition"), prerequisites.alias("prerequisites"), F.substring(F.coalesce("c.example", F.lit("")), 1, K.MAX_TEXT).alias("example"), F.coalesce("used", F.array().cast("array<string>")).alias("anchors"))


# ---- graph ----


def _unions(named: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """keys, key, and for each of names (array columns) its values over all rows of a key, once each, in the order of their first place. A value counts once before anything is collected."""

    def named_values(name: str) -> Column:
        return F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda v, i: F.struct(F.lit(name).alias("name"), v.alias("v"), i.alias("i")))

    values = F.concat(*map(named_values, names))
    every = named.select(*keys, "key", "chapter_ord", "ord", F.explode(values).alias("x")).groupBy(*keys, "key", "x.name", "x.v").agg(F.min(F.struct("chapter_ord", "ord", "x.i")).alias("place"))
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == n, F.struct("place", "v")))), lambda s: s["v"]).alias(n) for n in names]
    return every.groupBy(*keys, "key").agg(*lists)


def graph_nodes(concepts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One node of each name, whatever its case. concepts: chapter_id, chapter_ord, ord, concept, definition, example, prerequisites, anchors, method [, status, mastery].

    The first spelling, definition and example that are not empty count; chapters, anchors and prerequisites are united in order."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in K.STATUSES]), F.col("status")), F.lit(1))
    named = concepts.withColumn("key", F.lower("concept")).withColumn("chapters", F.array(F.col("chapter_id").cast("string"))).withColumn("rank", rank)
    place = F.struct("chapter_ord", "ord")

    def first(name: str) -> Column:
        return F.coalesce(F.min_by(F.col(name), F.when(F.coalesce(F.col(name), F.lit("")) != "", place)), F.lit(""))

    single = named.groupBy(*keys, "key").agg(
        F.min_by("concept", place).alias("concept"),
        first("definition").alias("definition"),
        first("example").alias("example"),
        F.element_at(F.array(*[F.lit(s) for s in K.STATUSES]), F.max("rank").cast("int")).alias("status"),
        F.max(F.coalesce("mastery", F.lit(0.0))).alias("mastery"),
        F.when(F.coalesce(F.max(F.col("method") == "llm"), F.lit(False)), "llm").otherwise("rule").alias("method"),
    )
    united = _unions(named, keys, ["chapters", "anchors", "prerequisites"])
    return single.join(united, [*keys, "key"]).select(*keys, "key", "concept", "definition", "example", "chapters", "anchors", "prerequisites", "status", "mastery", "method")


def prerequisite_edges(nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, source, target: a node needs another; names that no node has are left out (see unresolved)."""
    asked = nodes.select(*keys, F.col("key").alias("source"), F.explode("prerequisites").alias("name")).withColumn("target", F.lower(X.strip(F.col("name"))))
    return asked.where(F.col("target") != F.col("source")).join(nodes.select(*keys, F.col("key").alias("target")), [*keys, "target"], "left_semi").select(*keys, "source", "target").distinct()


def unresolved(nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, name, required_by: prerequisites that are no nodes."""
    asked = nodes.select(*keys, F.col("key").alias("source"), F.col("concept"), F.explode("prerequisites").alias("name")).withColumn("key", F.lower(X.strip(F.col("name")))).where(F.col("key") != F.col("source"))
    return asked.join(nodes.select(*keys, "key"), [*keys, "key"], "left_anti").groupBy(*keys, "name").agg(F.sort_array(F.collect_set("concept")).alias("required_by"))


def sequence_edges(concepts: DataFrame, nodes: DataFrame, edges: DataFrame, across: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """keys, source, target: from each concept to the next in its chapter (or of the whole book), where no edge joins them either way."""
    part = [*keys] if across else [*keys, "chapter_id"]
    w = Window.partitionBy(*part).orderBy("chapter_ord", "ord")
    pairs = concepts.withColumn("target", F.lower("concept")).withColumn("source", F.lag("target").over(w)).where(F.col("source").isNotNull() & (F.col("source") != F.col("target")))
    pairs = pairs.join(nodes.select(*keys, F.col("key").alias("source")), [*keys, "source"], "left_semi").join(nodes.select(*keys, F.col("key").alias("target")), [*keys, "target"], "left_semi")
    held = edges.select(*keys, F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).distinct()
    pairs = pairs.select(*keys, "source", "target", F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"), F.struct("chapter_ord", "ord").alias("at")).join(held, [*keys, "lo", "hi"], "left_anti")
    return pairs.groupBy(*keys, "lo", "hi").agg(F.min_by(F.struct("source", "target"), "at").alias("e")).select(*keys, "e.source", "e.target")


def graph_stats(nodes: DataFrame, prerequisite: DataFrame, sequence: DataFrame, missing: DataFrame) -> DataFrame:
    """Five counts in one row."""
    out = nodes.agg(F.count(F.lit(1)).alias("concepts"), F.count_if(F.col("status") != "planned").alias("learned"))
    for rows, name in ((prerequisite, "prerequisites"), (sequence, "sequences"), (missing, "unresolved")):
        out = out.crossJoin(rows.agg(F.count(F.lit(1)).alias(name)))  # one row each
    return out


def concepts_of(kept: DataFrame, paragraphs: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """The columns of kept: the concepts kept of a chapter, or, where none are, those that rules find in its paragraphs."""
    missing = paragraphs.join(kept.select(chapter).distinct(), chapter, "left_anti")
    found = rule_concepts(missing, chapter)
    return kept.unionByName(found.select(*[c for c in kept.columns if c in found.columns]), allowMissingColumns=True)


def knowledge(concepts: DataFrame, progress: DataFrame, books: DataFrame, keys: Sequence[str] = ("book_id",)) -> dict[str, DataFrame]:
    """Tables of all books' graphs (keys first): nodes, relations (source, target, type), unresolved, and stats, one row a book.
    concepts: keys, chapter_id and what graph_nodes asks for; progress: keys, chapter_id, status, mastery; books: keys, title."""
    placed = concepts.drop("status", "mastery").join(progress.select(*keys, "chapter_id", "status", "mastery"), [*keys, "chapter_id"], "left")
    nodes = cut(graph_nodes(placed, keys))
    needed = cut(prerequisite_edges(nodes, keys))
    following = sequence_edges(placed, nodes, needed, keys=keys)
    relations = needed.withColumn("type", F.lit("prerequisite")).unionByName(following.withColumn("type", F.lit("sequence")))
    missing = unresolved(nodes, keys)
    counts = [nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("concepts"), F.count_if(F.col("status") != "planned").alias("learned"), F.count_if(F.col("method") == "llm").alias("by_model"))]
    counts.append(relations.groupBy(*keys).agg(F.count_if(F.col("type") == "prerequisite").alias("prerequisites"), F.count_if(F.col("type") == "sequence").alias("sequences")))
    counts.append(missing.groupBy(*keys).agg(F.count(F.lit(1)).alias("unresolved")))
    stats = books
    for rows in counts:
        stats = stats.join(rows, list(keys), "left")
    return {"nodes": nodes, "relations": relations, "unresolved": missing, "stats": stats.na.fill(0)}


def graph_b(concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pipeline's (nodes, edges): anchors are counted with repeats, chapters sorted; an edge may lead to its own node."""
    clean = concepts.withColumn("name", F.regexp_replace("concept", "(?U)^[\\s，。；：、]+|[\\s，。；：、]+$", "")).where(F.col("name") != "").withColumn("key", F.lower("name"))
    nodes = clean.groupBy("key").agg(F.min_by("name", F.struct("chapter_ord", "ord")).alias("concept"), F.min_by("definition", F.struct("chapter_ord", "ord")).alias("definition"), F.sort_array(F.collect_set("chapter_id")).alias("chapters"), F.sum(F.size("anchors")).alias("anchor_count"))
    asked = clean.select(F.col("key").alias("source"), F.explode("prerequisites").alias("name")).select("source", F.lower(F.regexp_replace("name", "(?U)^[\\s，。；：、]+|[\\s，。；：、]+$", "")).alias("target"))
    return nodes, asked.join(nodes.select(F.col("key").alias("target")), "target", "left_semi").select("source", "target").distinct()


# ---- lessons, quizzes, plans ----


def lesson_order(concepts: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """chapter, concept, position: concepts after their prerequisites in the chapter, else as they stand. Passes over the list are
    repeated, each putting out what has become ready, also by what the same pass put out; a cycle's concepts, and what needs them, come last.

    A concept's pass is the latest of its prerequisites', and one more where such a one stands behind it. Links are peeled off from those
    that need nothing: a round joins what has just become ready to the links that wait for it, for all chapters at once, and ends with what is ready then. There are as many
    rounds as the longest chain of prerequisites has links; each works on the links that are left, and none has a chapter in one task. Names are unique in a chapter."""
    held = cut(concepts.select(chapter, "ord", "concept", F.array_except(F.coalesce("prerequisites", F.array().cast("array<string>")), F.array("concept")).alias("needs")))
    asked = held.select(chapter, F.col("concept").alias("of"), "ord", F.explode("needs").alias("need"))
    links = asked.join(held.select(chapter, F.col("concept").alias("need"), F.col("ord").alias("need_ord")), [chapter, "need"])
    # pass: the first in which a link's concept may come out, once the link's prerequisite has; null before.
    waiting = cut(links.select(chapter, "of", "need", (F.col("need_ord") > F.col("ord")).cast("int").alias("later"), F.lit(None).cast("int").alias("pass")))
    ready = cut(waiting.select(chapter, F.col("need").alias("concept")).distinct().join(waiting.select(chapter, F.col("of").alias("concept")), [chapter, "concept"], "left_anti").withColumn("pass", F.lit(1)))
    out = []
    while ready.limit(1).count():
        met = waiting.join(small(ready.select(chapter, F.col("concept").alias("need"), F.col("pass").alias("__pass"))), [chapter, "need"], "left")
        waiting = cut(met.select(chapter, "of", "need", "later", F.coalesce("pass", F.col("__pass") + F.col("later")).alias("pass")))
        ready = cut(waiting.groupBy(chapter, F.col("of").alias("concept")).agg(F.max("pass").alias("pass"), F.count_if(F.col("pass").isNull()).alias("left")).where("left = 0").drop("left"))
        waiting = waiting.join(small(ready.select(chapter, F.col("concept").alias("of"))), [chapter, "of"], "left_anti")
        out.append(ready)
    linked = waiting.select(chapter, F.col("of").alias("concept"), F.lit(None).cast("int").alias("pass")).distinct()
    for found in out:
        linked = linked.union(found)
    placed = held.join(linked.withColumn("linked", F.lit(True)), [chapter, "concept"], "left").select(chapter, "concept", "ord", F.when(F.col("linked"), F.col("pass")).otherwise(1).alias("pass"))
    return numbered(placed, [chapter], [F.col("pass").asc_nulls_last(), "ord"], "position").select(chapter, "concept", "position")


def lessons(concepts_of: DataFrame, titles: DataFrame, known: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """chapter, title, steps (text, anchors): a step for each concept in lesson order, with Markdown taken off and anchors that the chapter has. known: chapter, anchors."""
    ordered = lesson_order(concepts_of, chapter).join(concepts_of.select(chapter, "concept", "definition", F.col("anchors").alias("own")), [chapter, "concept"]).join(known, chapter, "left")
    anchors = F.filter("own", lambda a: F.coalesce(F.array_contains(F.col("anchors"), a), F.lit(False)))
    step = F.struct("position", X.without_markdown(F.concat(F.col("concept"), F.lit("："), F.col("definition"))).alias("text"), anchors.alias("anchors"))
    steps = F.transform(F.array_sort(F.collect_list(step)), lambda s: F.struct(s["text"].alias("text"), s["anchors"].alias("anchors")))
    return ordered.groupBy(chapter).agg(steps.alias("steps")).join(titles, chapter, "left").select(chapter, "title", "steps")


def lesson_errors(lessons: DataFrame, anchors: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """chapter, error of lessons (chapter, title, steps of text and anchors) that break the contract."""
    known = anchors.groupBy(chapter).agg(F.collect_set("anchor").alias("known"))
    checked = lessons.join(known, chapter, "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    no_source = F.exists("steps", lambda s: F.size(F.coalesce(s["anchors"], F.array().cast("array<string>"))) == 0)
    foreign = F.exists("steps", lambda s: F.size(F.array_except(F.coalesce(s["anchors"], F.array().cast("array<string>")), F.col("known"))) > 0)
    empty = F.exists("steps", lambda s: F.coalesce(X.strip(s["text"]), F.lit("")) == "")
    found = F.array_compact(F.array(F.when(X.blank(F.col("title")), "no title"), F.when(F.coalesce(F.size("steps"), F.lit(0)) <= 0, "no steps"), F.when(no_source, "a step without source"), F.when(foreign, "an unknown anchor"), F.when(empty, "an empty step")))
    return checked.select(chapter, F.explode(found).alias("error"))


def heuristic_lesson(sections: DataFrame, chapter: str = "chapter_id", k: int = 3) -> DataFrame:
    """chapter, seq, text, anchor of each chapter's first k body sections; those without anchor go after the cut."""
    return first_rows(sections.where(F.col("kind") != "heading"), k, [chapter], ["seq"]).where(F.col("anchor").isNotNull())


def plan(chapters: DataFrame) -> DataFrame:
    """chapter_id, num, minutes, goal, overview."""
    return chapters.select(
        "chapter_id",
        "num",
        X.plan_minutes(F.length(F.coalesce("full_text", F.lit("")))).alias("minutes"),
        F.concat(F.lit("理解「"), "title", F.lit("」的核心内容，能复述关键概念。")).alias("goal"),
        F.concat(F.lit("从第 "), F.col("page_start").cast("string"), F.lit(" 页开始，共 "), (F.col("page_end") - F.col("page_start") + 1).cast("string"), F.lit(" 页。")).alias("overview"),
    )


def planned(replies: DataFrame, chapters: DataFrame, book: str = "book_id") -> DataFrame:
    """book, chapter_id, order, minutes, goal, overview of a model's plan (book, reply): items of chapters that there are, with values brought into their bounds."""
    items = "struct<items:array<struct<chapterId:string,order:int,duration_minutes:int,goal:string,overview:string>>>"
    listed = replies.select(book, F.posexplode(F.from_json(X.json_text(F.col("reply")), items)["items"]).alias("pos", "i")).select(book, "pos", F.col("i.chapterId").alias("chapter_id"), "i.*")
    known = listed.join(chapters.select(book, "chapter_id", "title"), [book, "chapter_id"])
    nth = F.row_number().over(Window.partitionBy(book).orderBy("pos"))
    return known.select(
        book,
        "chapter_id",
        F.coalesce(F.nullif("order", F.lit(0)), nth).alias("order"),
        F.least(F.lit(120), F.greatest(F.lit(15), F.coalesce(F.nullif("duration_minutes", F.lit(0)), F.lit(30)))).alias("minutes"),
        F.substring(F.coalesce(F.nullif("goal", F.lit("")), F.concat(F.lit("理解「"), "title", F.lit("」。"))), 1, 120).alias("goal"),
        F.substring(F.coalesce("overview", F.lit("")), 1, 160).alias("overview"),
    )


def lesson_points(replies: DataFrame, anchors: DataFrame, chapter: str = "chapter_id", most: int = 3) -> DataFrame:
    """chapter, nth, id, title, body, source of a model's lesson (chapter, reply): its first points, each with an anchor of the chapter, or else the chapter's first. anchors: chapter, anchor, seq."""
    points = "struct<points:array<struct<id:string,title:string,body:string,sourceId:string>>>"
    listed = replies.select(chapter, F.posexplode(F.slice(F.from_json(X.json_text(F.col("reply")), points)["points"], 1, most)).alias("pos", "p")).where(F.col("p").isNotNull())
    known = anchors.groupBy(chapter).agg(F.collect_set("anchor").alias("known"), F.min_by("anchor", "seq").alias("first"))
    nth = (F.col("pos") + 1).cast("string")
    return listed.join(known, chapter, "left").select(
        chapter,
        (F.col("pos") + 1).alias("nth"),
        F.coalesce(F.nullif("p.id", F.lit("")), F.concat(F.lit("kp"), nth)).alias("id"),
        F.substring(F.coalesce(F.nullif("p.title", F.lit("")), F.concat(F.lit("知识点 "), nth)), 1, 40).alias("title"),
        F.substring(F.coalesce("p.body", F.lit("")), 1, 500).alias("body"),
        F.when(F.coalesce(F.array_contains("known", F.col("p.sourceId")), F.lit(False)), F.col("p.sourceId")).otherwise(F.col("first")).alias("source"),
    )


def distractors(names: DataFrame, chapter: str = "chapter_id", k: int = K.DISTRACTORS) -> DataFrame:
    """chapter, concept, others: the k other names of the chapter nearest in length, then by name.

    Of names of one length only the first k + 1 can be among another's nearest, so a name meets these of each length, not all names of its chapter."""
    usable = names.where(F.length(X.strip(F.col("concept"))) >= K.LEAST_NAME).select(chapter, X.strip(F.col("concept")).alias("concept")).distinct()
    first = first_rows(usable.withColumn("__length", F.length("concept")), k + 1, [chapter, "__length"], ["concept"])
    every = first.groupBy(chapter).agg(F.collect_list("concept").alias("names"))
    near = F.array_sort(F.transform(F.filter("names", lambda n: n != F.col("concept")), lambda n: F.struct(F.abs(F.length(n) - F.length("concept")).alias("off"), n.alias("name"))))
    return usable.join(every, chapter).select(chapter, "concept", F.transform(F.slice(near, 1, k), lambda s: s["name"]).alias("others")).where(F.size("others") == k)


def questions(concepts: DataFrame, chapter: str = "chapter_id") -> DataFrame:
    """chapter, id, prompt, options, answer_index, concept, anchor: up to MAX_QUESTIONS cloze questions a chapter. concepts: chapter, ord, concept, definition, anchors."""
    held = concepts.withColumn("concept", X.strip(F.col("concept"))).where((F.length("concept") >= K.LEAST_NAME) & F.contains(F.col("definition"), F.col("concept")))
    cloze = held.withColumn("prompt", X.cloze(F.col("definition"), F.col("concept"))).where(F.length("prompt") >= K.LEAST_PROMPT)
    chosen = first_rows(cloze.join(distractors(concepts, chapter), [chapter, "concept"]), K.MAX_QUESTIONS, [chapter], ["ord"])

    @F.pandas_udf("array<string>")
    def shuffled(seed: pd.Series, options: pd.Series) -> pd.Series:
        def one(s: int, o: list) -> list:
            o = list(o)
            random.Random(int(s)).shuffle(o)
            return o

        return pd.Series([one(s, o) for s, o in zip(seed, options, strict=True)], dtype=object)

    made = chosen.withColumn("options", shuffled(X.seed_of(F.col(chapter).cast("string"), F.col("concept")), F.concat(F.array("concept"), F.col("others"))))
    anchor = F.coalesce(F.try_element_at("anchors", F.lit(1)), F.lit(""))
    return made.select(chapter, F.concat(F.col(chapter).cast("string"), F.lit("-q"), F.col("nth").cast("string")).alias("id"), "prompt", "options", (F.array_position("options", F.col("concept")) - 1).cast("int").alias("answer_index"), "concept", anchor.alias("anchor"))


def served(found: DataFrame) -> DataFrame:
    """Questions without their answers."""
    return found.drop("answer_index", "concept")


def graded(answers: DataFrame, found: DataFrame) -> DataFrame:
    """Answers (id, choice) with correct, and the quiz event's value."""
    return answers.join(found.select("id", "answer_index", "anchor"), "id").withColumn("correct", F.col("choice") == F.col("answer_index")).withColumn("value", F.col("correct").cast("double"))


def rule_summary(paragraphs: DataFrame, keys: Sequence[str], order: str, most: int = 6) -> DataFrame:
    """keys, summary: how many paragraphs there are and the first sentences of the first. paragraphs: keys, order, text."""
    heads = first_rows(paragraphs.where(~X.blank(F.col("text"))), most, keys, [order])
    line = F.concat(F.lit("- "), X.first_sentence(X.strip(F.col("text"))))
    listed = heads.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda s: s["line"]), "\n").alias("lines"))
    counted = paragraphs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(listed, list(keys)).select(*keys, F.concat(F.lit("本章共 "), F.col("n").cast("string"), F.lit(" 段正文，以下按段落顺序列出各段首句。\n"), "lines").alias("summary"))


def with_model(rows: DataFrame, prompt: str, make_client, reply: str = "reply", batch: int = 32) -> DataFrame:  # noqa: ANN001
    """rows with a model's reply to each prompt. make_client is called once in each task and gives a function from prompts to replies; a failure gives null, which rules then stand in for."""
    schema = T.StructType([*rows.schema.fields, T.StructField(reply, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            out: list = []
            for start in range(0, len(frame), batch):
                asked = frame[prompt].iloc[start : start + batch].tolist()
                try:
                    out += list(client(asked))
                except Exception:  # noqa: BLE001  whatever a remote model raises
                    out += [None] * len(asked)
            yield frame.assign(**{reply: out})

    return rows.mapInPandas(run, schema)


def with_retry(rows: DataFrame, prompt: str, shorter: str, make_client, reply: str = "reply", usable=lambda r: ~X.blank(r)) -> DataFrame:  # noqa: ANN001
    """rows with a model's reply to each prompt; those without a usable one are asked once more, with the shorter prompt (of half the material, say). First replies are kept in the shared folder, so none is asked for twice."""
    first = cut(with_model(rows, prompt, make_client, reply))
    good = F.coalesce(usable(F.col(reply)), F.lit(False))
    return first.where(good).unionByName(with_model(first.where(~good).drop(reply), shorter, make_client, reply))
