"""The whole way of a book: files to chapters, chunks, index, concepts, graph and lessons, as tables of one snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import chunking, concepts, index, search, structure
from lectern.sinks import markdown
from lectern.sources import files


def build(spark: SparkSession, path: str, dialect: str = "b") -> dict[str, DataFrame]:
    """Tables of the text and docx files below a path: paragraphs, statistics, manifest, chunks, postings, vectors, concepts, nodes, edges, lessons."""
    found = files.files(spark, path)
    docx = files.docx_rows(found, tables=False).where("kind = 'p'").select("book", "pos", "text", "level")
    rows = files.text_books(found, dialect).unionByName(docx)
    paragraphs = structure.pipeline_chapters(rows).withColumn("part", F.lit(1)).withColumn("chapter_id", F.concat("book", F.lit("-ch"), F.col("chapter").cast("string"))).withColumn("anchor", F.concat("chapter_id", F.lit("-p"), F.lpad(F.col("nth").cast("string"), 3, "0")))
    chunks = chunking.chunks(paragraphs, ["chapter_id"], "nth").withColumn("chunk_id", F.concat("chapter_id", F.lit("-c"), F.col("chunk").cast("string")))
    named = concepts.rule_concepts_b(paragraphs).select("chapter_id", F.col("chapter").alias("chapter_ord"), F.col("nth").alias("ord"), "concept", "definition", F.array().cast("array<string>").alias("prerequisites"), F.array("anchor").alias("anchors"))
    nodes, edges = concepts.graph_b(named)
    return {
        "paragraphs": paragraphs,
        "statistics": structure.text_statistics(paragraphs, ["book", "chapter_id"]),
        "manifest": markdown.manifest(paragraphs),
        "chunks": chunks,
        "postings": index.postings(chunks, ["chapter_id", "chunk_id"]),
        "vectors": search.hashed_vectors(chunks, ["chapter_id", "chunk_id"]),
        "concepts": named,
        "nodes": nodes,
        "edges": edges,
        "lessons": concepts.lesson_order(named),
    }


def ask(chunks: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """query_id, found, anchors (ten at most), texts of the best chunks of each query."""
    hits = search.hybrid_search(chunks, queries, k, "chunk_id").join(chunks.select("chunk_id", "text", "anchors"), "chunk_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "anchors", "text")))
    joined = hits.groupBy("query_id").agg(ordered.alias("h"))
    return queries.select("query_id").join(joined, "query_id", "left").select("query_id", (F.coalesce(F.size("h"), F.lit(0)) > 0).alias("found"), F.slice(F.array_distinct(F.flatten(F.transform("h", lambda x: x["anchors"]))), 1, 10).alias("anchors"), F.transform("h", lambda x: x["text"]).alias("texts"))
