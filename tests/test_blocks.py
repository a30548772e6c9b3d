from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import index, search
from lectern.plans.retrieval import questions, sections


def test_blocks_find_the_best_of_all_scores(spark, sf_dir, monkeypatch):
    """Many small blocks of documents and queries against the scores of all pairs."""
    monkeypatch.setattr(search, "SCORED", 30)
    monkeypatch.setattr(search, "POSED", 2)
    monkeypatch.setattr(search, "AT_ONCE", 4)
    docs, asked = sections(spark, sf_dir), questions(spark, sf_dir)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    every = index.scores(docs, asked, "doc_id").withColumn("rank", F.row_number().over(order)).where("rank <= 7")
    told = lambda rows: {(r["query_id"], r["rank"], r["doc_id"], round(r["score"], 7), r["matched"], tuple(r["recurring"]), round(r["coverage"], 9)) for r in rows.collect()}
    assert told(search.best(docs, asked, 7, "doc_id")) == told(every)


def test_shared_terms_are_told_without_a_shuffle_of_pairs(spark, sf_dir):
    docs, asked = sections(spark, sf_dir), questions(spark, sf_dir)
    told = lambda rows: {(r["query_id"], r["doc_id"], r["matched"], tuple(r["recurring"]), r["coverage"]) for r in rows.collect()}
    found = index.shared(docs, asked, "doc_id")
    assert told(found) == told(index.scores(docs, asked, "doc_id"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan


def test_vectors_of_many_blocks_meet_every_query(spark, monkeypatch):
    """Without partitions being joined afterwards, as happens to small ones only."""
    monkeypatch.setattr(search, "VECTORS", 10)
    monkeypatch.setattr(search, "ASKED", 3)
    rows = [(i, [float(i % 7), float(i % 11) - 5.0, 1.0 + i]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 6 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = {(r["query_id"], r["rank"], r["vec_id"]) for r in search.vector_hits(vectors, asked, 5, "vec_id").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {(q, n, j) for q, v in rows if q % 6 == 0 for n, j in enumerate(sorted((j for j, _ in rows), key=lambda j: (-round(cos(v, rows[j][1]), 9), j))[:5], 1)}
    assert found == want
