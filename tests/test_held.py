"""Documents are one short row each from the moment their text is read."""

from pyspark.sql import functions as F

from lectern.operators import index, search

TEXTS = [(1, "red fish red sky"), (2, "blue fish"), (3, ""), (4, None), (5, "sky über red red red"), (6, "nothing that is asked"), (7, "red fish"), (7, "fish red"), (7, "red"), (None, "red sky")]


def _tables(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    return docs, spark.createDataFrame([(1, "red sky"), (2, "fish fish red"), (3, ""), (4, "never")], "query_id int, query string")


def test_a_document_is_one_row_whatever_its_terms(spark):
    docs, asked = _tables(spark)
    held, weights, _ = index.weighed(docs, asked, "doc_id")
    term = {r["code"]: r["term"] for r in weights.collect()}
    rows = {(r["doc_id"], r["dl"]): (r["copies"], {term[c]: n for c, n in zip(r["codes"], r["tfs"], strict=True)}) for r in held.collect()}
    assert held.count() == len(rows) == 9
    assert rows[1, 4] == (1, {"red": 2, "fish": 1, "sky": 1}) and rows[3, 0] == rows[4, 0] == (1, {}) and rows[7, 2] == (2, {"red": 2, "fish": 2}) and rows[7, 1] == (1, {"red": 1})
    assert {r["term"]: r["df"] for r in weights.collect()} == {"red": 5, "fish": 3, "sky": 3}


def test_terms_too_many_for_a_broadcast_are_joined(spark, monkeypatch):
    docs, asked = _tables(spark)
    told = lambda rows: {(r["query_id"], r["doc_id"], round(r["score"], 9), r["matched"], tuple(r["recurring"])) for r in rows.collect()}
    few = told(search.best(docs, asked, 9, "doc_id"))
    monkeypatch.setattr(index, "MOST_BROADCAST", 0)
    assert few and told(search.best(docs, asked, 9, "doc_id")) == few


def test_pairs_meet_in_blocks(spark, monkeypatch):
    docs, asked = _tables(spark)
    docs = docs.where("doc_id <> 7")
    monkeypatch.setattr(index, "PAIRED", 2)
    monkeypatch.setattr(index, "POSED", 1)
    monkeypatch.setattr(index, "TOGETHER", 1)
    told = lambda rows: sorted((r["query_id"], r["doc_id"], r["matched"], tuple(r["recurring"]), r["coverage"]) for r in rows.collect())
    found = index.shared(docs, asked, "doc_id")
    assert told(found) == told(index.scores(docs, asked, "doc_id")) and "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert index.shared(docs, asked, "doc_id", recurring=False).columns == ["query_id", "doc_id", "matched", "coverage"]


def test_the_best_are_kept(spark):
    """What is made of the best more than once isn't searched more than once."""
    docs, asked = _tables(spark)
    plan = search.best(docs, asked, 2, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "Join" not in plan
    assert search.best(docs, asked, 2, "doc_id").where(F.col("rank") == 1).count() == 2


def test_an_index_of_segments_finds_the_best_without_shuffling_pairs(spark, tmp_path):
    from lectern.operators.segments import SegmentedIndex

    rows = [("a", i, f"red w{i % 3} " * (1 + i % 4)) for i in range(9)] + [("b", i, f"red sky{i}") for i in range(5)]
    made = SegmentedIndex(spark, str(tmp_path / "i"), buckets=2)
    made.change(spark.createDataFrame(rows, "book string, doc_id int, text string"))
    asked = spark.createDataFrame([(1, "red w1"), (2, "sky3")], "query_id int, query string")
    told = lambda found: {(r["query_id"], r["book"], r["rank"], r["doc_id"], round(r["score"], 8), r["matched"], tuple(r["recurring"]), r["coverage"]) for r in found.collect()}
    every = search.top(made.scores(asked), 3, F.round("score", 9), ["doc_id"], group=["query_id", "book"])
    assert len(told(every)) == 7 and told(made.best(asked, 3, details=True)) == told(every)
    made.change(spark.createDataFrame([(None, 1, "red"), ("b", None, "red red")], "book string, doc_id int, text string"))
    assert {(r["book"], r["doc_id"]) for r in made.best(asked, 9).where("query_id = 1").collect()} >= {(None, 1), ("b", None)}
