import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import index
from lectern.operators.segments import SegmentedIndex

SCHEMA = "book string, doc_id int, text string, score double"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 7.0) for r in rows], SCHEMA)


def _scores(df):
    return {(r["query_id"], r["book"], r["doc_id"]): (round(r["score"], 9), r["matched"], tuple(r["recurring"]), round(r["coverage"], 9)) for r in df.collect()}


def _expected(spark, held, asked):
    return _scores(index.scores(_frame(spark, [(b, i, t) for (b, i), t in held.items()]), asked, "doc_id", ["book"]))


def test_any_course_of_changes_gives_the_scores_of_an_index_from_scratch(spark, tmp_path):
    r = random.Random(3)
    words = ["red", "fish", "blue", "sky", "über", "x1", "a"]
    asked = spark.createDataFrame([(1, "red blue blue"), (2, "fish nothing"), (3, "")], "query_id int, query string")
    held, made = {}, SegmentedIndex(spark, str(tmp_path / "i"), buckets=3)
    for step in range(4):
        put = {(r.choice("ab"), r.randrange(12)): " ".join(r.choice(words) for _ in range(r.randrange(9))) for _ in range(r.randrange(1, 9))}
        out = {k for k in held if r.random() < 0.2} - set(put)
        made.change(_frame(spark, [(*k, t) for k, t in put.items()]), _frame(spark, [(*k, "") for k in out]) if out else None)
        held = {k: t for k, t in held.items() if k not in out} | put
        if step == 2:
            before = len(made.segments)
            assert (merged := made.merge()) and len(made.segments) == before - merged + 1
            assert made.sweep() and made.sweep() == []
        again = SegmentedIndex(spark, str(tmp_path / "i"), buckets=3)  # as another session would open it
        assert again.version == made.version and _scores(again.scores(asked)) == _expected(spark, held, asked)
    sums = {b["book"]: (b["n"], b["tokens"]) for b in made.books().collect()}
    assert sums == {b: (sum(k[0] == b for k in held), sum(len(t.split()) for k, t in held.items() if k[0] == b)) for b in sums}


def test_only_stale_books_are_refreshed(spark, tmp_path):
    made = SegmentedIndex(spark, str(tmp_path / "i"))
    assert made.scores is not None and made.stale(_frame(spark, [("a", 1, "x")])).collect()[0]["held"] is None
    first = [("a", 1, "red"), ("a", 2, "blue"), ("b", 1, "red"), (None, 1, None), ("c", None, "sky")]
    assert made.refresh(_frame(spark, first)) and not made.refresh(_frame(spark, first[::-1]))
    # The same number of documents, one of them changed; a book that is gone; one that is new.
    then = [("a", 1, "red"), ("a", 2, "green"), (None, 1, None), ("c", None, "sky"), ("d", 5, "red")]
    assert sorted((str(r["book"]), r["held"], r["now"]) for r in made.stale(_frame(spark, then)).collect()) == [("a", 2, 2), ("b", 1, None), ("d", None, 1)]
    assert made.refresh(_frame(spark, then)) and made.stale(_frame(spark, then)).count() == 0
    # What was written for the second version: the changed and the new document only.
    assert made.segments[-1]["docs"] == 2 and made._read("gone", [made.segments[-1]["segment"]]).count() == 2
    asked = spark.createDataFrame([(1, "a", "red green blue"), (2, "d", "red"), (3, "b", "red")], "query_id int, book string, query string")
    assert {(q, d) for q, _, d in _scores(made.scores(asked))} == {(1, 1), (1, 2), (2, 5)}


def test_a_change_that_dies_is_not_seen_and_twice_named_documents_are_refused(spark, tmp_path):
    made = SegmentedIndex(spark, str(tmp_path / "i"))
    made.change(_frame(spark, [("a", 1, "red")]))
    with pytest.raises(ValueError, match="twice"):
        made.change(_frame(spark, [("a", 2, "red"), ("a", 2, "blue")]))
    again = SegmentedIndex(spark, str(tmp_path / "i"))
    assert again.version == 1 and again.live().count() == 1
    assert len(again.sweep()) == 1  # what the failed change had written
    again.change(deleted=_frame(spark, [("a", 1, ""), ("z", 9, "")]))
    assert again.live().count() == 0 and again.books().count() == 0
    again.change(deleted=_frame(spark, [("a", 1, "")]))
    assert again.version == 2  # nothing to publish


def test_a_large_book_and_a_frequent_term_lie_in_many_files(spark, tmp_path):
    docs = spark.range(4000).select(F.lit("a").alias("book"), F.col("id").cast("int").alias("doc_id"), F.concat(F.lit("common w"), F.col("id") % 50).alias("text"), F.lit(0.0).alias("score"))
    made = SegmentedIndex(spark, str(tmp_path / "i"), buckets=2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    made.change(docs)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = made._read("postings").where("term = 'common'").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 2 and max(f["count"] for f in files) < 3900


def test_merges_keep_the_number_of_segments_small(spark, tmp_path):
    made = SegmentedIndex(spark, str(tmp_path / "i"), buckets=1)
    for i in range(5):
        made.change(_frame(spark, [("a", i, "red")]))
        made.merge()
    assert len(made.segments) <= 3 and made.live().count() == 5
