import pytest
from pyspark.sql import functions as F

from lectern.operators.replies import Replies, key_of


def counting(folder):
    """A client that leaves a line for each prompt it is asked, fails for prompts with 'bad', and gives nothing useful for 'empty'."""

    def make():
        def ask(prompts):
            import pathlib
            import uuid

            (pathlib.Path(folder) / uuid.uuid4().hex).write_text("\n".join(prompts))
            if any("bad" in p for p in prompts):
                raise RuntimeError
            return ["" if "empty" in p else p.upper() for p in prompts]

        return ask

    return make


def test_nothing_is_asked_twice(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def asked():
        found = sorted(line for p in calls.iterdir() for line in p.read_text().split("\n"))
        for p in calls.iterdir():
            p.unlink()
        return found

    rows = lambda *texts: spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, text string, key int").repartition(1)
    answers = lambda df: {r["id"]: r["reply"] for r in df.collect()}
    one = Replies(spark, str(tmp_path / "kept"), "m")
    out = one.answered(rows("a", "b", "a"), "text", counting(calls))
    assert answers(out) == answers(out) == {0: "A", 1: "B", 2: "A"} and asked() == ["a", "b"]
    # A second session asks nothing; a changed paragraph asks once; another model, or other material, asks anew.
    two = Replies(spark, str(tmp_path / "kept"), "m")
    assert answers(two.answered(rows("a", "b", "a"), "text", counting(calls))) == {0: "A", 1: "B", 2: "A"} and asked() == []
    assert answers(two.answered(rows("a", "b!"), "text", counting(calls))) == {0: "A", 1: "B!"} and asked() == ["b!"]
    assert answers(Replies(spark, str(tmp_path / "kept"), "other").answered(rows("a"), "text", counting(calls))) == {0: "A"} and asked() == ["a"]
    assert answers(two.answered(rows("a"), "text", counting(calls), material=["key"])) == {0: "A"} and asked() == ["a"]
    # What fails is not kept; half of it may do.
    assert answers(two.answered(rows("bad"), "text", counting(calls))) == {0: None} and asked() == ["bad"]
    half = lambda p: F.substring(p, 1, 2)
    assert answers(two.answered(rows("bad"), "text", counting(calls), shorter=half)) == {0: "BA"} and asked() == ["ba", "bad"]
    assert answers(two.answered(rows("bad"), "text", counting(calls))) == {0: "BA"} and asked() == []
    assert answers(two.answered(rows("empty", None), "text", counting(calls), good=lambda r: r != ""))[0] is None and "empty" in asked()
    two.forget(spark.range(1).select(key_of("m", F.lit("a")).alias("key")))
    assert answers(two.answered(rows("a", "b"), "text", counting(calls))) == {0: "A", 1: "B"} and asked() == ["a"]
    with pytest.raises(ValueError, match="column"):
        two.answered(rows("a").withColumn("reply", F.lit(1)), "text", counting(calls))


def test_keys_do_not_run_together(spark):
    keys = [spark.range(1).select(key_of("m", *map(F.lit, parts))).first()[0] for parts in (("ab", "c"), ("a", "bc"), ("abc", ""), ("abc",), ("", "abc"))]
    assert len(set(keys)) == 5
