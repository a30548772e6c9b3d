import contextlib
import io
import random

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import containment
from lectern.operators.containment import contained


def test_against_every_pair(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("ab-é ") for _ in range(r.randrange(3, 9)))
    held = [(i, r.choice("xyz"), "".join(word() for _ in range(r.randrange(12))), 9 - i % 4) for i in range(80)] + [(90, "x", None, 1), (91, "y", "", 1), (92, None, "abababab", 1), (93, "x", "Ａｂ c" * 4000 + "needle at the end", 1)]
    asked = [(i, r.choice("xyz"), word() + (word() if i % 2 else "")) for i in range(150)] + [(200, "x", "abc abc"), (200, "x", "abc abc"), (201, "x", "Ｎ"), (202, "x", None), (203, None, "abab"), (204, "x", "ｎeedle-at the e"), (205, "z", "aaaa"), (205, "z", "aaaa")]
    needles = spark.createDataFrame(asked, "id int, chapter string, needle string")
    paragraphs = spark.createDataFrame(held, "found int, chapter string, text string, ord int")
    plain = lambda t: "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in (t or "")).replace(" ", "").replace("-", "")
    expected = []
    for i, chapter, needle in asked:
        found = [(-len(plain(t)), o, p) for p, c, t, o in held if c == chapter and c is not None and len(plain(needle)) >= 4 and plain(needle) in plain(t)]
        if found:
            best = min(f[:2] for f in found)
            expected.append((i, {p for a, b, p in found if (a, b) == best}))
    for split in (20_000, 2):  # the second deals frequent runs over many keys
        got = [(r["id"], r["found"]) for r in contained(needles, paragraphs, ["chapter"], "id", "found", ["ord"], split).collect()]
        assert sorted(i for i, _ in got) == sorted(i for i, _ in expected) and len(got) > 40
        ways = {}
        for i, p in expected:
            ways.setdefault(i, set()).update(p)
        assert all(p in ways[i] for i, p in got)


def test_runs_are_numbered_once_and_many_needles_need_no_broadcast(spark, monkeypatch):
    text = "".join(chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x10400)] if c != 0x180E) + "　a-b c"
    monkeypatch.setattr(containment, "STEP_CHARS", 1_000)
    form = spark.createDataFrame([(text,)], "t string").select(X.match_form(F.col("t"))).first()[0]
    plain = lambda t: np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
    parts = list(containment.steps(text))
    assert [x for p in parts for x in containment.numbers(p, 3)] == list(containment.numbers(plain(form), 3)) and len(parts) > 50
    assert spark.createDataFrame([(text, 3)], "t string, s long").select(containment.slots(F.col("t"), F.col("s"))["body"]).first()[0] == form
    assert len(containment.numbers(plain("abc"))) == 0 and list(containment.steps("")) == []
    needles = spark.createDataFrame([(i, f"needle {i} of all") for i in range(20)], "id int, needle string")
    paragraphs = spark.createDataFrame([(i, f"there the needle {i} of all is" + "x" * i) for i in range(0, 30, 2)], "found int, text string")
    for most in (100, 3):  # the second joins by shuffles
        got = {(r["id"], r["found"]) for r in contained(needles, paragraphs, [], "id", "found", ["found"], 2, most).collect()}
        assert got == {(i, i) for i in range(0, 20, 2)}
    told = spark.createDataFrame([("abcdabcd", 0)] * 3, "text string, __scope long")
    assert sorted(r["n"] for r in containment.counted(told).groupBy("__slot").agg({"__n": "sum"}).withColumnRenamed("sum(__n)", "n").collect()) == [3, 3, 3, 6]


def test_no_pair_of_rows_is_compared_that_shares_nothing(spark):
    needles = spark.createDataFrame([(1, "abcdef")], "id int, needle string")
    paragraphs = spark.createDataFrame([(1, "xx abcdef xx"), (2, "nothing of it")], "found int, text string")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        contained(needles, paragraphs, [], "id", "found", ["found"]).explain()
    assert "NestedLoop" not in out.getvalue() and "Cartesian" not in out.getvalue()


def test_empty_tables(spark):
    needles = spark.createDataFrame([(1, "abcdef")], "id int, needle string")
    paragraphs = spark.createDataFrame([(1, "xx abcdef xx")], "found int, text string")
    assert contained(needles.limit(0), paragraphs, [], "id", "found", ["found"]).count() == 0
    assert contained(needles, paragraphs.limit(0), [], "id", "found", ["found"]).count() == 0
