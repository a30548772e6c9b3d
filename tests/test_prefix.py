import contextlib
import io
import random

from pyspark.sql import functions as F

from lectern.operators import concepts, structure
from lectern.operators.prefix import numbered, running


def test_running_against_plain_sums(spark):
    r = random.Random(2)
    rows = [(g, p, r.choice([None, 1, 5, -2])) for g in ("a", "b", None) for p in sorted(r.sample(range(60), 35))]
    table = spark.createDataFrame(rows, "g string, p int, x int")
    for before in (False, True):
        got = {(x["g"], x["p"]): (x["s"], x["n"]) for x in running(table, ["g"], "p", {"s": F.col("x"), "n": F.lit(1)}, before, part=7).collect()}
        upto = lambda g, p: [x or 0 for h, q, x in rows if h == g and (q < p or q == p and not before)]
        assert got == {(g, p): (sum(upto(g, p)), len(upto(g, p))) for g, p, _ in rows}
    assert running(table.limit(0), ["g"], "p", {"s": F.col("x")}).count() == 0


def test_numbered_against_plain_order(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, 1, 2, 3]), i) for i in range(300)]
    table = spark.createDataFrame(rows, "g string, x int, id int").repartition(5)
    got = {x["id"]: x["n"] for x in numbered(table, ["g"], [F.col("x").desc_nulls_last(), "id"], "n").collect()}
    for g in ("a", "b", None):
        ids = [i for _, _, i in sorted((x is None, -(x or 0), i) for h, x, i in rows if h == g)]
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


def test_one_book_of_most_lines_is_many_tasks(spark):
    """Half of all lines are one book's: no window has more rows than a part of it, and pages are those of plain sums."""
    lines = spark.range(40_000).select(F.when(F.col("id") < 20_000, 0).otherwise(1 + F.col("id") % 50).cast("int").alias("book"), F.when(F.col("id") < 20_000, F.col("id")).otherwise(F.floor(F.col("id") / 50)).cast("int").alias("pos"), F.concat(F.lit("line "), F.col("id") % 97).alias("text"))
    paged = structure.virtual_pages(lines)
    before, expected = {}, {}
    for r in sorted(lines.collect()):
        expected[r["book"], r["pos"]] = 1 + before.get(r["book"], 0) // 1200
        before[r["book"]] = before.get(r["book"], 0) + len(r["text"])
    assert {(r["book"], r["pos"]): r["page"] for r in paged.collect()} == expected
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        paged.explain()
    windows = [line for line in out.getvalue().split("\n") if "Window" in line]
    # One over parts' totals, one over a part's rows.
    assert windows and all("__part" in w for w in windows)


def test_lesson_order_of_one_large_chapter(spark):
    """A chapter of a third of all rows, with a chain, a fan and a cycle."""
    n = 900
    rows = [("big", i, f"c{i}", [f"c{i - 1}"] if 0 < i < 12 else ["c3", "c5"] if i % 3 == 0 and i >= 12 else [f"c{i + 1}"] if i in (400, 500) else ["c502"] if i == 503 else []) for i in range(n)]
    rows += [(f"s{i % 90}", i, f"d{i}", [f"d{i + 90}"]) for i in range(2 * n)]
    rows[700] = ("big", 700, "c700", ["c701"])
    rows[701] = ("big", 701, "c701", ["c700"])
    table = spark.createDataFrame(rows, "chapter_id string, ord int, concept string, prerequisites array<string>")
    chapters = {}
    for c, o, name, needs in rows:
        chapters.setdefault(c, []).append((o, name, needs))
    expected = {}
    for c, held in chapters.items():
        names, done, order, pending = {h[1] for h in held}, set(), [], sorted(held)
        while pending:
            left = []
            for h in pending:
                if all(x in done or x not in names or x == h[1] for x in h[2]):
                    order.append(h[1])
                    done.add(h[1])
                else:
                    left.append(h)
            if len(left) == len(pending):
                order += [h[1] for h in left]
                left = []
            pending = left
        expected |= {(c, name): i + 1 for i, name in enumerate(order)}
    assert {(r["chapter_id"], r["concept"]): r["position"] for r in concepts.lesson_order(table).collect()} == expected
