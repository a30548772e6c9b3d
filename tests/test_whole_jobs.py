import itertools
import random

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import anchors
from lectern.plans import forms, knowledge, reading


def test_quiz_questions_reads_every_part(spark, tmp_path):
    rows = [(k, k % 3, f"KIND {'x' * (k % 7)}{k}") for k in range(1, 30)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = knowledge.quiz_questions(spark, str(tmp_path)).collect()
    for chapter in range(3):
        held = sorted((k, t) for k, c, t in rows if c == chapter)
        asked = sorted((q for q in found if q["chapter_id"] == chapter), key=lambda q: int(q["anchor"]))
        assert asked and [(int(q["anchor"]), q["concept"]) for q in asked] == held[: len(asked)]
        for q in asked:
            near = sorted((abs(len(t) - len(q["concept"])), t) for _, t in held if t != q["concept"])[:3]
            assert set(q["options"]) == {q["concept"], *(t for _, t in near)} and q["options"][q["answer_index"]] == q["concept"]


def test_selection_is_found_beyond_the_start_of_a_longer_document(spark, tmp_path):
    needle = "a passage that two documents of one page hold and no other does so"
    rows = [(20, "." * 29 + needle, "en"), (21, "other words " * 50 + needle + " with more", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in reading.selection_match(spark, str(tmp_path)).collect()] == [(20, 21, 1.0)]


def test_selection_match_against_brute_force_on_all_rows(spark, sf_dir):
    """Every selection with every document of the pages around it, by the stated scores."""
    form = lambda column: F.collect_list(F.struct("doc_id", "lang", X.loose_match_form(column).alias("form")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = {r["doc_id"]: (r["lang"], r["form"]) for r in docs.select(form(F.col("text")).alias("x")).first()["x"]}
    asked = {r["doc_id"]: r["form"] for r in docs.where("doc_id % 20 = 0").select(form(F.substring("text", 30, 60)).alias("x")).first()["x"]}
    expected = set()
    for i, needle in asked.items():
        page, scored = i // 10 + (i % 40 == 0), []
        for turn, offset in enumerate((0, -1, 1, -2, 2)):
            for j in range(10 * (page + offset), 10 * (page + offset) + 10):
                if len(needle) >= 4 and j in held and held[j][0] == held[i][0]:
                    body = held[j][1]
                    run = next((n for n in range(len(needle), 0, -1) if any(needle[a : a + n] in body for a in range(len(needle) - n + 1))), 0)
                    scored.append((run / len(needle) * (1.0 if offset == 0 else 0.5), len(body), -turn, j, run / len(needle)))
        best = max(scored, default=None, key=lambda x: x[:3])
        if best and best[0] > 0 and best[4] >= 0.6:
            expected.add((i, best[3], round(best[4], 9)))
    assert len(expected) >= 5 and {(r["selection_id"], r["anchor"], round(r["ratio"], 9)) for r in reading.selection_match(spark, sf_dir).collect()} == expected


def test_longest_common_run_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("ab é") for _ in range(r.randrange(15))) for _ in range(2))
        every = {a[i:j] for i, j in itertools.combinations(range(len(a) + 1), 2)}
        assert anchors.longest_common_run(a, b) == max((len(x) for x in every if x in b), default=0)


def test_formula_lines_judge_the_whole_of_long_lines(spark, tmp_path):
    spark.createDataFrame([(1, "a\n" + "b" * 130), (2, "x = 1\n")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in forms.formula_lines(spark, str(tmp_path)).collect()) == [(1, 1, 0), (1, 1, 1), (1, 1, 2), (2, 0, 0), (2, 1, 0)]
