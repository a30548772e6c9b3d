import random
import re


from lectern.operators import pages, structure

SPANS = "book string, page int, block int, ord int, span int, text string, size double, flags int, font string, y double"


def styles(spark, rows, body=10.0):
    table = spark.createDataFrame([("b", 0, *r) for r in rows], "book string, page int, block int, ord int, text string, size double, flags int, font string, y double")
    sizes = spark.createDataFrame([("b", body)], "book string, body double")
    return {r["text"]: r["style"] for r in pages.span_styles(table, sizes).collect()}


def test_styles_of_spans(spark):
    # Block 1: a baseline of the largest span; block 2: nothing to compare with but itself.
    rows = [(1, 0, "plain", 10.0, 0, "Demo", 100.0), (1, 1, "bold", 10.0, 16, "Demo", 100.0), (1, 2, "name", 10.0, 0, "Demo-Bold", 100.0), (1, 3, "up", 6.0, 0, None, 95.0), (1, 4, "down", 6.0, 0, "", 104.0), (1, 5, "small", 8.0, 0, "", 101.0), (1, 6, "flag", 6.0, 1, "", 100.0)]
    rows += [(2, 0, "big", 12.0, 2, "X-Oblique", 50.0), (2, 1, "nosize", 0.0, 0, "", 20.0), (3, 0, "alone", 6.0, 0, "", 7.0)]
    assert styles(spark, rows) == {"plain": [], "bold": ["b"], "name": ["b"], "up": ["sup"], "down": ["sub"], "small": ["sm"], "flag": ["sup"], "big": ["i", "lg"], "nosize": [], "alone": ["sm"]}


def test_runs_follow_their_text_against_characters(spark):
    """Every character of a paragraph has the style of the span that it came from."""
    r = random.Random(7)
    lines, runs, chars = [], [], {}
    for book in range(25):
        at, paragraph, held = 0, 0, []
        for pos in range(r.randrange(1, 14)):
            parts = [(r.choice(["", " ", "ab", "c d ", " 12", "end of it.", "结束。", "中 http://x.y/z", "http://only.example", "12"]), r.choice([[], ["b"], ["i", "sup"]])) for _ in range(r.randrange(0, 4))]
            line = "".join(t for t, _ in parts)
            lines.append((book, pos, line))
            runs += [(book, pos, n, t, s) for n, (t, s) in enumerate(parts)]
            bare = line.strip()
            if bare and (len(bare) <= 8 and re.fullmatch(r"[\d\s\-—.·]+", bare) or re.fullmatch(r"(?:https?://|www\.)\S+", bare)):
                continue
            held += [(c, tuple(s)) for t, s in parts for c in t] if bare else []
            if not bare or (re.search(r"[。．？！；：!?;”』」…]$|(?<!\d)\.\s*$", bare) and len(bare) > 6):
                chars[book, paragraph] = held
                paragraph, held = paragraph + 1, []
        chars[book, paragraph] = held
    expected = {}
    for key, held in chars.items():
        text = re.sub(r"(?<=[一-鿿])\s*(?:https?://|www\.)\S+\s*$", "", "".join(c for c, _ in held))
        start = len(text) - len(text.lstrip())
        if text.strip():
            expected[key] = held[start : start + len(text.strip())]
    found = structure.reflow_runs(spark.createDataFrame(lines, "book int, pos int, text string"), spark.createDataFrame(runs, "book int, pos int, span int, text string, style array<string>")).collect()
    got = {(x["book"], x["paragraph"]): [(c, tuple(run["style"])) for run in x["runs"] for c in run["text"]] for x in found}
    assert got == expected and all("".join(run["text"] for run in x["runs"]) == x["text"] for x in found)
    assert all(a["style"] != b["style"] for x in found for a, b in zip(x["runs"], x["runs"][1:], strict=False))


def test_lines_without_runs_are_plain(spark):
    lines = spark.createDataFrame([("b", 0, "no runs here"), ("b", 1, " and none here.")], "book string, pos int, text string")
    none = spark.createDataFrame([], "book string, pos int, span int, text string, style array<string>")
    row = structure.reflow_runs(lines, none).first()
    assert row["text"] == "no runs hereand none here." and [(r["text"], r["style"]) for r in row["runs"]] == [(row["text"], [])]


def test_titles_are_cut_whatever_their_spaces(spark):
    rows = [("Part  one begins", "Part one"), ("Partone", "Part one"), ("Part on e: text", "Part one"), ("Other", "Part one"), ("Part one", ""), (None, "x")]
    table = spark.createDataFrame([(i, t, n, [(t or "", ["b"])]) for i, (t, n) in enumerate(rows)], "i int, text string, title string, runs array<struct<text:string,style:array<string>>>")
    got = [(r["text"], "".join(x["text"] for x in r["runs"])) for r in pages.without_title(table, runs="runs").orderBy("i").collect()]
    assert got == [("begins", "begins"), ("Partone", "Partone"), (": text", ": text"), ("Other", "Other"), ("Part one", "Part one"), (None, "")]


def test_page_book_with_runs(spark):
    lines, spans = [], []
    for page in range(3):
        for ord_, parts in enumerate([[("Running head", 0)], [("Chap", 16), ("ter text, ", 0)] if page == 0 else [("More of it, ", 2)], [("and an ", 0), (f"end {page}", 16), (".", 0)]]):
            y = 10.0 + 50 * ord_
            lines.append(("b", page, y, ord_, 10.0, 800.0, "".join(t for t, _ in parts).strip()))
            spans += [("b", page, ord_, ord_, n, t, 10.0, flags, "Demo", y) for n, (t, flags) in enumerate(parts)]
    marks = spark.createDataFrame([("b", 1, 1, "Chap", 1)], "book string, ord int, level int, title string, page int")
    assets = spark.createDataFrame([("b", 1, 5.0, "image", "", 9000.0)], "book string, page int, y double, kind string, text string, area double")
    out = pages.page_book(spark.createDataFrame(lines, "book string, page int, y double, ord int, size double, height double, text string"), marks, assets, spans=spark.createDataFrame(spans, SPANS))
    rows = out.orderBy("seq").collect()
    assert [(r["page"], r["kind"], r["text"], [(x["text"], x["style"]) for x in r["runs"]]) for r in rows] == [
        (1, "p", "ter text, and an end 0.", [("ter text, and an ", []), ("end 0", ["b"]), (".", [])]),
        (2, "image", "（插图）", []),
        (2, "p", "More of it, and an end 1.", [("More of it, ", ["i"]), ("and an ", []), ("end 1", ["b"]), (".", [])]),
        (3, "p", "More of it, and an end 2.", [("More of it, ", ["i"]), ("and an ", []), ("end 2", ["b"]), (".", [])]),
    ]


def test_runs_of_a_paragraph_are_shuffled_by_it_once(spark):
    lines = spark.createDataFrame([(1, 0, " ab"), (1, 1, "cd "), (1, 2, "ef.")], "book int, pos int, text string")
    runs = spark.createDataFrame([(1, p, i, t, s) for p, i, t, s in ((0, 0, " ", ["b"]), (0, 1, "ab", []), (1, 0, "cd ", []), (2, 0, "ef.", ["i"]))], "book int, pos int, span int, text string, style array<string>")
    found = structure.reflow_runs(lines, runs)
    row = found.first()
    assert (row["text"], [(r["text"], r["style"]) for r in row["runs"]]) == ("abcd ef.", [("abcd ", []), ("ef.", ["i"])])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = structure.reflow_runs(lines, runs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Exchange hashpartitioning" in line and ", paragraph#" in line for line in plan.splitlines()) == 1
