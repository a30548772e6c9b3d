import io
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import anchors, chunking, concepts, lifecycle, pages, structure
from lectern.sources import files

BOOK = """# 学习入门
## 第一章 基础
前言一段。
### 1.1 小节
梯度是指函数变化最快的方向。
```
# 不是标题
```
## 第二章 进阶
y = f(x)
最后一段。"""


def rows_of(spark, text, dialect="a"):
    return structure.outline_rows(structure.lines(spark.createDataFrame([("b", text)], "book string, text string")), dialect)


def test_outline_of_both_dialects(spark):
    a = [(r["level"], r["text"]) for r in rows_of(spark, BOOK).orderBy("pos").collect()]
    b = [(r["level"], r["text"]) for r in rows_of(spark, BOOK, "b").orderBy("pos").collect()]
    assert (0, "# 不是标题") in a and (0, "# 不是标题") not in b
    assert a[0] == (1, "学习入门") and (3, "1.1 小节") in a


def test_book_of_an_outline(spark):
    out = structure.assemble(structure.blocks(rows_of(spark, BOOK))).orderBy("num", "seq").collect()
    assert [(r["num"], r["title"], r["kind"], r["text"]) for r in out] == [
        (1, "第一章 基础", "p", "前言一段。"),
        (1, "第一章 基础", "heading", "1.1 小节"),
        (1, "第一章 基础", "p", "梯度是指函数变化最快的方向。"),
        (1, "第一章 基础", "p", "# 不是标题"),
        (2, "第二章 进阶", "formula", "y = f(x)"),
        (2, "第二章 进阶", "p", "最后一段。"),
    ]


def test_chapters_told_by_text(spark):
    out = structure.assemble(structure.blocks(rows_of(spark, "before\nChapter 1 A\none\n1.2 Part\nChapter 2 B\ntwo"))).orderBy("num", "seq").collect()
    assert [(r["num"], r["kind"], r["text"]) for r in out] == [(1, "p", "before"), (1, "p", "one"), (1, "heading", "1.2 Part"), (2, "p", "two")]


def test_pipeline_chapter_title_is_its_first_paragraph(spark):
    out = structure.pipeline_chapters(rows_of(spark, "before\n第一章 甲\none\n第二章 乙\ntwo", "b")).orderBy("chapter", "nth").collect()
    assert [(r["chapter"], r["text"]) for r in out] == [(1, "第一章 甲"), (1, "before"), (1, "one"), (2, "第二章 乙"), (2, "two")]


def test_reflow_joins_lines(spark):
    lines = ["这是第一", "行文字在这里结束。", "3", "短。", "still", "going on here.", "", "tail"]
    rows = spark.createDataFrame([("b", i, t) for i, t in enumerate(lines)], "book string, pos int, text string")
    assert [r["text"] for r in structure.reflow(rows).orderBy("paragraph").collect()] == ["这是第一行文字在这里结束。", "短。stillgoing on here.", "tail"]


def test_margins_count_occurrences(spark):
    rows = [("b", p, t) for p in range(4) for t in ("My  Book", f"text {p}")] + [("c", 0, "x"), ("c", 0, "x"), ("c", 0, "x")]
    got = structure.margin_lines(spark.createDataFrame(rows, "book string, page int, text string")).collect()
    assert [(r["book"], r["line"]) for r in got] == [("b", "MyBook")]


def test_packing_loses_no_text(spark):
    r = random.Random(2)
    paragraphs = [("b", c, i, f"a{i}", "".join(r.choice("abc ") for _ in range(r.choice((0, 30, 300, 1700)))).strip()) for c in range(3) for i in range(12)]
    rows = spark.createDataFrame(paragraphs, "book string, chapter int, pos int, anchor string, text string")
    whole = {c: "".join(p[4] for p in paragraphs if p[1] == c) for c in range(3)}
    for made, order, most in ((chunking.chunks(rows, ["book", "chapter"]), "chunk", 1000), (chunking.parts(rows, ["book", "chapter"], limit=1000), "part", None)):
        for c in range(3):
            mine = sorted((p for p in made.collect() if p["chapter"] == c), key=lambda p: p[order])
            assert "".join(p["text"] for p in mine).replace("\n", "").replace(" ", "") == whole[c].replace(" ", "")
            assert all(len(p["anchors"]) == len(set(p["anchors"])) for p in mine) and (not most or all(len(p["text"]) <= most for p in mine))
    assert all(len(p["anchors"]) <= 8 for p in chunking.summary_chunks(rows, ["book", "chapter"]).collect())


def test_page_packs(spark):
    boxes = spark.createDataFrame([("b", i, i * 250.0, i * 250.0 + 240.0) for i in range(6)], "book string, ord int, top double, bottom double")
    assert [r["pack"] for r in chunking.page_packs(boxes, ["book"]).orderBy("ord").collect()] == [0, 0, 1, 1, 2, 2]


def docx(paragraphs, table):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}<w:tbl>{rows}</w:tbl></w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([("H1", "Title"), ("Normal", "Body text")], [["x", "y"], ["1", "2 3"]]))
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "b.md").write_bytes("﻿# 标题\n正文".encode())
    (tmp_path / "c.txt").write_bytes("第一章 国标".encode("gb18030"))
    found = files.files(spark, str(tmp_path))
    assert {(r["format"], r["status"]) for r in found.collect()} == {("docx", "ok"), ("text", "ok")}
    states = spark.createDataFrame([(0, "text"), (5, None), (5, "doc"), (300 << 20, "pdf")], "size long, fmt string").select(files.upload_status(F.col("size"), F.col("fmt")).alias("s"))
    assert [r["s"] for r in states.collect()] == ["empty", "unknown format", "unavailable", "too large"]
    rows = [(r["book"].rpartition("/")[2], r["kind"], r["text"], r["level"]) for r in files.docx_rows(found).orderBy("book", "pos").collect()]
    assert rows[:3] == [("a.docx", "p", "Title", 1), ("a.docx", "p", "Body text", 0), ("a.docx", "table", "x | y\n1 | 2 3", 0)] and rows[3][:2] == ("broken.docx", "error")
    texts = {(r["book"].rpartition("/")[2], r["level"], r["text"]) for r in files.text_books(found).collect()}
    assert {("b.md", 1, "标题"), ("b.md", 0, "正文"), ("c.txt", 0, "第一章 国标")} <= texts


DOCX = """<w:document xmlns:w="{w}" xmlns:a="{a}" xmlns:r="{r}"><w:body>
<w:p><w:pPr><w:pStyle w:val="T"/></w:pPr><w:r><w:t>The Book</w:t></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>One</w:t></w:r></w:p>
<w:p><w:r><w:rPr><w:sz w:val="22"/></w:rPr><w:t>plain </w:t></w:r><w:r><w:rPr><w:b/><w:sz w:val="22"/></w:rPr><w:t>bo</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>ld</w:t></w:r><w:r><w:rPr><w:vertAlign w:val="superscript"/><w:sz w:val="16"/></w:rPr><w:t>2</w:t></w:r><w:r><w:rPr><w:b w:val="0"/><w:sz w:val="40"/></w:rPr><w:t>big</w:t></w:r></w:p>
<w:p><w:r><w:t>before </w:t></w:r><w:hyperlink><w:r><w:rPr><w:b/></w:rPr><w:t>a link</w:t></w:r></w:hyperlink></w:p>
<w:p><w:r><w:drawing><a:blip r:embed="rId7"/></w:drawing></w:r><w:r><w:drawing><a:blip r:embed="gone"/></w:drawing></w:r><w:r><w:t>caption</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc/></w:tr></w:tbl><w:tbl><w:tr><w:tc/></w:tr></w:tbl>
<w:p><w:r><w:txbxContent><w:p/></w:txbxContent></w:r></w:p>
</w:body></w:document>"""


def test_docx_images_styles_titles_and_what_is_skipped(spark, tmp_path):
    names = {"w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "a": "http://schemas.openxmlformats.org/drawingml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", DOCX.format(**names))
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{names["w"]}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="T"><w:name w:val="Title"/></w:style></w:styles>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId7" Target="media/image1.PNG"/><Relationship Id="rId8" Target="media/none.png"/></Relationships>')
        z.writestr("word/media/image1.PNG", b"\x89PNG")
    found = files.files(spark, str(tmp_path))
    rows = files.docx_rows(found)
    titles, body = files.docx_titles(rows)
    assert [r["title"] for r in titles.collect()] == ["The Book"]
    got = [(r["kind"], r["text"], r["level"], r["asset"], bytes(r["content"]) if r["content"] else None, r["cells"]) for r in body.orderBy("pos").collect()]
    assert got == [
        ("p", "One", 1, None, None, None),
        ("p", "plain bold2big", 0, None, None, None),
        ("p", "before a link", 0, None, None, None),
        ("image", "", 0, "img0.png", b"\x89PNG", None),
        ("p", "caption", 0, None, None, None),
        ("table", "x\n", 0, None, None, [["x"]]),
    ]
    styled = [[(x["text"], x["style"]) for x in r["runs"]] for r in files.docx_content(body).orderBy("pos").collect()]
    assert styled == [[], [("plain ", []), ("bold", ["b"]), ("2", ["sup"]), ("big", ["lg"])], [], []] or styled == [[], [("plain ", []), ("bold", ["b"]), ("2", ["sup"]), ("big", ["lg"])], []]
    notes = files.docx_notes(found).first()
    assert (notes["boxes"], notes["drawings"], notes["notes"]) == (1, 2, ["1 个文本框", "2 张图片"])


def test_title_and_images_of_a_book(spark):
    rows = spark.createDataFrame([("b", 0, "Whole", 1), ("b", 1, "Chapter 1", 2), ("b", 2, "x", 0), ("b", 3, "Chapter 2", 2), ("c", 0, "Only", 1), ("c", 1, "y", 0)], "book string, pos int, text string, level int")
    assert {r["book"]: r["title"] for r in structure.titled(rows).collect()} == {"b": "Whole", "c": ""}
    found = spark.createDataFrame([("b", 0, 1, "t", "p", "a"), ("b", 1, 1, "t", "image", ""), ("b", 2, 1, "t", "p", " ")], "book string, pos int, chapter int, title string, kind string, text string")
    assert [(r["kind"], r["text"]) for r in structure.assemble(found).orderBy("seq").collect()] == [("p", "a"), ("image", "（插图）")]


def page_lines(spark):
    """Two books of four pages: 'm' has an outline, 'h' large lines; both have a line that recurs at the top of each page."""
    rows = []
    for book in ("m", "h"):
        for page in range(4):
            rows.append((book, page, 10.0, 0, 10.0, 800.0, "Running head"))
            if page % 2 == 0:
                rows.append((book, page, 100.0, 1, 20.0 if book == "h" else 10.0, 800.0, f"Part {page}"))
            rows += [(book, page, 200.0, 2, 10.0, 800.0, f"A sentence that goes on, page {page},"), (book, page, 220.0, 3, 10.0, 800.0, "and ends here."), (book, page, 400.0, 4, 10.0, 800.0, f"Another one {page}.")]
    return spark.createDataFrame(rows, "book string, page int, y double, ord int, size double, height double, text string")


def test_page_book_by_outline_by_size_and_as_a_whole(spark):
    marks = spark.createDataFrame([("m", 1, 1, "First", 1), ("m", 2, 1, "Second", 3), ("m", 3, 1, "Second", 3), ("m", 4, 2, "deeper", 3), ("m", 5, 1, "Third", 99)], "book string, ord int, level int, title string, page int")
    assets = spark.createDataFrame([("m", 0, 300.0, "image", "", 9000.0), ("m", 0, 310.0, "image", "", 9.0), ("m", 2, 300.0, "table", "a | b", 0.0)], "book string, page int, y double, kind string, text string, area double")
    out = pages.page_book(page_lines(spark), marks, assets).orderBy("book", "num", "seq").collect()
    m = [r for r in out if r["book"] == "m"]
    assert [(r["num"], r["title"], r["page_start"], r["page_end"]) for r in m if r["seq"] == 1] == [(1, "First", 1, 2), (2, "Second", 3, 3), (3, "Third", 4, 4)]
    first = [(r["page"], r["kind"], r["text"]) for r in m if r["num"] == 1]
    assert first == [(1, "p", "Running headPart 0A sentence that goes on, page 0,and ends here."), (1, "image", "（插图）"), (1, "p", "Another one 0."), (2, "p", "Running headA sentence that goes on, page 1,and ends here."), (2, "p", "Another one 1.")]
    assert [r["text"] for r in m if r["kind"] == "table"] == ["a | b"]
    h = [(r["num"], r["title"], r["page_start"], r["page_end"]) for r in out if r["book"] == "h" and r["seq"] == 1]
    assert h == [(1, "Part 0", 1, 2), (2, "Part 2", 3, 4)]
    plain = page_lines(spark).where("book = 'm'")
    whole = pages.page_book(plain, marks.where("false"), assets.where("false"), "Untitled").collect()
    assert {(r["num"], r["title"], r["page_start"], r["page_end"]) for r in whole} == {(1, "Untitled", 1, 4)}
    assert not any("Running head" in r["text"] for r in whole)


def test_runs_lose_what_their_text_loses(spark):
    runs = spark.createDataFrame([([("One", ["b"]), (" tw", []), ("o", ["i"])],)], "r array<struct<text:string,style:array<string>>>")
    for n, want in ((0, [("One", ["b"]), (" tw", []), ("o", ["i"])]), (4, [("tw", []), ("o", ["i"])]), (6, [("o", ["i"])]), (9, [])):
        got = runs.select(pages.stripped_runs(F.col("r"), F.lit(n)).alias("r")).first()["r"]
        assert [(x["text"], x["style"]) for x in got] == want


def test_lesson_order_against_passes_over_the_list(spark):
    r = random.Random(5)
    rows = []
    for chapter in range(25):
        names = [f"n{i}" for i in range(r.randint(1, 12))]
        r.shuffle(names)
        rows += [(chapter, i, n, r.sample([*names, "elsewhere"], r.randint(0, min(2, len(names))))) for i, n in enumerate(names)]
    rows.append((99, 0, "alone", None))
    got = {(x["chapter_id"], x["concept"]): x["position"] for x in concepts.lesson_order(spark.createDataFrame(rows, "chapter_id int, ord int, concept string, prerequisites array<string>")).collect()}
    for chapter in {c for c, *_ in rows}:
        left = [(n, set(p or ())) for c, _, n, p in sorted(rows) if c == chapter]
        names, out = {n for n, _ in left}, []
        while left:
            before = len(out)
            for n, needs in list(left):
                if all(m in out for m in needs & names - {n}):
                    out.append(n)
                    left.remove((n, needs))
            if len(out) == before:
                out += [n for n, _ in left]
                break
        assert [got[chapter, n] for n in out] == list(range(1, len(out) + 1))


def test_medians_are_those_of_sorted_values(spark):
    r = random.Random(3)
    rows = [(g, r.choice((None, *range(6)))) for g in range(6) for _ in range(r.randint(1, 20))]
    got = {x["g"]: x["m"] for x in structure.upper_median(spark.createDataFrame(rows, "g int, v int"), ["g"], "v", "m").collect()}
    for g in {g for g, _ in rows}:
        values = sorted(v for k, v in rows if k == g and v is not None)
        assert got.get(g) == (values[len(values) // 2] if values else None)


def test_split_books_are_written(spark, tmp_path):
    from lectern.sinks import markdown

    rows = spark.createDataFrame([("b", 1, "t", 1, 1, "one"), ("b", 1, "t", 1, 2, "two"), ("b", 2, "u", 1, 1, "three")], "book string, chapter int, title string, part int, nth int, text string")
    markdown.write_split(rows, str(tmp_path))
    read = spark.read.text(f"{tmp_path}/parts", wholetext=True).collect()
    assert sorted((r["chapter"], r["value"].strip()) for r in read) == [(1, "one\ntwo"), (2, "three")]
    assert spark.read.json(f"{tmp_path}/manifest").count() == 1


def test_updates_set_known_fields_only(spark):
    from lectern.operators import requests

    assert requests.only_known(spark.createDataFrame([("1", "done")], "id string, status string")).count() == 1
    with pytest.raises(ValueError, match="colour"):
        requests.only_known(spark.createDataFrame([("1", "done")], "id string, colour string"))


def test_concepts_that_are_kept_stand_before_rules(spark):
    kept = spark.createDataFrame([("c1", "k", "kept", "d", ["a"])], "chapter_id string, id string, concept string, definition string, anchors array<string>")
    rows = spark.createDataFrame([("c1", 1, "a1", "沿负方向更新参数的方法称为梯度下降。"), ("c2", 1, "a2", "沿负方向更新参数的方法称为梯度下降。")], "chapter_id string, seq int, anchor string, text string")
    assert {(r["chapter_id"], r["concept"]) for r in concepts.concepts_of(kept, rows).collect()} == {("c1", "kept"), ("c2", "梯度下降")}


def test_runs_merge_and_keep_all_text(spark):
    runs = spark.createDataFrame([("p", 0, "a", ["b"]), ("p", 1, "", []), ("p", 2, "b", ["b"]), ("p", 3, "c", [])], "p string, ord int, text string, style array<string>")
    got = structure.merged_runs(runs, ["p"]).first()["runs"]
    assert [(r["text"], r["style"]) for r in got] == [("ab", ["b"]), ("c", [])]


def test_ocr_book(spark):
    lines = []
    for page in range(1, 5):
        lines.append((f"{page + 8}", page, 1600.0, 9, 700.0, 1560.0, 720.0, 1590.0))
        lines += [(f"第{page}页的第{k}行正文内容在这里。", page, 1600.0, k, 100.0, 200.0 + 60 * k, 900.0, 230.0 + 60 * k) for k in range(1, 6)]
    lines.append(("第二章 开始", 3, 1600.0, 8, 100.0, 120.0, 500.0, 180.0))
    rows = spark.createDataFrame([("b", *x) for x in lines], "book string, text string, page int, page_h double, ord int, x0 double, y0 double, x1 double, y1 double")
    out = pages.ocr_book(rows).collect()
    assert {r["page"] for r in out} == {9, 10, 11, 12}
    assert [(r["chapter"], r["page"]) for r in out if r["kind"] == "heading"] == [(1, 11)]
    assert sum(r["kind"] == "p" for r in out) == 20


def test_concepts_by_rules(spark):
    rows = spark.createDataFrame([("c", 1, "a1", "沿负方向更新参数的方法称为梯度下降。"), ("c", 2, "a2", "没有标记的段落在这里。"), ("c", 3, "a3", "这样的量称为一个张量，很常见。"), ("c", 4, "a4", "它也被称为梯度下降。")], "chapter_id string, seq int, anchor string, text string")
    out = concepts.rule_concepts(rows).orderBy("ord").collect()
    assert [(r["id"], r["concept"], r["anchors"]) for r in out] == [("c-kp001", "梯度下降", ["a1"]), ("c-kp002", "张量", ["a3"])]
    assert out[0]["definition"] == "沿负方向更新参数的方法称为梯度下降。"


def test_concepts_of_a_reply(spark):
    reply = 'Sure: ```json\n[{"concept": "《张量》", "definition": "d", "prerequisites": ["向量"], "example": "", "anchors": ["a1", "zz"]}, {"concept": "张量"}, {"concept": "首先"}]\n```'
    known = spark.createDataFrame([("c", ["a1", "a2"])], "chapter_id string, anchors array<string>")
    out = concepts.normalized_concepts(spark.createDataFrame([("c", reply), ("d", "no json")], "chapter_id string, reply string"), known).collect()
    assert [(r["concept"], r["prerequisites"], r["anchors"]) for r in out] == [("张量", ["向量"], ["a1"])]


def graph(spark):
    schema = "chapter_id string, chapter_ord int, ord int, concept string, definition string, example string, prerequisites array<string>, anchors array<string>, method string, status string, mastery double"
    return spark.createDataFrame(
        [
            ("c1", 1, 1, "Vector", "", "", [], ["a1"], "rule", "planned", 0.0),
            ("c1", 1, 2, "Tensor", "d2", "", ["vector", "Space", "tensor"], ["a2"], "rule", "learned", 90.0),
            ("c1", 1, 3, "Graph", "d3", "", ["VECTOR"], ["a3"], "rule", "planned", 0.0),
            ("c2", 2, 1, "vector", "d1", "", ["Field"], ["a4", "a1"], "llm", "learning", 40.0),
        ],
        schema,
    )


def test_graph(spark):
    rows = graph(spark)
    nodes = concepts.graph_nodes(rows)
    v = nodes.where("key = 'vector'").first()
    assert (v["concept"], v["definition"], v["chapters"], v["anchors"], v["status"], v["mastery"], v["method"]) == ("Vector", "d1", ["c1", "c2"], ["a1", "a4"], "learning", 40.0, "llm")
    edges = concepts.prerequisite_edges(nodes)
    assert {(r["source"], r["target"]) for r in edges.collect()} == {("tensor", "vector"), ("graph", "vector")}
    sequence = concepts.sequence_edges(rows, nodes, edges)
    assert {(r["source"], r["target"]) for r in sequence.collect()} == {("tensor", "graph")}
    missing = concepts.unresolved(nodes)
    assert {r["name"]: r["required_by"] for r in missing.collect()} == {"Space": ["Tensor"], "Field": ["Vector"]}
    assert concepts.graph_stats(nodes, edges, sequence, missing).first().asDict() == {"concepts": 3, "learned": 2, "prerequisites": 2, "sequences": 1, "unresolved": 2}


def test_lesson_order_and_cycles(spark):
    rows = spark.createDataFrame([("c", 1, "B", ["A"]), ("c", 2, "A", []), ("d", 1, "X", ["Y"]), ("d", 2, "Y", ["X"]), ("d", 3, "Z", None)], "chapter_id string, ord int, concept string, prerequisites array<string>")
    out = concepts.lesson_order(rows).orderBy("chapter_id", "position").collect()
    assert [r["concept"] for r in out] == ["A", "B", "Z", "X", "Y"]


def test_questions_are_stable_and_answerable(spark):
    rows = spark.createDataFrame([("c", i, n, f"{n}就是这样的一种东西而已。", [f"a{i}"]) for i, n in enumerate(("线性回归", "张量", "自动微分", "损失函数", "优化器"))], "chapter_id string, ord int, concept string, definition string, anchors array<string>")
    one, two = (sorted(concepts.questions(rows).collect(), key=lambda q: q["id"]) for _ in range(2))
    assert one == two and len(one) == 5
    for q in one:
        assert len(set(q["options"])) == 4 and q["options"][q["answer_index"]] == q["concept"] and "____" in q["prompt"]
    few = rows.where("ord < 3")
    assert concepts.questions(few).count() == 0
    assert set(concepts.served(concepts.questions(rows)).columns) == {"chapter_id", "id", "prompt", "options", "anchor"}


def test_model_failures_leave_null(spark):
    def client():
        def ask(prompts):
            if "bad" in prompts:
                raise RuntimeError
            return [p.upper() for p in prompts]

        return ask

    rows = spark.createDataFrame([("a",), ("bad",)], "p string").repartition(1)
    assert {r["p"]: r["reply"] for r in concepts.with_model(rows, "p", client, batch=1).collect()} == {"a": "A", "bad": None}


def test_selection_match(spark):
    paragraphs = spark.createDataFrame([("p1", "b", 3, "机器学习是一门学科。"), ("p2", "b", 4, "深度学习用神经网络。"), ("p3", "b", 9, "机器学习是一门学科。")], "anchor string, book string, page int, text string")
    asked = spark.createDataFrame([(1, "b", 3, "学习是一门"), (2, "b", 3, "深度学习用神"), (3, "b", 3, "完全无关的内容"), (4, "b", 3, "学")], "selection_id int, book string, page int, needle string")
    assert {r["selection_id"]: (r["anchor"], r["ratio"]) for r in anchors.matched(asked, paragraphs).collect()} == {1: ("p1", 1.0), 2: ("p2", 1.0)}


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_longest_common_run(a, b):
    assert anchors.longest_common_run(a, b) == max(j - i for i in range(len(a) + 1) for j in range(i, len(a) + 1) if a[i:j] in b)


def test_reanchor(spark):
    old = spark.createDataFrame([("s1", "第一段的文字内容"), ("s2", "无处可寻的段落")], "id string, text string")
    new = spark.createDataFrame([("n1", "c", "前面加了 第一段的文字内容 后面", 1), ("s9", "c", "别的", 2)], "id string, chapter_id string, text string, ord int")
    records = spark.createDataFrame([(1, "c", "s1", None), (2, "c", "s2", None), (3, "c", "s9", None), (4, "c", "", None)], "id int, chapter_id string, anchor_id string, quoted string")
    assert {r["id"]: (r["state"], r["new_anchor_id"]) for r in lifecycle.reanchored(records, old, new).collect()} == {1: ("moved", "n1"), 2: ("unanchored", ""), 3: ("kept", "s9"), 4: ("none", "")}


def test_notes_and_tasks(spark):
    marks = spark.createDataFrame([("c", "a1")], "chapter_id string, id string")
    notes = spark.createDataFrame([(1, "c", "a1"), (2, "c", "a9"), (3, "c", "")], "id int, chapter_id string, anchor_id string")
    accepted, rejected = lifecycle.owned_notes(notes, marks)
    assert ({r["id"] for r in accepted.collect()}, {r["id"] for r in rejected.collect()}) == ({1, 3}, {2})
    tasks = spark.createDataFrame([("running", 1, 3, None), ("done", 3, 3, None)], "status string, done int, total int, error string")
    assert {(r["status"], r["percent"]) for r in lifecycle.task_view(lifecycle.failed_stale(tasks)).collect()} == {("failed", 33), ("done", 100)}


def test_snapshot_is_published_whole(spark, tmp_path):
    from lectern.sinks.markdown import publish

    path = publish({"books": spark.range(3).withColumnRenamed("id", "book")}, str(tmp_path), "s1")
    assert spark.read.parquet(f"{path}/books").count() == 3
    with pytest.raises(Exception, match="already exists"):
        publish({"books": spark.range(3)}, str(tmp_path), "s1")


def test_markdown(spark):
    from lectern.sinks import markdown as sink

    chapters, sections, _ = lifecycle.bundle(structure.assemble(structure.blocks(rows_of(spark, BOOK))))
    books = spark.createDataFrame([("b", "", "note", "")], "id string, title string, note string, content_warning string")
    got = sink.markdown(books, chapters, sections).first()["markdown"]
    assert got.startswith("# 未命名教材\n\n> note\n\n## 第一章 基础\n\n<!-- page: 1 -->\n前言一段。\n\n<!-- page: 1 -->\n### 1.1 小节\n\n")
    assert "<!-- page: 1 -->\n```\ny = f(x)\n```\n" in got and got.endswith("最后一段。\n")
    assert chapters.where("num = 1").first()["full_text"] == "前言一段。\n梯度是指函数变化最快的方向。\n# 不是标题"


def test_mastery_hand_values(spark):
    from lectern.operators import learning

    events = [("c1", "read", f"a{i}", "", None) for i in range(4)] + [("c2", "read", f"a{i}", "", None) for i in range(4)] + [("c2", "ask", "", "q1", None), ("c2", "ask", "", "q2", None), ("c2", "ask", "", " q2 ", None), ("c3", "open", "", "", None), ("c4", "complete", "", "", None)]
    rows = spark.createDataFrame([("b", *e) for e in events], "book string, chapter string, kind string, anchor_id string, detail string, value double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    got = {r["chapter"]: (r["mastery"], r["status"]) for r in learning.mastery(learning.progress_parts(rows, ["book", "chapter"]), F.lit(4)).collect()}
    assert got == {"c1": (67.0, "learning"), "c2": (80.0, "learned"), "c3": (0.0, "learning"), "c4": (0.0, "learned")}
