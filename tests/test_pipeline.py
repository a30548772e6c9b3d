import zipfile

from pyspark.sql import functions as F

from lectern.operators import index, requests, tools
from lectern.plans import pipeline


def test_build_and_ask(spark, tmp_path):
    (tmp_path / "book.md").write_text("# 第一章 回归\n线性回归是指用直线拟合数据的方法。\n损失函数称为目标。\n# 第二章 网络\n神经网络由许多层组成。\n", encoding="utf-8")
    made = pipeline.build(spark, str(tmp_path))
    assert made["paragraphs"].count() == 5 and made["lessons"].count() == made["concepts"].count() == 2
    assert made["statistics"].agg(F.sum("cjk")).first()[0] > 30
    queries = spark.createDataFrame([(1, "神经网络的层")], "query_id int, query string")
    got = pipeline.ask(made["chunks"], queries, 1).first()
    assert got["found"] and got["anchors"][0].endswith("ch2-p001")


def test_all_formats_are_books(spark, tmp_path):
    from lectern.sources import files

    (tmp_path / "book.md").write_text("# Whole\n## Chapter 1\none\n## Chapter 2\ntwo\n", encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>Deep</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>')
    titles, rows = files.books(files.files(spark, str(tmp_path)))
    assert sorted(r["title"] for r in titles.collect()) == ["Deep", "Whole"]
    assert {"body", "one", "two"} <= {r["text"] for r in rows.collect()}


def test_model_is_asked_once_more_with_less(spark):
    from lectern.operators import concepts

    def make():  # noqa: ANN202
        return lambda prompts: [None if len(p) > 5 else p.upper() for p in prompts]

    rows = spark.createDataFrame([(1, "short", "s"), (2, "too long", "half")], "id int, prompt string, less string")
    assert {r["id"]: r["reply"] for r in concepts.with_retry(rows, "prompt", "less", make).collect()} == {1: "SHORT", 2: "HALF"}


def test_scores_read_the_corpus_once(spark, tmp_path):
    spark.createDataFrame([(i, f"red fish {i} blue " * (1 + i % 3)) for i in range(50)], "doc_id int, text string").write.parquet(f"{tmp_path}/docs")
    reads = []
    docs = spark.read.parquet(f"{tmp_path}/docs")
    asked = spark.createDataFrame([(1, "red 7"), (2, "blue")], "query_id int, query string")
    plan = index.scores(docs, asked, "doc_id")
    reads.append(plan._jdf.queryExecution().executedPlan().toString().count("FileScan parquet"))
    assert reads == [0] and plan.count() == 100  # all that is left to read is in the shared folder


def test_nearest_vectors_by_blocks(spark, monkeypatch):
    import numpy as np

    from lectern.operators import search

    monkeypatch.setattr(search, "VECTORS", 7)
    monkeypatch.setattr(search, "ASKED", 3)
    rng = np.random.default_rng(1)
    held, posed = rng.normal(size=(40, 5)), rng.normal(size=(11, 5))
    held[3] = 0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(held)], "id int, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(posed)], "query_id int, vector array<double>")
    got = {}
    for r in search.vector_hits(vectors, queries, 4, "id").orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    norms = np.linalg.norm(held, axis=1)
    cosines = np.where(norms > 0, (posed @ held.T) / np.where(norms > 0, norms, 1) / np.linalg.norm(posed, axis=1)[:, None], 0)
    assert got == {q: np.lexsort((np.arange(40), -cosines[q]))[:4].tolist() for q in range(11)}


def test_requests(spark):
    rows = spark.createDataFrame([("b", "why?", ""), ("b", "  ", ""), ("", "why?", "")], "book_id string, question string, selection string")
    accepted, rejected = requests.checked(rows, "ask")
    assert accepted.count() == 1 and sorted(r["field"] for r in rejected.collect()) == ["book_id", "question"]


def test_tools(spark):
    texts = spark.createDataFrame([(1, "一段中文内容在此", None), (2, "English text", "译文")], "request_id int, text string, reply string")
    events = tools.translation_events(tools.translation_requests(texts)).orderBy("request_id", "seq").collect()
    joined = {i: "".join(e["payload"] for e in events if e["request_id"] == i and e["event"] == "delta") for i in (1, 2)}
    assert joined == {1: tools.NO_TRANSLATION + "\n一段中文内容在此", 2: "译文"}
    rows = spark.createDataFrame([("c", i, f"a{i}", f"第{i}段。其余。") for i in range(1, 30)], "chapter string, seq int, anchor string, text string")
    chunks = tools.summary_prompts(rows, ["chapter"], "seq", "anchor").orderBy("chunk").collect()
    assert [len(c["anchors"]) for c in chunks] == [8, 8, 8, 5] and "[9] 第9段" in chunks[1]["text"]
    assert tools.summaries(rows, ["chapter"], "seq").first()["summary"].count("\n- ") == 6


def test_demo_book_to_lessons(spark, tmp_path):
    from lectern.operators import concepts
    from lectern.sinks import markdown as sink
    from lectern.sources.demo import demo_book, seeded

    books, chapters, sections, anchors = demo_book(spark)
    assert chapters.count() == 2 and sections.where("kind = 'heading'").count() == 4
    assert seeded(books.where("false"), books).count() == 1
    rows = concepts.concept_paragraphs(anchors, sections).join(sections.select("id", "seq"), "id").select("chapter_id", "seq", F.col("id").alias("anchor"), "text")
    found = concepts.rule_concepts(rows).withColumn("prerequisites", F.array().cast("array<string>"))
    assert found.count() >= 2
    known = anchors.groupBy("chapter_id").agg(F.collect_set("id").alias("anchors"))
    made = concepts.lessons(found, chapters.select(F.col("id").alias("chapter_id"), "title"), known)
    assert concepts.lesson_errors(made, anchors.select("chapter_id", F.col("id").alias("anchor"))).count() == 0
    sink.write_lessons(made, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/index").count() == made.count()
    assert sink.capabilities(spark, ocr=False, llm=True).count() == 2
