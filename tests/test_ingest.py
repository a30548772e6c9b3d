import pytest
from pyspark.errors import StreamingQueryException

from lectern.sources import files
from lectern.streaming import ingest


def test_a_run_that_is_killed_gives_each_book_once(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for i in range(4):
        (folder / f"b{i}.txt").write_text(f"# Book {i}\nfirst line {i}\n")
    (folder / "broken.docx").write_bytes(b"no archive")
    (folder / "old.doc").write_bytes(b"x")

    def dies(spark, store, number):
        if number == 1:
            raise RuntimeError("killed before publishing")
        ingest.publish(spark, store, number)

    with pytest.raises(StreamingQueryException):
        ingest.ingest(spark, str(folder), store, per_batch=2, published=dies)
    half = {r["book"] for r in ingest.current(spark, store, "tasks").collect()}
    assert len(half) == 2  # what the dead batch wrote isn't seen
    ingest.ingest(spark, str(folder), store, per_batch=2)
    tasks = {r["book"].rsplit("/", 1)[1]: (r["status"], r["rows"]) for r in ingest.current(spark, store, "tasks").collect()}
    assert tasks == {**{f"b{i}.txt": ("ok", 3) for i in range(4)}, "broken.docx": ("unreadable", 0), "old.doc": ("unavailable", 0)}
    rows = [(r["book"].rsplit("/", 1)[1], r["text"], r["level"]) for r in ingest.current(spark, store, "rows").collect()]
    assert sorted(rows) == sorted(x for i in range(4) for x in ((f"b{i}.txt", f"Book {i}", 1), (f"b{i}.txt", f"first line {i}", 0), (f"b{i}.txt", "", 0)))
    # Nothing new: nothing is taken in. A file of a higher version is the book's next text, a late one of a lower version is not.
    ingest.ingest(spark, str(folder), store)
    assert ingest.current(spark, store, "rows").count() == 12
    (folder / "b0.v3.txt").write_text("other text")
    ingest.ingest(spark, str(folder), store)
    (folder / "b0.v2.txt").write_text("late text")
    (folder / "b9.txt").write_text("one")
    (folder / "b9.v2.txt").write_text("two")
    ingest.ingest(spark, str(folder), store)
    assert [r["text"] for r in ingest.current(spark, store, "rows").where("book LIKE '%b9.txt'").collect()] == ["two"]
    assert [r["text"] for r in ingest.current(spark, store, "rows").where("book LIKE '%b0.txt'").collect()] == ["other text"]


def test_a_task_is_claimed_once(spark, tmp_path):
    store = str(tmp_path / "store")
    assert [ingest.claim(spark, store, "t1", w) for w in ("a", "b", "a")] == [True, False, False]
    assert ingest.claim(spark, store, "t2", "b")
    ingest.release(spark, store, "t1")
    assert ingest.claim(spark, store, "t1", "b") and (tmp_path / "store" / "claims" / "t1").read_text() == "b"
    for name in ("", "..", "a/b", "../x"):
        with pytest.raises(ValueError, match="name"):
            ingest.claim(spark, store, name, "a")


def test_text_files_are_read_in_splits(spark, tmp_path, monkeypatch):
    """Breaks of all kinds, encodings and odd names give the lines that whole files give, also where a file is cut into splits of 1000 bytes; a text over the limit counts if it may."""
    texts = {"a.txt": "one\r\ntwo\rthree\n\n# four\n".encode() * 100, "b [x]{1}%20 é.txt": b"\xef\xbb\xbf# b\nend", "c.txt": "第一章 开始\n中文\r\n完".encode("gb18030") * 20, "d.txt": b"bad \xff\xff\n\xe4\xb8\n" * 9, "e.md": b"\n", "f.txt": b"x\r", "g.txt": b"\xef\xbb\xbf"}
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for name, body in texts.items():
        (folder / name).write_bytes(body)
    monkeypatch.setattr(files, "MOST_UPLOAD_BYTES", 200)
    told = lambda rows: sorted((r["book"].rsplit("/", 1)[1], r["pos"], r["text"], r["level"]) for r in rows.collect())
    whole = spark.createDataFrame([(f"/{name}", "text", "ok", body) for name, body in texts.items()], "path string, format string, status string, content binary")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        ingest.ingest(spark, str(folder), store, long_texts=True)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert told(ingest.current(spark, store, "rows")) == told(files.text_books(whole))
    tasks = ingest.current(spark, store, "tasks").collect()
    assert {r["status"] for r in tasks} == {"ok"} and len({r["digest"] for r in tasks}) == len(texts)
    other = str(tmp_path / "other")
    ingest.ingest(spark, str(folder), other)
    assert {r["book"].rsplit("/", 1)[1] for r in ingest.current(spark, other, "tasks").where("status = 'too large'").collect()} == {"a.txt", "c.txt"}
