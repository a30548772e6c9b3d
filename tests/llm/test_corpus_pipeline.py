import re

import corpus_pipeline
from tests.llm.helpers import EDGES, table
from tests.llm.test_dedup import brute_components


def test_stages_each_on_what_the_one_before_kept(spark, tmp_path):
    near = " ".join(f"w{i}" for i in range(80))
    rows = [*EDGES, (20, near, "en", "a"), (21, near + " more", "en", "b"), (22, near + "  more", "en", "b"), *[(100 + i, " ".join(f"x{i}y{k}" for k in range(12)), "de", "abc"[i % 3]) for i in range(40)]]
    docs, kept = table(spark, rows), {}
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
        if k < 4:
            assert docs.columns == names
    text = lambda rs: [(r["doc_id"], r["text"]) for r in rs]
    first = [(d, t) for d, t, *_ in rows if t and any(c.isalpha() for c in t)]
    assert sorted(map(str, text(kept["language ID"]))) == sorted(map(str, first))
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t)
    best = {}
    for d, t in sorted(first, key=lambda r: (r[0] is None, r[0])):
        best.setdefault(norm(t), (d, t))
    assert sorted(map(str, text(kept["exact dedup"]))) == sorted(map(str, best.values()))
    stays = {d for d, _, c in brute_components(text(kept["exact dedup"])) if d == c}
    assert sorted(str(d) for d, _ in text(kept["MinHash near-dedup"])) == sorted(stays)
    assert "20" in stays and "21" not in stays
    mixed = text(kept["source mix"])
    assert {d for d, _ in mixed} <= {d for d, _ in text(kept["MinHash near-dedup"])} and max(map(mixed.count, mixed)) <= 3
    pieces = kept["packing"]
    assert {p["doc_id"] for p in pieces} == {d for d, _ in mixed}
    for d, t in set(mixed):
        mine = [p for p in pieces if p["doc_id"] == d]
        assert sum(p["length"] for p in mine) == mixed.count((d, t)) * mine[0]["doc_tokens"]


def test_run_and_empty_input(spark, sf_dir, tmp_path):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0
    docs = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
