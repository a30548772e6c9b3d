import hashlib
import random
import re

from lectern.llm import exact_dedup, near_dedup
from lectern.llm.common import slices
from lectern.llm.graph import connected
from tests.llm.helpers import EDGES, table


def test_exact_classes_against_brute_force(spark):
    out = exact_dedup.classes(table(spark, EDGES)).collect()
    assert len(out) == len(EDGES)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for r in EDGES:
        groups.setdefault(norm(r[1]), []).append(r[0])
    for r in out:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[text] if i is not None]
        assert r["keep_id"] == (min(ids) if ids else None)
        assert r["group_size"] == len(groups[text])
    assert sum(r["kept"] for r in out) == len(groups)


def test_exact_dedupe_keeps_columns_and_one_row_of_each_text(spark):
    docs = table(spark, EDGES)
    out = exact_dedup.dedupe(docs)
    assert out.schema.names == docs.schema.names
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "7", "8", "9", "None"]


def test_exact_hot_group_is_found_by_the_sketch(spark):
    rows = [(i, "boiler plate" if i % 3 == 0 else f"text {i}") for i in range(600)]
    out = exact_dedup.classes(table(spark, rows)).collect()
    assert {r["group_size"] for r in out} == {1, 200}
    assert sum(r["kept"] for r in out) == 401


def test_empty_tables(spark):
    empty = table(spark, [])
    assert exact_dedup.classes(empty).count() == exact_dedup.dedupe(empty).count() == near_dedup.components(empty).count() == near_dedup.dedupe(empty).count() == 0


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        if doc_id is not None:
            smallest[r] = min(smallest.get(r, doc_id), doc_id)
    return sorted((str(d), len(sets[i]), str(smallest.get(find(i))) if d is not None else "None") for i, (d, _) in enumerate(rows))


def check_near(spark, rows):
    out = near_dedup.components(table(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out) == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_near_components_against_brute_force(spark):
    r = random.Random(5)
    rows = [(d, t) for d, t, *_ in EDGES]
    next_id = 100
    for _ in range(12):
        base = [f"w{r.randrange(500)}" for _ in range(r.randrange(6, 120))]
        for _ in range(r.randrange(1, 7)):
            copy = [w if r.random() > 0.03 else f"x{r.randrange(99)}" for w in base]
            rows.append((next_id, (" " if r.random() < 0.5 else "\n").join(w.upper() if r.random() < 0.3 else w for w in copy)))
            next_id += 1
    check_near(spark, rows)


def test_near_large_group_of_copies_that_differ(spark):
    """A group whose members are near some others only, so that leaders alone would not do."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        copy = list(base)
        for k in r.sample(range(60), r.choice((0, 1, 2))):
            copy[k] = f"y{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    check_near(spark, rows)


def test_near_dedupe_keeps_one_of_each(spark):
    docs = table(spark, EDGES)
    out = near_dedup.dedupe(docs)
    assert out.schema.names == docs.schema.names
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "3", "7", "8", "9", "None"]


def test_near_dedupe_tells_texts_of_one_id_apart(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, near), (5, near + " end"), (5, "a text of its own that is like no other one here"), (6, "a text of its own that is like no other one here")]
    out = near_dedup.dedupe(table(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [rows[0], rows[2]]


def test_words_are_the_same_by_slices(monkeypatch):
    text = "  Some words, \t more\nwords " * 50 + "x" * 300 + " end"
    whole = near_dedup.word_hashes(text).tolist()
    for most in (1, 5, 64):
        assert [h for part in slices(text, most) for h in near_dedup.word_hashes(part).tolist()] == whole
        assert "".join(slices(text, most)) == text


def test_estimate_is_corrected_for_chance():
    import numpy as np

    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.concatenate([a[:750], a[:250] + np.uint64(1)])
    x, y = (near_dedup.low_bits(near_dedup.minima(near_dedup._mix(s), 1024)).view(np.uint64) for s in (a, b))
    equal = sum(((int(p) ^ int(q)) >> (4 * k)) & 15 == 0 for p, q in zip(x, y, strict=True) for k in range(16)) / 1024
    assert abs((equal - 1 / 16) / (15 / 16) - 0.6) < 0.07


def test_connected_components_of_a_long_chain(spark):
    edges = spark.range(40).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(100, 101), (102, 101)], "a long, b long"))
    got = {r["node"]: r["component"] for r in connected(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
