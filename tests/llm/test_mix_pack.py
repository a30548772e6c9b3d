import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import langid, mixing, packing
from lectern.llm.queries import vocabulary
from tests.llm.helpers import EDGES, table

VOCABULARY = vocabulary("word_bpe_49k.json")


def waterfill(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix_targets_and_takings(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), None, ("a", "b", "c", "d", None)[i % 5 if i < 100 else 0]) for i in range(400)] + [(1000, "one two", None, "tiny")]
    out = mixing.mix(table(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    goal = waterfill(sizes)
    for s in sizes:
        mine = [r for r in out if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert all(abs(r["target"] - goal[s]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - goal[s]) <= 20
        epochs = int(goal[s] / sizes[s])
        assert all(r["taken"] in (epochs * r["size"], (epochs + 1) * r["size"]) and r["taken"] <= 3 * r["size"] for r in mine)
    again = mixing.mix(table(spark, rows).repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mix_takes_the_keys_up_to_the_budget(spark):
    """Against a plain loop over each source's sorted keys; one source has most rows, repeated rows are taken alike, and qualities differ by thousands."""
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), None, "hot" if i % 3 else r.choice("abc")) for i in range(900)]
    rows += [rows[5]] * 3
    docs = table(spark, rows)
    for quality in (None, F.when(F.col("doc_id") % 2 == 0, 0.001).otherwise(5.0)):
        size, key = mixing._keyed(docs, "text", "doc_id", quality)
        keys = {(x["doc_id"]): (x["k"], x["s"]) for x in docs.select("doc_id", key.alias("k"), size.alias("s")).collect()}
        out = mixing.mix(docs, quality=quality).collect()
        assert len(out) == len(rows)
        for source in {x["source"] for x in out}:
            mine = [x for x in out if x["source"] == source]
            epochs = int(mine[0]["target"] / mine[0]["source_size"])
            budget, used, over = mine[0]["target"] - epochs * mine[0]["source_size"], 0, False
            many, inside = Counter(x["doc_id"] for x in mine), set()
            for doc_id in sorted(many, key=lambda i: keys[i][0]):
                over = over or used + many[doc_id] * keys[doc_id][1] > budget
                if not over:
                    used += many[doc_id] * keys[doc_id][1]
                    inside.add(doc_id)
            gap = budget - used
            fits = sorted((abs(keys[i][1] - gap), keys[i][0], i) for i in many if i not in inside and abs(keys[i][1] - gap) < gap)
            if fits and abs(many[fits[0][2]] * keys[fits[0][2]][1] - gap) < gap:
                inside.add(fits[0][2])
            assert all(x["copies"] == epochs + (epochs < 3 and x["doc_id"] in inside) for x in mine)


def test_mix_shuffles_no_row_by_its_source(spark):
    docs = table(spark, [(i, f"a b {i}", None, "hot" if i % 3 else "b") for i in range(60)])
    for plan in (mixing.mix(docs), mixing.mixed(docs)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_mix_edges(spark):
    docs = table(spark, EDGES)
    out = mixing.mix(docs).collect()
    assert len(out) == len(EDGES)
    assert all(r["size"] == len(re.findall("[^\x20\x09-\x0d]+", t)) for r in out for d, t, *_ in EDGES if d == r["doc_id"] and t)
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in out)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(table(spark, [])).count() == mixing.mixed(table(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(table(spark, [(1, None, None, "a"), (2, "", None, "b")])).collect()] == [0, 0]


def test_pack_is_an_exact_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(d, t) for d, t, *_ in EDGES] + [(50, "a\x1cb İstanbul ΑΣ. don't <|endoftext|> é"), (51, "x " * 9000)]
    pieces = packing.pack(table(spark, rows), VOCABULARY).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    whole = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,) for _, t in rows)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    crc = lambda ids: zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        mine = [p for p in by_doc[doc_id] if p["doc_tokens"] == len(ids)]
        copies = sum(r == (doc_id, text) for r in rows)
        assert sum(p["length"] for p in mine) == copies * len(ids)
        assert all(p["ids_crc32"] == crc(ids[p["start"] : p["start"] + p["length"]]) for p in mine)
    assert sum(p["length"] for p in pieces) == sum(map(len, whole))
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096 and (at & (at - 1)) == 0
    assert packing.pack(table(spark, []), VOCABULARY).count() == 0


def test_ids_are_those_of_the_plain_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    r, tokenizer = random.Random(1), Tokenizer.from_file(VOCABULARY)
    signs = [chr(c) for c in [*range(9, 14), *range(28, 128), 0x85, 0xA0, 0xB5, 0xAA, 0xD7, 0xDF, 0xE9, 0xC9, 0xFF, 0x130, 0x131, 0x3A3, 0x3C3, 0x301, 0x2003, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x200D, 0xFB01, 0x1E9E]] + ["'s", "'LL", "<|endoftext|>", " ", " ", "don't", "Straße"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    want = [np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    encoder = packing.WordIds(VOCABULARY)
    assert [ids for at in range(0, len(texts), 50) for ids in encoder.encode(texts[at : at + 50])] == want
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 100)
    monkeypatch.setattr(packing, "STEP_CHARS", 20)
    assert [ids for at in range(0, 1000, 50) for ids in encoder.encode(texts[at : at + 50])] == want[:1000]


def test_groups_hand_their_rest_on(spark, monkeypatch):
    """Only what a task has left at its end is in sequences of less than CAPACITY."""
    monkeypatch.setattr(packing, "GROUP_TOKENS", 3 * packing.CAPACITY)
    r = random.Random(2)
    rows = [(i, " ".join(["word"] * r.choice((1, 10, 700, 3000, 9000)))) for i in range(60)]
    out = packing.pack(table(spark, rows).coalesce(1), VOCABULARY).collect()
    size, parts = {}, {}
    for p in out:
        size[p["sequence_id"]] = size.get(p["sequence_id"], 0) + p["length"]
        parts.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["doc_tokens"]))
    total = sum(len(t.split()) + 1 for _, t in rows)
    assert sorted(size.values(), reverse=True) == [4096] * (total // 4096) + packing.powers(total % 4096)
    for doc_id, text in rows:
        at = 0
        for start, length, whole in sorted(parts[doc_id]):
            assert start == at and whole == len(text.split()) + 1
            at += length
        assert at == len(text.split()) + 1


def test_a_worker_keeps_no_words_after_a_task(spark):
    """What packing remembers ends with its task, so that stages after it have the memory."""
    docs = table(spark, [(i, " ".join(f"w{i}x{k}" for k in range(2000))) for i in range(40)])
    packing.pack(docs, VOCABULARY).count()

    def held(batches):
        import gc

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(isinstance(o, packing.WordIds) for o in gc.get_objects())], pa.int64())})

    assert {r["n"] for r in docs.select("doc_id").mapInArrow(held, "n long").collect()} == {0}
    assert langid.predict(docs).count() == 40


def test_fill_balances_cost():
    rng = np.random.default_rng(1)
    lengths = rng.integers(10, 3000, 400).tolist()
    total = sum(lengths)
    room = [4096] * (total // 4096) + packing.powers(total % 4096)
    cost = {}
    for _, _, n, at, _ in packing.fill(lengths, room):
        cost[at] = cost.get(at, 0) + n + n * n / packing.QUADRATIC
    full = [cost[i] for i in range(total // 4096)]
    assert max(full) < 1.35 * min(full)
