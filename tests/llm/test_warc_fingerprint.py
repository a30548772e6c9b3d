import gzip
import hashlib
import io
import math
import random

import pytest

from lectern.llm import fingerprint, warc
from tests.llm.helpers import EDGES, LONG, table


def test_fingerprint_sums():
    parts = fingerprint.paragraphs("one\ntwo\nthree four\none")
    other = fingerprint.paragraphs("two\none\none\nthree four")
    a, b = (fingerprint.add(fingerprint.zero(), p) for p in (parts, other))
    assert fingerprint.written(a) == fingerprint.written(b) and fingerprint.likeness(a, b) == 1.0
    more = fingerprint.add(a, fingerprint.paragraphs("five\nfive"))
    assert fingerprint.written(more) != fingerprint.written(a)
    assert fingerprint.written(fingerprint.remove(more, fingerprint.paragraphs("five\nfive"))) == fingerprint.written(a)
    assert fingerprint.likeness(fingerprint.zero(), fingerprint.zero()) == 1.0 and fingerprint.likeness(a, fingerprint.zero()) == 0.0


def test_fingerprints_against_brute_force(spark):
    rows = [(i, t) for i, t, *_ in EDGES if i is not None] + [(100 + i, " ".join(f"w{(i * 31 + k * k) % 997}" for k in range(i % 90))) for i in range(600)]
    out = fingerprint.fingerprints(table(spark, rows).repartition(5)).collect()
    ordered = sorted((i, t or "") for i, t in rows)
    want = []
    for n, (i, text) in enumerate(ordered):
        new = fingerprint.edited(text, ordered[(n + 1) % len(ordered)][1])
        assert len(new) == len(text) - len(text) // 2 + min(len(text) // 2, len(ordered[(n + 1) % len(ordered)][1]))
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprint.written(fingerprint.add(fingerprint.zero(), fingerprint.paragraphs(text))), fingerprint.written(fingerprint.add(fingerprint.zero(), fingerprint.paragraphs(new)))))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in out) == sorted(want)
    long = [r for r in out if r["n_chars"] > 300]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert sum(r["near_edited"] > r["near_next"] for r in long) >= 0.98 * len(long)


def cosine(a, b):
    size = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
    return sum(n * b[k] for k, n in a.items()) / size if size else float(a == b)


def test_likeness_against_true_cosines(spark):
    """Within four standard errors of an inner product of LOOSE signs."""
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice(("a common line of words", "another line", f"line {r.randrange(9)}", f"own {i} {k}")) for k in range(r.randrange(1, 60)))) for i in range(200)]
    rows += [(1000, "one and the same line\n" * 100_000), (1001, "one and the same line\n" * 70_000), (1002, "one and the same line\n" * 40_000 + "other\n" * 30_000)]
    out = {r["doc_id"]: r for r in fingerprint.fingerprints(table(spark, rows)).collect()}
    for n, (i, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        parts = fingerprint.paragraphs(text)
        assert abs(out[i]["near_next"] - cosine(parts, fingerprint.paragraphs(following))) < 4 / math.sqrt(fingerprint.LOOSE)
        assert abs(out[i]["near_edited"] - cosine(parts, fingerprint.paragraphs(fingerprint.edited(text, following)))) < 4 / math.sqrt(fingerprint.LOOSE)
    assert out[1000]["near_next"] > 0.999


def test_fingerprint_edges(spark):
    assert fingerprint.fingerprints(table(spark, [])).count() == 0
    one = fingerprint.fingerprints(table(spark, [(5, "abcd")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert fingerprint.fingerprints(table(spark, EDGES)).count() == len(EDGES)
    assert fingerprint.fingerprints(table(spark, [(None, "ab"), (None, "cd")])).count() == 2


PAGES = "page_id long, url string, html string, digest string, bytes long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", -5) for r in rows], PAGES)


def test_warc_round_trip(spark):
    big, other = "<p>é" + "x" * 2000, LONG
    rows = [(1, "http://a/ b", big), (2, "http://b", big), (9, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", other), (7, "u", other), (7, "u", other), (None, "u", big)]
    out = warc.round_trip(pages(spark, rows)).collect()
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None]
        later = max(same) if len(data) >= 1000 and i is not None and max(same) != i else None
        want.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if later is not None else "response", later))
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2], r[3], str(r[4])))
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_reader_verifies_and_frames():
    stream = warc.record(1, "u", b"payload") + warc.record(2, "u", b"y" * 700_000) + warc.record(3, "u", b"payload", refers_to=1)
    got = list(warc.read_records(io.BytesIO(stream)))
    assert [r["page_id"] for r in got] == [1, 2, 3] and got[2]["refers_to"] == 1 and got[2]["payload_bytes"] == 7
    plain = gzip.decompress(warc.record(1, "u", b"payload"))
    for bad in (plain.replace(b"payload\r", b"paylOad\r"), plain[:-4], plain + b"more", b"nothing at all"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(stream[:-20])))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(gzip.compress(b"WARC/1.1\r\nno end " * 10**6))))
