import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import merkle
from tests.llm.helpers import EDGES, table


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, more=0):
    i, source, lang, n, text = row
    return h(*map(field, (i, source, lang, None if n is None else n + more, text)))


def levels(nodes, k):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + k]) for i in range(0, len(out[-1]), k)])
    return out


def walk(tree, at, k, node):
    """(siblings up to the top, the top that node gives in this place)."""
    siblings = []
    for level in tree[:-1]:
        start = at // k * k
        run = level[start : start + k]
        siblings += run[: at - start] + run[at - start + 1 :]
        node = h(*run[: at - start], node, *run[at - start + 1 :])
        at //= k
    return siblings, node


def plain(rows, k=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]], k)
    top = levels([trees[g][-1][0] for g in order], k)
    out = []
    for at, g in enumerate(order):
        for place, r in enumerate(groups[g]):
            claimed = leaf(r, 1) if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 0 else leaf(r)
            low, node = walk(trees[g], place, k, claimed)
            high, folded = walk(top, at, k, node)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[g][-1][0], root, h(*low, *high), folded, folded == root))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("clash") for c in ("tree", "pos", "n", "digest", "proof", "kids", "root")})


@pytest.mark.parametrize("fanout", [2, 3])
def test_against_plain_trees(spark, fanout):
    r = random.Random(9)
    rows = [(i, r.choice(["a", None, ""]), r.choice(["en"] * 9 + ["de", "é", "", None]), r.choice([None, 5, -7]), r.choice(["text", "ünï", "", None, "x" * 5000])) for i in range(90)]
    rows += [(200, "a", "one", 1, "the only one of its kind"), (None, None, None, None, None), (None, "a", "en", 3, "no id")]
    assert found(merkle.manifest(documents(spark, rows).repartition(4), fanout=fanout)) == plain(rows, fanout)


def test_copies_of_a_row_share_no_place(spark):
    """A third of all rows are one row again and again."""
    rows = [(5, "a", "en", 1, "same")] * 40 + [(i, "a", "en", 1, "other") for i in range(80)]
    assert found(merkle.manifest(documents(spark, rows).repartition(5))) == plain(rows)


def test_edges(spark):
    rows = [(r[0], r[3] if len(r) > 3 else None, r[2] if len(r) > 2 else None, None, r[1]) for r in EDGES]
    assert found(merkle.manifest(table(spark, EDGES))) == plain(rows)
    assert merkle.manifest(table(spark, [])).count() == 0
    assert found(merkle.manifest(documents(spark, [(7, "a", "en", 3, "alone")]))) == plain([(7, "a", "en", 3, "alone")])


def test_a_proof_fails_for_any_other_leaf(spark):
    docs = documents(spark, [(i, "a", "en" if i % 3 else "de", i, f"text {i}") for i in range(23)])
    proofs = merkle.prove(docs, F.col("lang"), F.col("doc_id"), [F.col("text")], keep={"doc_id": F.col("doc_id")})
    assert merkle.verified(proofs, F.col("leaf")).where("folded_root = root").count() == 23
    assert merkle.verified(proofs, F.sha2(F.concat("leaf", F.lit("x")), 256)).where("folded_root = root").count() == 0
    assert merkle.verified(proofs.withColumn("pos", F.col("pos").bitwiseXOR(F.lit(1))), F.col("leaf")).where("folded_root = root").count() < 5  # lone ends have no neighbour
