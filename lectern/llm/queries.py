"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import clusters, exact_dedup, fingerprint, langid, merkle, mixing, near_dedup, packing, pii, secrets, token_counts, toxicity, warc

#: Folder of the public tokenizers' files, if they are not those of the installed package public_tokenizers.
TOKENIZERS = os.environ.get("LECTERN_TOKENIZERS")


def vocabulary(name: str) -> str:
    """Path of a tokenizer file, on the driver and on every executor."""
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    return importlib.import_module("public_tokenizers").path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 says that SQL can say too."""
    return op2_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(_table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(_table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(_table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_warc_round_trip, op2_fingerprints, op3_personal_data, op4_mix_sources, op5_toxicity, op6_pack_sequences, op7_secrets, op8_language_id, op9_exact_dedup, op10_near_dedup,
        op11_centroid_clusters, op12_merkle_manifest, op13_token_counts, edited_texts,
    )
    return {f.__name__: f for f in every}


_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

OP9_SQL = f"""
WITH n AS (SELECT doc_id, sha256({_NORMAL}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, coalesce(text, '') AS body,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 12) AS BIGINT) + 0.5) / CAST(281474976710656 AS DOUBLE) AS u
  FROM documents),
k AS (SELECT *, -ln(u) / (0.5 + 0.5 / (1.0 + abs(CAST(length(body) AS DOUBLE) / greatest(size, 1) - 6.0) / 6.0)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM k GROUP BY source),
c AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, 3.0 * source_size / weight AS level, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
t AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY level, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
         sum(weight) OVER (ORDER BY level, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM c),
w AS (SELECT source, source_size, least(cap, (SELECT max(water) FROM t WHERE water <= level) * weight) AS target FROM t),
b AS (SELECT k.doc_id, k.size, k.key, w.*, floor(target / source_size) AS epochs, target - floor(target / source_size) * source_size AS budget FROM k JOIN w ON k.source IS NOT DISTINCT FROM w.source),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) <= budget AS inside, sum(size) OVER (PARTITION BY source, key) AS filled FROM b),
g AS (SELECT *, budget - coalesce(sum(size) FILTER (WHERE inside) OVER (PARTITION BY source), 0) AS gap FROM r),
e AS (SELECT *, first_value(key) OVER (PARTITION BY source ORDER BY CASE WHEN NOT inside AND abs(size - gap) < gap THEN 0 ELSE 1 END, abs(size - gap), key) = key
                AND NOT inside AND abs(size - gap) < gap AND abs(filled - gap) < gap AS fills FROM g)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN epochs >= 3 THEN 0 WHEN inside OR fills THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
"""


OP1_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM w
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS sh FROM d),
e AS MATERIALIZED (SELECT doc_id, hash(unnest(sh)) AS x, len(sh) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS MATERIALIZED (SELECT * FROM p),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id
"""


EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS following FROM documents)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(following, 1, length(t) // 2)) AS edited_sha256 FROM d
"""


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Assignments and centroids of all rounds, one after the other."""
    parts = [
        "k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))",
        "v AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS i, CAST(floor(64 * CAST(unnest(e) AS DOUBLE)) AS HUGEINT) AS x FROM k)",
        f"s AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS c FROM k QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM s JOIN v USING (r))",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT r, c, CAST(sum((v.x - q.x) * (v.x - q.x)) AS BIGINT) AS d FROM v JOIN c{n} q USING (i) GROUP BY r, c)")
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT c, i, CAST(sum(x) AS HUGEINT) AS t, CAST(count(*) AS HUGEINT) AS n FROM a{n} JOIN v USING (r) GROUP BY c, i)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (t - ((t % n) + n) % n) // n END AS x FROM c{n} LEFT JOIN m{n} USING (c, i))")
    return (
        f"WITH {', '.join(parts)}, h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) "
        "SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 "
        f"FROM a{rounds} JOIN k USING (r) JOIN h USING (c)"
    )


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"




def _leaf_sql(n_chars: str) -> str:
    return " || ".join(map(_field_sql, ("doc_id", "source", "lang", n_chars, "text")))


#: crc32 of the decimal id, byte by byte and bit by bit.
_CRC_SQL = (
    "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda ch: CAST(ord(ch) AS BIGINT))), "
    "lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))))"
)

OP12_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, sha256({_leaf_sql("n_chars")}) AS leaf,
         sha256(CASE WHEN {_CRC_SQL} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} ELSE {_leaf_sql("n_chars")} END) AS claimed
  FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
t(g, lvl, pos, n, digest) AS (
  SELECT g, 0, pos, n, leaf FROM p
  UNION ALL SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY g, lvl, n, pos // 2),
b AS MATERIALIZED (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, pos, n, digest) AS (
  SELECT 0, pos, n, subroot FROM b
  UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, n, pos // 2),
high AS (SELECT g, subroot, b.pos, b.n, coalesce(string_agg(digest, '' ORDER BY lvl), '') AS proof FROM b LEFT JOIN u ON u.n > 1 AND u.pos = xor(b.pos >> lvl, 1) GROUP BY ALL),
low AS (SELECT r, coalesce(string_agg(digest, '' ORDER BY lvl), '') AS proof FROM p LEFT JOIN t ON t.g = p.g AND t.n > 1 AND t.pos = xor(p.pos >> lvl, 1) GROUP BY r),
f(r, g, lvl, pos, n, node) AS (
  SELECT r, g, 0, pos, n, claimed FROM p
  UNION ALL SELECT f.r, f.g, f.lvl + 1, f.pos // 2, (f.n + 1) // 2, sha256(CASE WHEN f.pos % 2 = 1 THEN t.digest || node ELSE node || coalesce(t.digest, '') END)
  FROM f LEFT JOIN t ON t.g = f.g AND t.lvl = f.lvl AND t.pos = xor(f.pos, 1) WHERE f.n > 1),
e(r, lvl, pos, n, node) AS (
  SELECT r, 0, b.pos, b.n, node FROM f JOIN b USING (g) WHERE f.n = 1
  UNION ALL SELECT e.r, e.lvl + 1, e.pos // 2, (e.n + 1) // 2, sha256(CASE WHEN e.pos % 2 = 1 THEN u.digest || node ELSE node || coalesce(u.digest, '') END)
  FROM e LEFT JOIN u ON u.lvl = e.lvl AND u.pos = xor(e.pos, 1) WHERE e.n > 1)
SELECT doc_id, leaf, subroot, u.digest AS root, sha256(low.proof || high.proof) AS proof_sha256, e.node AS folded_root, e.node = u.digest AS verified
FROM p JOIN low USING (r) JOIN high USING (g) JOIN e ON e.r = p.r AND e.n = 1 JOIN u ON u.n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"edited_texts": EDITED_SQL, "op1_warc_round_trip": OP1_SQL, "op4_mix_sources": OP4_SQL, "op9_exact_dedup": OP9_SQL, "op10_near_dedup": OP10_SQL, "op11_centroid_clusters": _clusters_sql(), "op12_merkle_manifest": OP12_SQL}
