"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 2- and 3-grams of a bounded, hash-chosen sample of labelled texts in the executors; only the
count matrix (languages x BUCKETS) reaches the driver. Its log-probabilities are broadcast, and scoring sums
table rows over all n-grams of every whole text in numpy, a few million characters at a time, also of one very long text.

Only the MOST_LANGUAGES most frequent labels are learned.

Defined results: null text, or text without a letter: 'und' with score 0; without any training row every text is 'und';
ties go to the first language in code-point order; repeated rows are scored alike; further columns are ignored by
predict() and kept by accepted().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import STEP_CHARS, fold, pieces, releasing, sample_rank

#: Hash buckets; the model is languages x BUCKETS x 8 bytes.
BUCKETS = 1 << 15
#: Most training texts of one language (chosen by hash); the classifier's only bounded sample.
TRAIN_TEXTS = 4000
#: Most languages that are learned: the most frequent labels, ties in code-point order. Bounds the table whatever the label column holds.
MOST_LANGUAGES = 256
SMOOTHING = 0.5
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 2- and 3-grams of the texts, and where each text's begin. Position i holds the grams that start at
    character i; grams over a text's end get the bucket BUCKETS."""
    joined = "".join(t.lower().replace("\0", " ") + "\0\0" for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts), dtype=np.int64)
    ends = np.flatnonzero(code == 0)[1::2] + 1
    starts[1:] = ends[:-1]
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    a, b, c = code[:-2], code[1:-1], code[2:]
    pair = a * _MIX[0] + b * _MIX[1]
    two = ((pair ^ (pair >> np.uint32(15))) * _MIX[2]) >> shift
    three = pair * _MIX[1] + c * _MIX[2]
    three = ((three ^ (three >> np.uint32(15))) * _MIX[0]) >> shift
    out = np.full((2, len(code)), BUCKETS, dtype=np.int32)
    inside = (a != 0) & (b != 0)
    out[0, :-2] = np.where(inside, two, BUCKETS)
    out[1, :-2] = np.where(inside & (c != 0), three, BUCKETS)
    return out, starts


def gram_sums(texts: list[str], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of each table's entries over each text's n-grams, characters of each text and its end). A very long text is read in slices that overlap by an n-gram."""
    if max(map(len, texts), default=0) <= STEP_CHARS:
        grams, starts = gram_buckets(texts)
        return np.array([np.add.reduceat(t[grams[0]] + t[grams[1]], starts) for t in tables]), np.diff([*starts, grams.shape[1]])
    sums, lengths = [], []
    for text in texts:
        lower, total = text.lower(), np.zeros(len(tables))
        for at in range(0, len(lower), STEP_CHARS):
            grams, _ = gram_buckets([lower[at : at + STEP_CHARS + 2]])
            grams = grams[:, :STEP_CHARS]  # those that begin in this slice
            total += [(t[grams[0]] + t[grams[1]]).sum() for t in tables]
        sums.append(total)
        lengths.append(len(lower) + 2)
    return np.array(sums).T, np.array(lengths)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held_out: int = 0) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of shape (languages, BUCKETS + 1)); rows of the held-out fold are never read."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held_out))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES).collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((0, BUCKETS + 1))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, TRAIN_TEXTS / counts[lang]))])
    sample = known.where(sample_rank("doc_id") <= share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in pieces(batch):
                for lang, text in zip(part.column(0).to_pylist(), map(str.lower, texts), strict=True):
                    held.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                    for at in range(0, len(text), STEP_CHARS):
                        grams, _ = gram_buckets([text[at : at + STEP_CHARS + 2]])
                        held[lang] += np.bincount(grams[:, :STEP_CHARS].ravel(), minlength=BUCKETS + 1)
        for lang, sums in held.items():
            used = np.flatnonzero(sums[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(sums[used], pa.int64())], ["lang", "bucket", "n"])

    summed = sample.mapInArrow(releasing(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    place = {lang: i for i, lang in enumerate(languages)}
    table[summed["lang"].map(place).to_numpy(dtype=np.int64), summed["bucket"].to_numpy(dtype=np.int64)] += summed["n"].to_numpy(dtype=float)
    return languages, np.hstack([np.log(table / table.sum(axis=1, keepdims=True)), np.zeros((len(languages), 1))])


def classify(texts: list[str | None], languages: list[str], logs: np.ndarray) -> tuple[list[str], list[float]]:
    """The most likely language of each text and its posterior, with the log-likelihood taken per square root of the n-grams."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    able = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if languages else []
    if not able:
        return names, scores
    like, lengths = gram_sums([texts[i] for i in able], logs)
    like = like / np.sqrt(lengths)
    best = like.argmax(axis=0)
    posterior = 1.0 / np.exp(like - like.max(axis=0)).sum(axis=0)
    for at, i in enumerate(able):
        names[i], scores[i] = languages[best[at]], float(posterior[at])
    return names, scores


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    languages, logs = train(docs, id_col, text_col, lang_col, folds, held_out)
    model = docs.sparkSession.sparkContext.broadcast((languages, logs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                names, scores = classify(texts, *model.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, folds) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], rows.schema["held_out"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(releasing(score), schema).withColumnRenamed("doc_id", id_col)


def accepted(docs: DataFrame, least_score: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs whose language is recognised (not 'und', score of least_score or more), all columns kept; nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, text_col):
                names, scores = classify(texts, *model.value)
                yield part.filter(pa.array([n != UNKNOWN and s >= least_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(releasing(keep), docs.schema)
