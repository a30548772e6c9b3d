"""Toxicity by nearest labelled examples: exact cosine of label-weighted TF-IDF over an inverted index.

The index is fitted on a bounded sample of labelled texts: the EXAMPLES of each label whose ids have the least hashes; only their term counts reach the driver. Its vocabulary is every
term of these. A term weighs its idf, by default times LEAST_TELLING plus its log-odds between the labels, so that no term is left out
and telling ones count more (label_weights=False leaves plain TF-IDF, which finds far fewer toxic texts: see the README); lengths are over all terms of a text that the examples have. Examples stand in blocks, and a block's greatest
weight of each term bounds its cosines: blocks that cannot hold a neighbour are passed over, so the neighbours are exact. Blocks
are compared by a matrix product for the HEAD most frequent terms and by postings for the others, BATCH texts at a time.
Votes are weighted by distance and calibrated by logistic regression on the votes that each half of the examples has from an index of the
other half, so that no label has a part in the vote it is held against, with labels weighed as in all rows.

Defined results: null and empty texts, and texts without a term of the index, get the rate of toxic examples that have no term
either; without labelled rows every score is 0; labels that are null or belong to no document are not used, a doc_id with both labels counts as
toxic, and of several texts of a labelled doc_id the least in code-point order is the example; ties in
distance go to the earlier example of the index; repeated rows are scored alike; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import cut, fold, pieces, sample_rank

#: Most examples of each label, chosen by hash; the classifier's only bounded sample.
EXAMPLES = 1500
#: The most frequent terms, whose weights are a dense matrix; texts that are compared at a time.
HEAD, BATCH = 256, 128
#: Examples of a block; blocks that are compared first; main directions by which examples are put in order.
BLOCK, FIRST, DIRECTIONS = 32, 4, 8
NEIGHBOURS = 15
#: What a term weighs that is as frequent in both labels, beside its log-odds.
LEAST_TELLING = 0.1

_TERM = re.compile(r"[^\W_]+")


def term_counts(text: str | None) -> Counter:
    return Counter(_TERM.findall(text.lower())) if text else Counter()


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one range after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


@dataclasses.dataclass
class Index:
    """Block-max inverted index of the examples, which stand in blocks of BLOCK like ones.

    A cell is what a block has of a term: cells cells[t]:cells[t + 1] are those of term t, with their block, their greatest weight, and their
    postings postings[c]:postings[c + 1] (rows, weights). The terms below len(head) are the most frequent; head has their weights
    by term and example, head_most the greatest of each block."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    toxic: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    cells: np.ndarray
    block: np.ndarray
    most: np.ndarray
    postings: np.ndarray
    head: np.ndarray
    head_most: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    none: float = 0.0

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of length 1."""
        found = [(t, n) for term, n in counts.items() if (t := self.vocabulary.get(term)) is not None]
        terms = np.array([t for t, _ in found], dtype=np.int64)
        weights = (1.0 + np.log(np.array([n for _, n in found], dtype=float))) * self.idf[terms]
        return terms, weights / (np.sqrt((weights * weights).sum()) or 1.0)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], most: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each vector the examples with the highest cosine above 0 (so many, ties to the earlier example) and the cosines.

        Every block's greatest weights bound its cosines. The FIRST blocks of the highest bounds are compared, then all whose bound reaches the lowest cosine
        among the best so far; no other block can hold a neighbour."""
        n_texts, n_blocks, n = len(vectors), self.head_most.shape[1], len(self.ids)
        text = np.repeat(np.arange(n_texts), [len(t) for t, _ in vectors])
        terms, weights = np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors])
        often = terms < len(self.head)
        asked = np.zeros((n_texts, len(self.head)))
        asked[text[often], terms[often]] = weights[often]
        text, terms, weights = text[~often], terms[~often], weights[~often]
        held = self.cells[terms + 1] - self.cells[terms]
        cell = _ranges(self.cells[terms], held)
        pair, weight = np.repeat(text, held) * n_blocks + self.block[cell], np.repeat(weights, held)
        bounds = asked @ self.head_most + np.bincount(pair, weight * self.most[cell], n_texts * n_blocks).reshape(n_texts, n_blocks)
        bounds *= 1 + 1e-9  # sums are rounded
        cosines = np.zeros((n_texts, n))

        def compare(chosen: np.ndarray) -> None:
            for b in np.flatnonzero(chosen.any(axis=0)):
                some = np.flatnonzero(chosen[:, b])
                cosines[some, b * BLOCK : (b + 1) * BLOCK] = asked[some] @ self.head[:, b * BLOCK : (b + 1) * BLOCK]
            here = chosen.ravel()[pair]
            at = cell[here]
            size = self.postings[at + 1] - self.postings[at]
            posting = _ranges(self.postings[at], size)
            where = np.repeat(pair[here] // n_blocks, size) * n + self.rows[posting]
            np.add(cosines, np.bincount(where, np.repeat(weight[here], size) * self.weights[posting], cosines.size).reshape(cosines.shape), out=cosines)

        first = np.zeros(bounds.shape, dtype=bool)
        np.put_along_axis(first, np.argpartition(-bounds, min(FIRST, n_blocks) - 1, axis=1)[:, :FIRST], True, axis=1)
        compare(first & (bounds > 0))
        least = np.partition(cosines, -most, axis=1)[:, -most] if n > most else np.zeros(n_texts)
        compare(~first & (bounds > 0) & (bounds >= least[:, None]))
        out = []
        for row in cosines:
            least = np.partition(row, -most)[-most] if n > most else 0.0
            rows = np.flatnonzero((row > 0) & (row >= least))
            rows = rows[np.lexsort((rows, -row[rows]))[:most]]
            out.append((rows, row[rows]))
        return out

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """Log-odds of the distance-weighted share of toxic neighbours, smoothed by one neighbour of each label at distance 1."""
        closeness = 1.0 / (1.05 - np.minimum(cosines, 1.0))
        yes = float((closeness * self.toxic[rows]).sum())
        return math.log((yes + 0.5) / (float(closeness.sum()) - yes + 0.5))

    def scores(self, texts: list[dict[str, int]]) -> list[tuple[float, list[int]]]:
        """Of each text's counts the calibrated score, and the ids of the nearest examples as evidence."""
        if not len(self.ids):
            return [(self.none, [])] * len(texts)
        out: list[tuple[float, list[int]]] = []
        for start in range(0, len(texts), BATCH):
            for rows, cosines in self.nearest([self.vector(c) for c in texts[start : start + BATCH]]):
                vote = self.slope * self.vote(rows, cosines) + self.offset
                out.append((1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, vote)))), [int(i) for i in self.ids[rows[:3]]]) if len(rows) else (self.none, []))
        return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small penalty."""
    theta, a = np.zeros(2), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ theta, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + 1e-2 * theta
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), gradient)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def build(examples: list[tuple[int | None, dict[str, int], int]], share: dict[int, float], label_weights: bool = True) -> Index:
    """The calibrated index. examples: (doc_id, counts of its text's terms, label). share: of all labelled rows of a label, the part that the examples are."""
    index = _index(examples, label_weights)
    # Halves with as many of each label.
    by_label = sorted(examples, key=lambda e: e[2])
    votes, labels, empty = [], [], []
    for held, rest in ((by_label[0::2], by_label[1::2]), (by_label[1::2], by_label[0::2])):
        half = _index(rest, label_weights)
        for start in range(0, len(held) if rest else 0, BATCH):
            some = held[start : start + BATCH]
            for (_, _, label), (rows, cosines) in zip(some, half.nearest([half.vector(c) for _, c, _ in some]), strict=True):
                if len(rows):
                    votes.append(half.vote(rows, cosines))
                    labels.append(label)
                else:
                    empty.append(label)
    weight = {y: 1.0 / share[y] for y in share}
    mean = sum(weight[y] for _, _, y in examples) / max(1, len(examples))
    if votes:
        index.slope, index.offset = _logistic(np.array(votes), np.array(labels, dtype=float), np.array([weight[y] / mean for y in labels]))
    prior = sum(weight[y] * y for _, _, y in examples) / (mean * len(examples)) if examples else 0.0
    index.none = (sum(weight[y] / mean * y for y in empty) + prior) / (sum(weight[y] / mean for y in empty) + 1.0) if examples else 0.0
    return index


def _index(examples: list[tuple[int | None, dict[str, int], int]], label_weights: bool) -> Index:
    """The index before its votes are calibrated."""
    counts = [c for _, c, _ in examples]
    toxic = np.array([y for _, _, y in examples], dtype=float)
    with_term: Counter = Counter()
    toxic_with: Counter = Counter()
    for c, y in zip(counts, toxic, strict=True):
        with_term.update(c.keys())
        if y:
            toxic_with.update(c.keys())
    n, n_toxic = len(examples), float(toxic.sum())

    def telling(term: str) -> float:
        """The log-odds between the labels, either way, which is weighed but never a reason to leave a term out."""
        if not label_weights:
            return 1.0
        a, b = toxic_with[term], with_term[term] - toxic_with[term]
        return LEAST_TELLING + abs(math.log((a + 0.5) / (n_toxic + 1.0) * (n - n_toxic + 1.0) / (b + 0.5)))

    ranked = sorted(with_term, key=lambda t: (-with_term[t], t))
    vocabulary = {t: i for i, t in enumerate(ranked)}
    idf = np.array([(math.log((1 + n) / (1 + with_term[t])) + 1.0) * telling(t) for t in ranked])
    index = Index(vocabulary, idf, toxic, np.array([i if i is not None else -1 for i, _, _ in examples], dtype=np.int64), *[np.zeros(0)] * 8)
    vectors = [index.vector(c) for c in counts]
    term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, dtype=np.int64)
    weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
    row = np.repeat(np.arange(n), np.array([len(t) for t, _ in vectors], dtype=np.int64))
    often = term < min(HEAD, len(ranked))
    head = np.zeros((min(HEAD, len(ranked)), n))
    head[term[often], row[often]] = weight[often]
    # Like examples stand together: those of one label that lie along the same of the head's main directions.
    order = np.arange(n)
    if len(head):
        main = np.linalg.svd(head, full_matrices=False)
        along = (main[1][:DIRECTIONS, None] * main[2][:DIRECTIONS]).T
        strongest = np.abs(along).argmax(axis=1)
        order = np.lexsort((along[np.arange(n), strongest], strongest, toxic))
    place = np.argsort(order)
    index.toxic, index.ids, index.head = toxic[order], index.ids[order], head[:, order]
    row = place[row]
    starts = np.arange(0, n, BLOCK)
    index.head_most = np.maximum.reduceat(index.head, starts, axis=1) if n else np.zeros((len(head), 0))
    sorting = np.lexsort((row, term))
    term, index.rows, index.weights = term[sorting], row[sorting], weight[sorting]
    key = term * (len(starts) + 1) + index.rows // BLOCK
    begins = np.flatnonzero(np.diff(key, prepend=-1))
    index.block, index.postings = index.rows[begins] // BLOCK, np.append(begins, len(key))
    index.most = np.maximum.reduceat(index.weights, begins) if len(begins) else np.zeros(0)
    index.cells = np.searchsorted(term[begins], np.arange(len(ranked) + 1))
    return index


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held_out: int = 2, label_weights: bool = True) -> Index:
    """The index of EXAMPLES labelled texts of each label, or all if there are fewer; rows of the held-out fold are never read."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    rank = sample_rank("doc_id")
    chosen = [known.where(F.col("label") == y).orderBy(rank, "doc_id").limit(EXAMPLES) for y in (0, 1)]
    # 2 * EXAMPLES rows at most, which bounds the broadcast, and what is collected to the distinct terms of so many texts.
    sample = cut(chosen[0].unionByName(chosen[1]))
    met = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                counts = [term_counts(text) for text in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))], schema.names)

    schema = T.StructType([met.schema["doc_id"], met.schema["label"], T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    rows = [(r["doc_id"], dict(zip(r["terms"], r["counts"], strict=True)), r["label"]) for r in met.mapInArrow(count, schema).collect()]
    held = Counter(label for _, _, label in rows)
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return build(sorted(rows, key=lambda r: (r[2], str(r[0]))), {y: held[y] / sizes[y] for y in held}, label_weights)


def predict(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held_out: int = 2, label_weights: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the three nearest examples) for every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, folds, held_out, label_weights))
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, folds) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], rows.schema["held_out"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value
        for batch in batches:
            for part, texts in pieces(batch):
                scored = index.scores([term_counts(text) for text in texts])
                scores = [s for s, _ in scored]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([e for _, e in scored], pa.list_(pa.int64()))], schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
