"""Near-duplicate detection by b-bit MinHash with exact confirmation.

Every distinct shingle set becomes one node, however many documents have it. Full minima give LSH band keys; what is kept of them
are their low bits, packed into longs. Within a band bucket each node is first compared with one leader, so a bucket of m
nodes costs m candidates; components of the confirmed links are found, and only buckets that still
hold several components are compared throughout, in blocks, and across components alone. Similarity is estimated from packed
signatures by bit counts, corrected for chance agreement, to drop hopeless candidates; links are confirmed on the full sets.

Defined results: null or empty text and text of white space have an empty set, are kept and linked with nothing; fewer
than SHINGLE words form one shingle; documents with equal sets are linked; repeated rows share a
component and are kept or dropped together; rows of one doc_id with different texts are nodes of their own; rows without
doc_id are kept and linked with nothing (their component_id is null); an empty table gives an empty table; further
columns are ignored by components() and kept by dedupe().
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import STEP_CHARS, cut, pieces, releasing, slices, small
from lectern.llm.graph import connected, grown

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
#: Low bits kept of each minimum, so many minima to a packed long.
BITS = 4
_PER_LONG = 64 // BITS
_HASHES = BANDS * ROWS
#: Candidates with a lower estimate are dropped: 75 % less 4.5 standard deviations of the estimate.
LEAST_ESTIMATE = 0.57
#: The exhaustive comparison has finer signatures of so many minima, and drops estimates 4.5 of their standard deviations below 75 %.
FINE_HASHES, LEAST_FINE = 1024, 0.69
#: Pairs of each node that are tried at most before the exhaustive comparison, which tries all.
BEST = 8
#: Nodes of a bucket that one block of the exhaustive comparison holds.
BLOCK = 256
#: Shingle sets (about 50 MB), signatures, and links in one file of the shared folder.
SETS, SIGNATURES, LINKS = 10_000, 20_000, 50_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(base: int, most: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[1], np.full(most - 1, base, dtype=np.uint64)]).astype(np.uint64))


@functools.lru_cache(maxsize=2)
def _functions(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = _mix(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * _M1)
    return numbers[:hashes, None] | np.uint64(1), numbers[hashes:, None]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x2545F4914F6CDD1D
_STEP = 1 << 16


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case. Words are hashed as polynomials of their bytes, by prefix sums over a slice of the text."""
    return np.concatenate([_slice_hashes(part) for part in slices(text)])


def _slice_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    raw, space = raw[starts[0] :], space[starts[0] :]
    starts = starts - starts[0]
    # Each byte is weighed by a power of the base for its place in its word; the table of powers starts again every _STEP bytes, with another factor.
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    table = _powers(_BASE, _STEP)
    weight = table[place % _STEP] * _mix((place // _STEP).astype(np.uint64) * _M1 + _M3) if lengths.max() > _STEP else table[np.where(space, 0, place)]
    values = np.where(space, np.uint64(0), (raw.astype(np.uint64) + np.uint64(1)) * weight)
    return _mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64) * _M1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = word_hashes(text) if text else np.zeros(0, dtype=np.uint64)
    n = len(words)
    if not n:
        return words
    width = min(SHINGLE, n)
    sums = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        sums = sums * _M1 + words[k : n - width + 1 + k]
    return np.unique(_mix(sums))


def minima(shingles: np.ndarray, hashes: int = _HASHES) -> np.ndarray:
    a, b = _functions(hashes)
    least, step = np.full(hashes, np.iinfo(np.uint64).max, dtype=np.uint64), (1 << 19) // hashes
    for start in range(0, len(shingles), step):
        least = np.minimum(least, (shingles[None, start : start + step] * a + b).min(axis=1))
    return _mix(least)


def low_bits(least: np.ndarray) -> np.ndarray:
    """The lowest BITS of each minimum, packed into longs."""
    low = (least & np.uint64((1 << BITS) - 1)).reshape(-1, _PER_LONG)
    return np.bitwise_or.reduce(low << (np.arange(_PER_LONG, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed low bits of the minima, band keys), both as signed longs."""
    least = minima(shingles)
    bands = np.full(BANDS, 0, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _M1
    for column in least.reshape(BANDS, ROWS).T:
        bands = _mix(bands ^ column) * _M2
    return low_bits(least), bands.view(np.int64)


_SIGNED = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("packed", T.ArrayType(T.LongType())), T.StructField("bands", T.ArrayType(T.LongType()))])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n_shingles, node (a digest of the set; null for the empty set), packed, bands. docs: doc_id, mark, text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                sizes, nodes, packed, bands = [], [], [], []
                for text in texts:
                    shingles = shingle_set(text)
                    sizes.append(len(shingles))
                    nodes.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                    low, keys = signature(shingles) if len(shingles) else (None, None)
                    packed.append(low)
                    bands.append(keys)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(packed, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "mark", *_SIGNED.names])

    return docs.select("doc_id", "mark", "text").mapInArrow(releasing(sign), T.StructType([docs.schema["doc_id"], docs.schema["mark"], *_SIGNED.fields]))


def agreement(a: Column, b: Column) -> Column:
    """Estimated similarity of two packed signatures: agreeing groups of BITS bits counted, corrected for chance."""
    ones = sum(1 << (BITS * k) for k in range(_PER_LONG))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones

    def differing(x: Column, y: Column) -> Column:
        out = x.bitwiseXOR(y)
        folded = out
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(out, k))
        return F.bit_count(folded.bitwiseAND(F.lit(ones)))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    return (F.lit(1.0) - unequal / F.lit(float(_HASHES)) - F.lit(chance)) / F.lit(1.0 - chance)


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles (its set) for each of nodes (node, doc_id), from the texts of the documents that stand for them."""
    chosen = docs.join(small(nodes), "doc_id").select("node", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                sets = [shingle_set(t) for t in texts]
                right = [xxhash.xxh3_128_digest(s.tobytes()) == node for s, node in zip(sets, part.column(0).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"]).filter(pa.array(right, pa.bool_()))

    return chosen.mapInArrow(releasing(read), "node binary, shingles array<long>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, n_nodes: int, most_pairs: int | None = None) -> tuple[DataFrame, int]:
    """The pairs (a, b) that are links by their full sets, and how many there are at most. nodes: node, packed, n_shingles; sets: node, shingles."""
    near = pairs.join(nodes.select(F.col("node").alias("a"), F.col("packed").alias("pa"), F.col("n_shingles").alias("na")), "a").join(nodes.select(F.col("node").alias("b"), F.col("packed").alias("pb"), F.col("n_shingles").alias("nb")), "b")
    near = near.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT) & (agreement(F.col("pa"), F.col("pb")) >= LEAST_ESTIMATE))
    near = cut(near.select("a", "b", "na", "nb"), most_pairs and most_pairs + n_nodes)
    n = near.count()
    asked = cut(near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct(), n_nodes + 2 * n)
    mine = sets.join(small(asked), "node", "left_semi")
    both = near.join(mine.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(mine.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * 100 >= (F.col("na") + F.col("nb") - shared) * PERCENT).select("a", "b"), n


def _fine(sets: DataFrame) -> DataFrame:
    """node, packed: finer signatures of sets (node, shingles)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                packed = [low_bits(minima(part.column(1)[at].values.to_numpy().view(np.uint64), FINE_HASHES)) for at in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.list_(pa.int64()))], ["node", "packed"])

    return sets.select("node", "shingles").mapInArrow(releasing(sign), "node binary, packed array<long>")


def _mixed_buckets(members: DataFrame) -> DataFrame:
    """key, n of the buckets that hold several components."""
    return members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("least"), F.max("component").alias("most")).where(F.col("least") != F.col("most")).select("key", "n")


def _across(members: DataFrame, most_rows: int, best: int = 0, hashes: int = _HASHES, least_estimate: float = LEAST_ESTIMATE) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket but not a component and may be similar. members: key, node, component, packed [, bands].
    most_rows: rows of members at most. With bands, a pair that shares several buckets is put out by the first of them alone.
    best: if given, only the likeliest pair of each component in each two blocks, and of those so many of each node."""
    blocked = members.join(_mixed_buckets(members), "key").withColumn("of", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    blocks = blocked.groupBy("key", "of", "block").agg(F.collect_list("node").alias("nodes"), F.collect_list("component").alias("components"), F.flatten(F.collect_list("packed")).alias("packed"), *([F.flatten(F.collect_list("bands")).alias("bands")] if "bands" in members.columns else []))
    blocks = cut(blocks, most_rows, SIGNATURES)
    # Each pair of a bucket's blocks is a key of its own, so that the pairs of a large bucket are many tasks.
    left = blocks.withColumn("block2", F.explode(F.sequence(F.col("block"), (F.col("of") - 1).cast("int")))).drop("of")
    right = blocks.select("key", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("block"), *[F.col(c).alias(f"{c}2") for c in blocks.columns if c not in ("key", "of")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = hashes // _PER_LONG
        ones = np.uint64(sum(1 << (BITS * k) for k in range(_PER_LONG)))
        least = least_estimate * (1 - 1.0 / (1 << BITS)) + 1.0 / (1 << BITS)
        for batch in batches:
            place = {c: k for k, c in enumerate(batch.schema.names)}
            for at_row in range(batch.num_rows):
                # Long lists stay in the batch, seen through numpy; as Python numbers they would take five times the memory.
                wide = {c: batch.column(place[c])[at_row].values.to_numpy() for c in ("packed", "packed2", "bands", "bands2") if c in place}
                row = {c: batch.column(place[c])[at_row].as_py() for c in place if c not in wide}
                same = row["block"] == row["block2"]
                x, y = (wide[c].view(np.uint64).reshape(-1, longs) for c in ("packed", "packed2"))
                labels = {c: n for n, c in enumerate({*row["components"], *row["components2"]})}
                of_x, of_y = (np.array([labels[c] for c in row[k]]) for k in ("components", "components2"))
                likely = np.zeros((len(x), len(y)), dtype=np.int16)
                for i in range(len(x)):
                    odd = x[i][None, :] ^ y
                    folded = odd | (odd >> np.uint64(1)) | (odd >> np.uint64(2)) | (odd >> np.uint64(3))
                    equal = hashes - np.bitwise_count(folded & ones).sum(axis=1, dtype=np.int16)
                    likely[i] = np.where((equal >= least * hashes) & (of_y != of_x[i]), equal, 0)
                if same:
                    likely = np.triu(likely, 1)
                chosen = likely > 0
                if best:
                    # The likeliest pair of each component of either side.
                    some = np.zeros_like(chosen)
                    for side, of in ((likely, of_x), (likely.T, of_y)):
                        order = np.argsort(-side.max(axis=1), kind="stable")
                        rows = order[np.unique(of[order], return_index=True)[1]]
                        (some if side is likely else some.T)[rows, side[rows].argmax(axis=1)] = True
                    chosen &= some
                if "bands" in wide:
                    u, v = (wide[c].reshape(-1, BANDS) for c in ("bands", "bands2"))
                    at = np.argwhere(chosen)
                    for start in range(0, len(at), 4096):
                        i, j = at[start : start + 4096].T
                        chosen[i, j] = u[i, (u[i] == v[j]).argmax(axis=1)] == row["key"]
                out = [(min(row["nodes"][i], row["nodes2"][j]), max(row["nodes"][i], row["nodes2"][j]), likely[i, j]) for i, j in zip(*np.nonzero(chosen), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int32()), strict=True)], ["a", "b", "equal"])

    pairs = left.join(right, ["key", "block", "block2"]).mapInArrow(releasing(compare), "a binary, b binary, equal int").distinct()
    if not best:
        return pairs.select("a", "b")
    ways = pairs.union(pairs.select("b", "a", "equal"))
    ranked = ways.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(F.col("equal").desc(), "b"))).where(F.col("nth") <= best)
    return ranked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, doc_id, n_shingles, packed; component: node, component) of signed documents."""
    grouped = signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("packed").alias("packed"), F.first("bands").alias("bands"))
    full = cut(grouped, signed.count(), SIGNATURES)
    n_nodes = full.count()
    nodes = full.drop("bands")
    rows = full.select("node", F.explode("bands").alias("key"))
    shared = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where(F.col("n") > 1).select("key", "leader"), BANDS * n_nodes)
    members = cut(rows.join(shared, "key"), BANDS * n_nodes)
    n_members = members.count()
    # The texts are read a second and last time for the sets of all nodes that share a bucket with another.
    shared = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id")
    sets = cut(_sets(docs, cut(shared, n_nodes)), n_nodes, SETS)
    stars = members.where(F.col("node") != F.col("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    component = connected(*confirmed(stars, nodes, sets, n_nodes, n_members), LINKS)
    placed = members.select("key", "node")

    def labelled(component: DataFrame) -> DataFrame:
        return placed.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def joined(component: DataFrame, edges: DataFrame, most_edges: int) -> DataFrame:
        return cut(grown(component, edges, n_nodes + most_edges), n_nodes)

    # First each component's likeliest pairs with others, which join nearly all that belong together; then all that is left.
    likeliest = _across(labelled(component).join(nodes.select("node", "packed"), "node"), n_members, BEST)
    component = joined(component, *confirmed(likeliest, nodes, sets, n_nodes, BEST * n_nodes))
    rest = cut(labelled(component), n_members)
    rest = cut(rest.join(_mixed_buckets(rest), "key", "left_semi"), n_members)
    fine = cut(_fine(sets.join(rest.select("node").distinct(), "node", "left_semi")), n_nodes, SIGNATURES)
    more = confirmed(_across(rest.join(fine.join(full.select("node", "bands"), "node"), "node"), rest.count(), 0, FINE_HASHES, LEAST_FINE), nodes, sets, n_nodes)
    return nodes, joined(component, *more)


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, component_id, kept for every row."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("mark"))
    signed = cut(signatures(plain).withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node"))))
    nodes, component = links(plain, signed)
    named = nodes.select("node", "doc_id").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(smallest, "component").select("node", "component_id")
    out = signed.select("doc_id", "mark", "n_shingles", "node").join(of_node, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "mark", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    return _placed(docs, id_col, text_col).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", "kept")


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, all columns kept. Rows are told by id and text, so a text that shares its id with another is judged by itself."""
    dropped = cut(_placed(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("__doc_id"), F.col("mark").alias("__mark")).distinct())
    return docs.join(small(dropped), (docs[id_col] == F.col("__doc_id")) & (F.xxhash64(docs[text_col]) == F.col("__mark")), "left_anti")
