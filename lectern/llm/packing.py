"""Packing of tokenized documents into sequences of CAPACITY tokens, balanced by attention cost.

Each task packs what it reads, a group of about GROUP_TOKENS at a time, so nothing is shuffled and memory is bounded. In a
group the number of sequences is fixed first. Documents are cut into full sequences and a rest; rests are taken in
descending order of length, each put into the sequence with the lowest cost (linear plus quadratic attention cost of its pieces)
that still has room, or cut over the cheapest sequences where none has room for all of it. What a group leaves over goes to the next; what a task has left over at
its end forms sequences whose lengths are powers of two, so no sequence needs padding.

Defined results: null text is the empty text, which has the end token alone; repeated rows and repeated ids are
documents of their own; a very long text spans many sequences; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import STEP_CHARS, pieces, releasing, slices

CAPACITY = 4096
END_ID = 2
#: Tokens that one task packs at once.
GROUP_TOKENS = 512 * CAPACITY
#: Cost of a piece of n tokens: n + n * n / QUADRATIC.
QUADRATIC = 2048.0
#: Bytes of text parts, and of their ids, that a task remembers at most; the memory is emptied beyond that, and ends with the task.
REMEMBERED_BYTES = 24 << 20

#: Words whose parts are plain to see: printable ASCII and Latin-1 letters, which lower-casing and NFC map one to one.
_PLAIN = "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*$"
#: The vocabulary's split pattern (a fixed value of its format) for lower-cased plain words, one a line.
_PARTS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff\n]+")


@functools.lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):  # noqa: ANN202
    """The tokenizer, and of each id whether it ends a part."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Python worker has one core
    tokenizer = Tokenizer.from_file(vocabulary)
    tokens = tokenizer.get_vocab(with_added_tokens=False)
    last = np.zeros(max(tokens.values()) + 1, dtype=bool)
    last[[i for token, i in tokens.items() if token.endswith("</w>")]] = True
    return tokenizer, last


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit bytes, for the length of one task.

    The vocabulary's tokens never cross white space, nor the borders of runs of letters, single digits and runs of other signs. So a block's
    distinct words are found first, then the distinct parts of these; only parts that the task has not met reach the tokenizer, many in one call."""

    def __init__(self, vocabulary: str) -> None:
        self.tokenizer, self.last = _tokenizer(vocabulary)
        self.parts: dict[str, bytes] = {"\n": b""}
        self.held = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        lines = self._ids([" ".join(parts[i : i + 200]) for i in range(0, len(parts), 200)])
        raw = b"".join(lines)
        ids = np.frombuffer(raw, dtype="<u4")
        ends = (4 * (np.flatnonzero(self.last[np.minimum(ids, len(self.last) - 1)]) + 1)).tolist()
        found = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) == len(parts) and ends[-1] == len(raw) else self._ids(parts)
        self.parts.update(zip(parts, found, strict=True))
        self.held += sum(map(len, parts)) + len(raw)

    def _plain_ids(self, words: pa.Array) -> pa.Array:
        """Ids of plain words, as one binary value a word."""
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py() + "\n"
        parts = pa.array(_PARTS.findall(lines.lower()), pa.string()).dictionary_encode()
        distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.held > REMEMBERED_BYTES:
            self.parts, self.held = {"\n": b""}, 0
        if new := [p for p in distinct if p not in self.parts]:
            self._learn(new)
        ids = pa.array([self.parts[p] for p in distinct], pa.binary()).take(parts.indices)
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int32)[1 : len(ids) + 1]
        ends = ends[parts.indices.to_numpy() == distinct.index("\n")]
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), ids.buffers()[2]])

    def encode(self, texts: list[str]) -> list[bytes]:
        if max(map(len, texts), default=0) > STEP_CHARS:
            return [b"".join(self._block([part])[0] for part in slices(t)) for t in texts]
        return self._block(texts)

    def _block(self, texts: list[str]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary
        plain = pc.and_(pc.match_substring_regex(distinct, _PLAIN), pc.invert(pc.match_substring(distinct, "<|")))
        known = [self._plain_ids(distinct.filter(plain))] if pc.any(plain).as_py() else []
        known.append(pa.array(self._ids(distinct.filter(pc.invert(plain)).to_pylist()), pa.binary()))
        place = np.argsort(np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        ids = pa.concat_arrays(known).take(pa.array(place[words.indices.to_numpy()]))
        data, ends = ids.buffers()[2], np.frombuffer(ids.buffers()[1], dtype=np.int32)[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        raw = memoryview(data) if data is not None else b""
        return [bytes(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def fill(lengths: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece. room: each sequence's tokens; they hold the documents exactly."""
    pieces: list[tuple[int, int, int, int, int]] = []
    left, cost = np.array(room, dtype=np.int64), np.zeros(len(room))
    used = np.zeros(len(room), dtype=np.int64)

    def put(document: int, start: int, length: int, at: int) -> None:
        pieces.append((document, start, length, at, int(used[at])))
        used[at] += length
        left[at] -= length
        cost[at] += length + length * length / QUADRATIC

    rests, full = [], 0
    for document, n in enumerate(lengths):
        whole = min(n // CAPACITY, int((left[full:] == CAPACITY).sum()))
        for k in range(whole):
            put(document, k * CAPACITY, CAPACITY, full)
            full += 1
        if n > whole * CAPACITY:
            rests.append((n - whole * CAPACITY, whole * CAPACITY, document))
    for n, start, document in sorted(rests, key=lambda r: (-r[0], r[2])):
        while n:
            fits = left >= n
            at = int(np.where(fits if fits.any() else left > 0, cost, np.inf).argmin())
            size = min(n, int(left[at]))
            put(document, start, size, at)
            start, n = start + size, n - size
    return pieces


def powers(n: int) -> list[int]:
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. vocabulary: a tokenizers file."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordIds(vocabulary), np.uint32(END_ID).tobytes()
        base = TaskContext.get().partitionId() << 36
        held: list[tuple[object, int, int, bytes]] = []  # id, its tokens, those before these, these tokens' ids
        total = done = 0

        def flush(room: list[int]) -> pa.RecordBatch:
            """The pieces of what is held, but for the last tokens, which are more than room has and stay for the next group."""
            nonlocal held, total, done
            rest, over = [], total - sum(room)
            while over:
                doc_id, whole, start, ids = held.pop()
                taken = min(over, len(ids) // 4)
                rest.append((doc_id, whole, start + len(ids) // 4 - taken, ids[len(ids) - 4 * taken :]))
                if kept := ids[: len(ids) - 4 * taken]:
                    held.append((doc_id, whole, start, kept))
                over -= taken
            out = []
            for d, start, length, at, offset in fill([len(ids) // 4 for *_, ids in held], room):
                doc_id, whole, first, ids = held[d]
                out.append((doc_id, first + start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), whole, base + done + at, offset))
            done += len(room)
            held, total = rest[::-1], total - sum(room)
            columns = list(zip(*out, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], names)

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for part, texts in pieces(batch):
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in texts]), strict=True):
                    ids += end
                    held.append((doc_id, len(ids) // 4, 0, ids))
                    total += len(ids) // 4
                    if total >= GROUP_TOKENS:
                        yield flush([CAPACITY] * (total // CAPACITY))
        if held:
            yield flush([CAPACITY] * (total // CAPACITY) + powers(total % CAPACITY))

    return rows.mapInArrow(releasing(run), schema).withColumnRenamed("doc_id", id_col)
