"""Token counts by byte-pair merging, without ever naming a token.

A text's symbols are its characters. The adjacent pair whose joined piece has the lowest rank (of equal ranks the leftmost)
is merged again and again; pairs wait in a heap, symbols form a linked list over the text's positions, and an entry of the heap that no
longer describes its pair is passed over. The count is the number of symbols less that of merges; characters that the
vocabulary lacks count as their UTF-8 bytes, if nothing has merged them.

No piece holds a space behind another character, so merges never cross the place before a run of spaces: a text falls
into words with the spaces before them, and runs of characters that no longer piece holds, which are counted by themselves. A long
word is cut further wherever no piece holds the two characters side by side. A task remembers the counts of short words (bounded by
MEMO_WORDS, and gone with the task).

Defined results: a null text counts as the empty text, which has no token; very long texts are read in slices that end before a
run of spaces, so only a single word is ever held whole; repeated rows are counted alike; an empty table gives no row; further
columns are ignored. The id keeps its type and may be null.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import STEP_CHARS, pieces

#: The mark that pieces have for a space. Here the space stands for itself, so that most texts need a byte a character.
MARK = "▁"
#: Words that a task remembers at most (some 100 bytes each), and the characters of the longest that is remembered.
MEMO_WORDS, MEMO_CHARS = 600_000, 48

_BEFORE_SPACES = re.compile(f"(?<=[^ {MARK}])[ {MARK}]")
_PLACE = (1 << 40) - 1


def _listed(_: str, values: range) -> list[int]:
    """As array, but faster for few values."""
    return list(values)


class Merges(dict):
    """Counts of words under a vocabulary, made when first asked for."""

    def __init__(self, ranks: dict[str, int]) -> None:
        """ranks: every piece that a merge may give or a character may be, with spaces for their marks; lower ranks merge first."""
        super().__init__()
        self.ranks, self.longest = ranks, max(map(len, ranks), default=1)
        self.beside = {piece[i : i + 2] for piece in ranks for i in range(len(piece) - 1)}
        if any(a != " " and b == " " for a, b in self.beside):
            raise ValueError("a piece holds a space behind another character")
        joined = "".join(sorted({re.escape(c) for pair in self.beside for c in pair} - {re.escape(" ")}))
        self.words = re.compile(f" *[{joined}]+| +|[^ {joined}]+" if joined else " +|[^ ]+").findall

    def __missing__(self, word: str) -> int:
        if len(word) > MEMO_CHARS:
            cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.beside]
            return sum(self.merged(word[i:j]) for i, j in zip([0, *cuts], [*cuts, len(word)], strict=True))
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = count = self.merged(word)
        return count

    def merged(self, word: str) -> int:
        """Symbols of a word less its merges."""
        get, longest, n = self.ranks.get, self.longest, len(word)
        # An entry is rank and place in one integer, so that the heap gives the leftmost pair of the lowest rank.
        heap = [rank << 40 | i for i in range(n - 1) if (rank := get(word[i : i + 2])) is not None]
        heapify(heap)
        make = array if n > MEMO_CHARS else _listed
        after = make("q", range(1, n + 1))  # where the symbol that begins at i ends; 0 where none begins any more
        before = make("q", range(-1, n - 1))  # where the symbol before the one at i begins
        count = n
        while heap:
            entry = heappop(heap)
            i = entry & _PLACE
            middle = after[i]
            if not middle or middle == n or get(word[i : after[middle]]) != entry >> 40:
                continue  # one of the two was merged meanwhile
            end = after[i] = after[middle]
            after[middle] = 0
            count -= 1
            if end < n:
                before[end] = i
                if after[end] - i <= longest and (rank := get(word[i : after[end]])) is not None:
                    heappush(heap, rank << 40 | i)
            if (left := before[i]) >= 0 and end - left <= longest and (rank := get(word[left:end])) is not None:
                heappush(heap, rank << 40 | left)
        # A character that is no piece, and was merged into none, is spelled as bytes.
        return count + sum(len(c.encode()) - 1 for i, c in enumerate(word) if c > "\x7f" and get(c) is None and after[i] == i + 1)

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        total, start = 0, 0
        while start < len(text):
            cut = _BEFORE_SPACES.search(text, start + STEP_CHARS)
            end = cut.start() if cut else len(text)
            spaced = text[start:end].replace(MARK, " ")
            total += sum(map(self.__getitem__, self.words(spaced if start else " " + spaced)))
            start = end
        return total


def vocabulary_ranks(model_file: str) -> dict[str, int]:
    """Ranks of the pieces of a sentencepiece model, from its file, with spaces for their marks. Equal scores have equal ranks. Only models whose texts need no
    other preparation than the marks of spaces are taken."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_file, "rb") as file:
        model.ParseFromString(file.read())
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    form = model.normalizer_spec
    if (
        model.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE
        or form.precompiled_charsmap
        or not (form.add_dummy_prefix and form.escape_whitespaces and model.trainer_spec.byte_fallback)
        or form.remove_extra_whitespaces
        or model.trainer_spec.treat_whitespace_as_suffix
        or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)
    ):
        raise ValueError("only byte-pair models with byte fallback, no normalisation and no pieces of the user's own are counted")
    normal = [p for p in model.pieces if p.type == kinds.NORMAL]
    rank = {score: i for i, score in enumerate(sorted({p.score for p in normal}, reverse=True))}
    return {p.piece.replace(MARK, " "): rank[p.score] for p in normal}


def count(docs: DataFrame, model_file: str, most_tokens: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (more than most_tokens) for every row. model_file is read by every task; nothing is shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = None
        for batch in batches:
            merges = merges or Merges(vocabulary_ranks(model_file))
            for part, texts in pieces(batch):
                tokens = [merges.count(t) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(tokens, pa.int64()), pa.array([n > most_tokens for n in tokens], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return rows.mapInArrow(counted, schema).withColumnRenamed("id", id_col)
