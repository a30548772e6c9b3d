"""Which paragraph holds a passage: by the passage's rarest run of characters, then by looking.

A paragraph that holds a needle holds all its runs of GRAM characters. Runs are told by numbers of SLOT_BITS bits, which are counted over all paragraphs in numpy (a task
puts out its sums only), each needle keeps its rarest one, and only paragraphs that hold this are searched. Runs that share a number are counted together; that makes a search
longer, never wrong. A needle of which some run is in no paragraph is done without any search. Nothing is compared pairwise, and texts are shuffled only if there are too
many needles for a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.joins import MOST_BROADCAST, cut, small

#: Characters of a run; needles have at least so many.
GRAM = 4
#: A run's number has so many bits; a task's counts are one array of all numbers.
SLOT_BITS = 22
#: Characters of text that one numpy step holds, about; of one longer text, it takes parts.
STEP_CHARS = 2_000_000
#: Paragraphs with one run that a task gets at most, about; a run that more have is dealt over several keys.
SPLIT = 20_000
#: Keys that a run is dealt over at most.
MOST_SALTS = 1_024
#: Odd multipliers of a run's characters.
_MIX = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


#: A character in match form, by its number; MAX is none.
_NONE = np.iinfo(np.uint32).max
_FOLDED = np.arange(0x110000, dtype=np.uint32)
_FOLDED[[ord(c) for c in X.FULL]] = [ord(c) for c in X.HALF]
_FOLDED[np.isin(_FOLDED, [ord(c) for c in X.UNMATCHED])] = _NONE


def steps(text: str) -> Iterator[np.ndarray]:
    """The characters of a text's match form, in parts that have each run once."""
    rest = np.zeros(0, dtype=np.uint32)
    for at in range(0, len(text), STEP_CHARS):
        codes = _FOLDED[np.frombuffer(text[at : at + STEP_CHARS].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        part = np.concatenate([rest, codes[codes != _NONE]])
        yield part
        rest = part[max(len(part) - GRAM + 1, 0) :]


def numbers(codes: np.ndarray, salt: int = 0) -> np.ndarray:
    """The numbers of the runs of GRAM characters, in their order; salt: what tells scopes apart."""
    codes = codes.astype(np.uint64) + np.uint64(1)
    of = max(len(codes) - GRAM + 1, 0)
    mixed = np.full(of, np.uint64(salt % (1 << 64)))
    for i, m in enumerate(_MIX):
        mixed += codes[i : i + of] * m
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX[0]
    return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slots(text: Column, scope: Column, chosen: np.ndarray | None = None) -> Column:
    """slots, body: the distinct numbers of a text's runs and its match form; with chosen (a truth value a number) only numbers that are chosen, and no form where there are none.
    scope: a whole number that tells scopes apart."""

    def told(texts: pd.Series, scopes: pd.Series) -> pd.DataFrame:
        found, bodies = [], []
        for text, salt in zip(texts, scopes, strict=True):
            parts = list(steps(text or ""))
            runs = [numbers(part, salt) for part in parts]
            found.append(np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *[r if chosen is None else r[chosen[r]] for r in runs]])).astype(np.int32))
            own = [part if i == 0 else part[min(len(parts[i - 1]), GRAM - 1) :] for i, part in enumerate(parts)]
            bodies.append("".join(p.tobytes().decode("utf-32-le", "surrogatepass") for p in own) if len(found[-1]) or chosen is None else None)
        return pd.DataFrame({"slots": pd.Series(found, dtype=object), "body": pd.Series(bodies, dtype=object)})

    return F.pandas_udf(told, "slots array<int>, body string")(text, scope)


def counted(texts: DataFrame) -> DataFrame:
    """__slot, __n: how often each number is there. texts: text, __scope; a number has a row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in batches:
            for text, salt in zip(batch.column(0), batch.column(1), strict=True):
                for part in steps(text.as_py() or ""):
                    found = numbers(part, salt.as_py())
                    # Short texts touch few numbers; a long one counts them all at once.
                    if len(found) < 200_000:
                        np.add.at(sums, found, 1)
                    else:
                        sums += np.bincount(found, minlength=1 << SLOT_BITS)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(sums[there])], ["__slot", "__n"])

    return texts.select("text", "__scope").mapInArrow(run, "__slot int, __n long")


def salts(most: int, split: int = SPLIT) -> int:
    """Keys that a run of the most frequent kind is dealt over."""
    return min(max(-(-most // split), 1), MOST_SALTS)


def contained(needles: DataFrame, paragraphs: DataFrame, scope: Sequence[str], needle_id: str, paragraph_id: str, order: Sequence[str], split: int = SPLIT, most: int = MOST_BROADCAST) -> DataFrame:
    """needle_id, paragraph_id: the longest paragraph of the same scope that holds the needle (GRAM characters or more, in match form); the first of several by order.

    needles: needle_id, scope, needle; paragraphs: paragraph_id, scope, text, order. Needles that are shorter, null or found nowhere have no row; a null in a scope
    column meets nothing; repeated needles are looked up once. most: needles up to which they are broadcast."""
    scope = list(scope)
    told = F.xxhash64(*scope) if scope else F.lit(0).cast("long")
    asked = cut(needles.select(F.col(needle_id).alias("__needle"), *scope, X.match_form(F.col("needle")).alias("__form")).where(F.length("__form") >= GRAM))
    wanted = asked.dropna(subset=scope).select(*scope, "__form").distinct().withColumn("__slots", slots(F.col("__form"), told)["slots"])
    runs = cut(wanted.select(*scope, "__form", F.size("__slots").alias("__of"), F.explode("__slots").alias("__slot")))
    read = paragraphs.dropna(subset=scope).withColumns({"__paragraph": F.col(paragraph_id), "__scope": told})
    counts = cut(counted(read).join(small(runs.select("__slot").distinct()), "__slot", "left_semi").groupBy("__slot").agg(F.sum("__n").alias("__n")))
    known = runs.join(small(counts), "__slot").groupBy(*scope, "__form", "__of").agg(F.min(F.struct("__n", "__slot")).alias("__rarest"), F.count(F.lit(1)).alias("__found"))
    chosen = cut(known.where("__found = __of").select(*scope, "__form", "__rarest.*"))
    # The chosen numbers are bits, however many needles there are.
    bits = np.zeros(1 << SLOT_BITS, dtype=bool)
    bits[[r["__slot"] for r in chosen.select("__slot").distinct().toLocalIterator()]] = True
    held = read.withColumn("__held", slots(F.col("text"), F.col("__scope"), bits)).where(F.size("__held.slots") > 0).withColumns({"__slots": F.col("__held.slots"), "__body": F.col("__held.body")})
    if chosen.limit(most + 1).count() <= most:
        searched = held.select(*scope, "__paragraph", *order, "__body", F.explode("__slots").alias("__slot")).join(F.broadcast(chosen), [*scope, "__slot"])
    else:
        of = salts(chosen.agg(F.coalesce(F.max("__n"), F.lit(0)).alias("n")).first()["n"], split)
        dealt = chosen.select(*scope, "__form", "__slot", F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias("__salt"))
        each = held.select(*scope, "__paragraph", F.explode("__slots").alias("__slot")).withColumn("__salt", F.pmod(F.xxhash64("__paragraph"), F.lit(of)))
        pairs = cut(each.join(dealt, [*scope, "__slot", "__salt"]).select(*scope, "__paragraph", "__form").distinct())
        searched = read.select(*scope, "__paragraph", *order, X.match_form(F.col("text")).alias("__body")).join(small(pairs), [*scope, "__paragraph"])
    best = searched.where(F.contains("__body", "__form")).groupBy(*scope, "__form").agg(F.min_by("__paragraph", F.struct(-F.length("__body"), *[F.col(c) for c in order])).alias(paragraph_id))
    return asked.join(best, [*scope, "__form"]).select(F.col("__needle").alias(needle_id), paragraph_id)
