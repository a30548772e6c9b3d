"""Greedy packing of paragraphs into chunks and parts.

Packing depends on what came before, so it is a fold over a chapter's paragraphs in order: Spark partitions by chapter, which
always ends a chunk, and a small generator runs through each chapter's rows as they stream by, holding one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import constants as K


def _streamed(paragraphs: DataFrame, keys: Sequence[str], order: str, anchor: str, text: str, pack, names: Sequence[str]) -> DataFrame:  # noqa: ANN001
    """Rows of pack(rows of a group) for each group of keys. Rows arrive sorted, so a group is never held as a whole."""
    types = {k: paragraphs.schema[k].dataType for k in keys}
    fields = [T.StructField(k, types[k]) for k in keys] + [T.StructField(names[0], T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("anchors", T.ArrayType(T.StringType()))]
    rows = paragraphs.select(*keys, F.col(order).alias("__order"), F.col(anchor).cast("string").alias("__anchor"), F.col(text).alias("__text")).repartition(*keys).sortWithinPartitions(*keys, "__order")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, packer, out = object(), None, []
        for frame in frames:
            for row in frame.itertuples(index=False):
                key = tuple(row[: len(keys)])
                if key != now:
                    if packer:
                        out += [(*now, *c) for c in packer.end()]
                    now, packer = key, pack()
                out += [(*now, *c) for c in packer.add(row[-2], row[-1] or "")]
            if len(out) > 1000:
                yield pd.DataFrame(out, columns=[f.name for f in fields])
                out = []
        if packer:
            out += [(*now, *c) for c in packer.end()]
        yield pd.DataFrame(out, columns=[f.name for f in fields])

    return rows.mapInPandas(run, T.StructType(fields))


class _Chunks:
    """Segments are added while the chunk stays within target; a paragraph over twice the target is sliced first."""

    def __init__(self, target: int) -> None:
        self.target, self.number, self.texts, self.anchors, self.size = target, 0, [], [], 0

    def end(self) -> list[tuple]:
        if not self.size:
            return []
        self.number += 1
        out = [(self.number, "".join(self.texts), list(dict.fromkeys(self.anchors)))]
        self.texts, self.anchors, self.size = [], [], 0
        return out

    def add(self, anchor: str, text: str) -> list[tuple]:
        out = []
        step = self.target if len(text) > 2 * self.target else max(len(text), 1)
        for start in range(0, len(text), step):
            part = text[start : start + step].strip()
            if not part:
                continue
            if self.size and self.size + len(part) > self.target:
                out += self.end()
            self.texts.append(part)
            self.anchors.append(anchor)
            self.size += len(part)
        return out


class _Parts:
    """Paragraphs are added while the part stays within the limit; one over the limit opens a new part and is sliced.
    The count of characters is not set back where such a paragraph opens a part, so the next may end early; no text is lost."""

    def __init__(self, limit: int) -> None:
        self.limit, self.number, self.texts, self.anchors, self.size = limit, 0, [], [], 0

    def end(self) -> list[tuple]:
        if not self.texts:
            return []
        self.number += 1
        out = [(self.number, "\n".join(self.texts), list(dict.fromkeys(self.anchors)))]
        self.texts, self.anchors = [], []
        return out

    def add(self, anchor: str, text: str) -> list[tuple]:
        out = self.end() if len(text) > self.limit else []
        for start in range(0, max(len(text), 1), self.limit):
            part = text[start : start + self.limit]
            if self.texts and self.size + len(part) > self.limit:
                out += self.end()
                self.size = 0
            self.texts.append(part)
            self.anchors.append(anchor)
            self.size += len(part)
        return out


class _Summaries(_Chunks):
    """At most SUMMARY_PARAGRAPHS paragraphs and SUMMARY_CHARS characters; a paragraph is never split."""

    def add(self, anchor: str, text: str) -> list[tuple]:
        out = []
        if self.size and (len(self.texts) >= K.SUMMARY_PARAGRAPHS or self.size + len(text) > self.target):
            out = self.end()
        if text:
            self.texts.append(text)
            self.anchors.append(anchor)
            self.size += len(text)
        return out


def chunks(paragraphs: DataFrame, keys: Sequence[str], order: str = "pos", anchor: str = "anchor", text: str = "text", target: int = K.CHUNK_CHARS) -> DataFrame:
    return _streamed(paragraphs, keys, order, anchor, text, lambda: _Chunks(target), ["chunk"])


def parts(paragraphs: DataFrame, keys: Sequence[str], order: str = "pos", anchor: str = "anchor", text: str = "text", limit: int = K.PART_CHARS) -> DataFrame:
    return _streamed(paragraphs, keys, order, anchor, text, lambda: _Parts(limit), ["part"])


def summary_chunks(paragraphs: DataFrame, keys: Sequence[str], order: str = "pos", anchor: str = "anchor", text: str = "text", budget: int = K.SUMMARY_CHARS) -> DataFrame:
    return _streamed(paragraphs, keys, order, anchor, text, lambda: _Summaries(budget), ["chunk"])


def page_packs(boxes: DataFrame, keys: Sequence[str], height: float = K.PAGE_HEIGHT) -> DataFrame:
    """keys, ord, top, bottom, pack: boxes in order, a new pack where a box's bottom is more than height below its pack's first top. Boxes stream by in order."""
    rows = boxes.select(*keys, "ord", "top", "bottom").repartition(*keys).sortWithinPartitions(*keys, "ord")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, first, pack = None, 0.0, -1
        for frame in frames:
            packs = []
            for row in frame.itertuples(index=False):
                key, top, bottom = tuple(row[: len(keys)]), row[-2], row[-1]
                if key != now:
                    now, pack = key, -1
                if pack < 0 or bottom - first > height:
                    first, pack = top, pack + 1
                packs.append(pack)
            yield frame.assign(pack=pd.Series(packs, dtype="int32", index=frame.index))

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("pack", T.IntegerType())]))


def within_budget(paragraphs: DataFrame, keys: Sequence[str], order: str, length, budget: int) -> DataFrame:  # noqa: ANN001
    """The first paragraphs of each group whose lengths sum up to the budget at most."""
    from pyspark.sql import Window

    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return paragraphs.withColumn("__upto", F.sum(length).over(upto)).where(F.col("__upto") <= budget).drop("__upto")
