"""Selections in a reader matched to paragraphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import constants as K
from lectern.functions import text as X
from lectern.operators.joins import small


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _run_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all prefixes, powers of the base), modulo 2^64: the hash of any run is a difference of two."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    powers = np.ones(len(codes) + 1, dtype=np.uint64)
    np.multiply.accumulate(np.full(len(codes), _BASE), out=powers[1:])
    return np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(codes * powers[:-1])]), powers


def longest_common_run(a: str, b: str) -> int:
    """Length of the longest common substring.

    Lengths are halved: texts that share a run share all shorter ones. Of one length all runs' hashes are compared at once (sorted search), and those that are equal by
    their characters, so the work is about linear in both texts for each of few lengths."""
    if not a or not b:
        return 0
    (of_a, powers_a), (of_b, powers_b) = _run_hashes(a), _run_hashes(b)
    powers = powers_a if len(powers_a) >= len(powers_b) else powers_b
    most = max(len(a), len(b))

    def shared(size: int) -> bool:
        # Brought to one place: a run's hash times the power that its start lacks.
        runs = [(of[size:] - of[:-size]) * powers[most - np.arange(len(of) - size)] for of in (of_a, of_b)]
        at_a = np.flatnonzero(np.isin(runs[0], runs[1]))
        if not len(at_a):
            return False
        order = np.argsort(runs[1], kind="stable")
        for i in at_a:
            first = np.searchsorted(runs[1], runs[0][i], sorter=order)
            for j in order[first:]:
                if runs[1][j] != runs[0][i]:
                    break
                if a[i : i + size] == b[j : j + size]:
                    return True
        return False

    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if shared(middle) else (low, middle - 1)
    return low


def overlap(needle: Column, body: Column) -> Column:
    """The longest common substring's share of the needle."""

    def ratios(needles: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([longest_common_run(n, b) / len(n) if n else 0.0 for n, b in zip(needles, bodies, strict=True)])

    ratios.__annotations__ = {"needles": pd.Series, "bodies": pd.Series, "return": pd.Series}
    return F.pandas_udf(ratios, T.DoubleType())(needle, body)


def matched(selections: DataFrame, paragraphs: DataFrame, selection_id: str = "selection_id", anchor: str = "anchor", book: str = "book") -> DataFrame:
    """selection_id, anchor, ratio: the paragraph on the selection's page or two on either side that holds most of it. Pages beside count half.
    selections: selection_id, book, page, needle; paragraphs: anchor, book, page, text."""
    offsets = F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(1.0 if o == 0 else 0.5).alias("weight"), F.lit(i).alias("turn")) for i, o in enumerate((0, -1, 1, -2, 2))])
    asked = selections.withColumn("form", X.loose_match_form(F.col("needle"))).where(F.length("form") >= K.SELECTION_CHARS)
    near = asked.select(selection_id, book, "form", F.col("page").alias("own"), F.explode(offsets).alias("o")).select(selection_id, book, "form", (F.col("own") + F.col("o.offset")).alias("page"), "o.weight", "o.turn")
    held = paragraphs.select(F.col(anchor), book, "page", X.loose_match_form(F.col("text")).alias("body"))
    # No other can be chosen: what holds less of the needle than counts for something is left out by runs of the needle, of which a body that shares
    # twice as many characters in a row holds one whole.
    size = F.greatest(F.floor(F.ceil(F.length("form") * F.col("least") - 1e-9) / 2), F.lit(1)).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.length("form") / size).cast("int") - 1), lambda i: F.substr(F.col("form"), i * size + 1, size))
    near = near.withColumn("least", K.SELECTION_RATIO * 0.5 / F.col("weight")).withColumn("runs", runs)
    both = held.join(small(near), [book, "page"]).where(F.exists("runs", lambda run: F.contains(F.col("body"), run))).drop("runs", "least")
    exact = F.contains("body", "form")
    scored = both.where(exact).withColumn("ratio", F.lit(1.0)).unionByName(both.where(~exact).withColumn("ratio", overlap(F.col("form"), F.col("body")))).where("ratio > 0")
    best = scored.groupBy(selection_id).agg(F.max_by(F.struct(anchor, "ratio"), F.struct(F.col("ratio") * F.col("weight"), F.length("body"), -F.col("turn"))).alias("b"))
    return best.select(selection_id, f"b.{anchor}", "b.ratio").where(F.col("ratio") >= K.SELECTION_RATIO)


def current_page(visible: DataFrame, group: str = "session") -> DataFrame:
    """group, page: the page most in view, the first of several."""
    return visible.groupBy(group).agg(F.max_by("page", F.struct("ratio", -F.col("page"))).alias("page"))


def page_anchors(paragraphs: DataFrame, book: str = "book") -> DataFrame:
    return paragraphs.groupBy(book, "page").agg(F.array_sort(F.collect_list("anchor")).alias("anchors"))
