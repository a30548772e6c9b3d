"""Requests as rows: those that hold their constraints, and the others with the first that fails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import constants as K
from lectern.functions import text as X

#: Fields by request: least and most characters, numbers, or values (fixed values).
RULES: dict[str, dict[str, tuple]] = {
    "ask": {"book_id": ("text", 1, 200), "question": ("text", 1, 2000), "selection": ("text", 0, 4000)},
    "note": {"book_id": ("text", 1, 200), "chapter_id": ("text", 1, 200), "body": ("text", 1, 4000)},
    "quiz": {"question_id": ("text", 1, 200), "choice": ("number", 0, 9)},
    "progress": {"mastery": ("number", 0, 100)},
    "event": {"kind": ("one of", K.EVENT_KINDS)},
}


def failing(kind: str) -> Column:
    """The name of the first field that breaks its rule; null where all hold."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for field, rule in RULES[kind].items():
        if rule[0] == "text":
            size = F.length(X.strip(F.coalesce(F.col(field), F.lit(""))))
            out = out.when((size < rule[1]) | (size > rule[2]), field)
        elif rule[0] == "number":
            out = out.when(F.col(field).isNull() | ~F.col(field).between(rule[1], rule[2]), field)
        else:
            out = out.when(~F.coalesce(F.col(field).isin(*rule[1]), F.lit(False)), field)
    return out


def only_known(update: DataFrame, fields: Sequence[str] = K.TASK_FIELDS, key: str = "id") -> DataFrame:
    """update, if it sets no other fields than these of what its key names; a ValueError otherwise."""
    if unknown := sorted(set(update.columns) - {key, *fields}):
        raise ValueError(f"unknown fields: {unknown}")
    return update


def checked(requests: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with field)."""
    marked = requests.withColumn("field", failing(kind))
    return marked.where(F.col("field").isNull()).drop("field"), marked.where(F.col("field").isNotNull())
