"""Mixing of sources to target weights, in DataFrame and SQL functions only.

Targets come from water-filling over the sources. A document gets floor(target / source size) complete epochs; the rest
of the target is filled by Efraimidis-Spirakis sampling: the exponential key -ln(u) / quality is sorted within the
source, and sizes are prefix-summed to the budget. The prefix sum is done in three levels: sizes are summed by source and coarse place
of the key, then by fine place within the coarse one where the budget ends, and only the rows of that fine place are sorted, some
hundred-thousandths of a source. So a source with a third of all rows is no larger a task than others; what
decides on a row is its key and one row of its source, which is broadcast. The gap that the prefix leaves goes to the one
remaining document of the source whose size fits it best, or stays where none fits better than nothing.

Defined results: null or empty text has size 0 and takes 0; a null source is a source of its own, the last; u depends on
doc_id and text alone, so reruns agree; repeated rows (same id and text) are taken equally often; where all
sizes are 0 every target is 0; an empty table gives an empty table; further columns are kept by mixed() alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut, small

#: Weights of the sources in code-point order, repeated.
WEIGHTS = (1, 2, 3)
#: A target stops at this many times its source's size.
MOST_EPOCHS = 3
#: Coarse places of the keys grow by this factor from one to the next, and each is cut into so many fine ones.
COARSE, FINE = 1.05, 1024

_WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """A number between 0 and 1, both excluded, from md5 of the id and the text."""
    mark = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))).cast("binary"))
    return (F.conv(F.substring(mark, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def quality_of(text: Column, size: Column) -> Column:
    """A weight from 0.5 to 1 by the mean length of the words, which is far off the usual for boilerplate and for noise."""
    mean = (F.length(text) / F.greatest(size, F.lit(1))).cast("double")
    return F.coalesce(F.lit(0.5) + F.lit(0.5) / (F.lit(1.0) + F.abs(mean - F.lit(6.0)) / F.lit(6.0)), F.lit(0.5))


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> with weight, target. One row a source; water-filling by sorting sources by cap / weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    weighed = (
        sources.withColumn("weight", F.element_at(weights, ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("cap", (F.col("source_size") * MOST_EPOCHS).cast("double"))
        .withColumn("level", F.col("cap") / F.col("weight"))
    )
    # At the water level L every source gets min(cap, L * weight). Of the sources sorted by level, those before some place are capped.
    before = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    tried = weighed.withColumn("water", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    water = F.max(F.when(F.col("water") <= F.col("level"), F.col("water"))).over(everything)
    return tried.withColumn("target", F.least(F.col("cap"), F.coalesce(water * F.col("weight"), F.col("cap")))).select("source", "source_size", "weight", "target")


def _keyed(docs: DataFrame, text_col: str, id_col: str, quality: Column | None) -> tuple[Column, Column]:
    """(size, key) of each row of docs."""
    text = F.col(text_col)
    size = size_of(text)
    return size, -F.log(uniform(F.col(id_col), text)) / (quality if quality is not None else quality_of(text, size))


def _coarse(key: Column) -> Column:
    """The place of a key on a logarithmic scale: it grows with the key, and however qualities are spread no place holds many more keys than another."""
    return F.floor(F.log(key) / F.lit(math.log(COARSE))).cast("int")


def _fine(key: Column) -> Column:
    """The place of a key among FINE within its coarse one."""
    low = F.pow(F.lit(COARSE), _coarse(key))
    return F.greatest(F.lit(0), F.least(F.lit(FINE - 1), F.floor((key - low) / (low * F.lit(COARSE - 1.0)) * FINE))).cast("int")


def _crossing(thin: DataFrame, goals: DataFrame, place: Column, name: str) -> DataFrame:
    """goals with the place where the prefix of thin's rows passes the budget (null if it never does), and what lies before it.
    Rows are summed by source and place before they are shuffled; a source has few places."""
    summed = thin.groupBy("named", "no_source", place.alias(name)).agg(F.sum("size").alias("held"))
    run = Window.partitionBy("named", "no_source").orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = summed.join(small(goals.select("named", "no_source", "budget", "before")), ["named", "no_source"]).withColumn("upto", F.col("before") + F.sum("held").over(run))
    inside, out = F.col("upto") <= F.col("budget"), F.col("upto") > F.col("budget")
    passed = upto.groupBy("named", "no_source").agg(F.max(F.when(inside, F.col("upto"))).alias("within"), F.min(F.when(out, F.col(name))).alias(name))
    known = goals.drop("within", name).join(passed, ["named", "no_source"], "left")
    return cut(known.withColumn("before", F.coalesce("within", "before")).drop("within"))


def _goals(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality: Column | None) -> tuple[DataFrame, DataFrame]:
    """(thin: doc_id, source, named, no_source, size, key of every row; goals: one row a source, with the key from which on its rows are
    out, and the key of the document that fills the gap)."""
    size, key = _keyed(docs, text_col, id_col, quality)
    # A null source is told apart by a flag, so that joins are plain equi-joins.
    source = F.col(source_col).cast("string")
    thin = cut(docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("named"), size.alias("size"), key.alias("key")))
    goals = (
        targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")))
        .withColumn("no_source", F.col("source").isNull())
        .withColumn("named", F.coalesce("source", F.lit("")))
        .drop("source")
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("int"))
        .withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
        .withColumn("before", F.lit(0).cast("long"))
    )
    goals = _crossing(thin, cut(goals), _coarse(F.col("key")), "coarse")

    def at(*places: str) -> DataFrame:
        """The rows of thin at the places where their source's prefix passes its budget."""
        here = thin.withColumn("coarse", _coarse(F.col("key"))).withColumn("fine", _fine(F.col("key")))
        return here.join(small(goals.select("named", "no_source", *places)), ["named", "no_source", *places], "left_semi")

    goals = _crossing(at("coarse"), goals, F.col("fine"), "fine")
    # Of the few rows left, rows of one key (repeated rows) are taken or left together.
    goals = _crossing(at("coarse", "fine"), goals, F.col("key"), "out").withColumn("gap", F.col("budget") - F.col("before"))
    off = F.abs(F.col("size") - F.col("gap"))
    free = thin.join(small(goals.select("named", "no_source", "out", "gap")), ["named", "no_source"]).where((F.col("key") >= F.col("out")) & (off < F.col("gap")))
    best = free.groupBy("named", "no_source").agg(F.min(F.struct(off.alias("off"), F.col("key").alias("key"))).getField("key").alias("filler"))
    # Repeated rows of that key would be taken together, so they must fit together.
    met = thin.join(small(best), ["named", "no_source"]).where(F.col("key") == F.col("filler")).groupBy("named", "no_source", "filler").agg(F.sum("size").alias("filled"))
    goals = goals.join(small(cut(met)), ["named", "no_source"], "left")
    fits = F.abs(F.col("filled") - F.col("gap")) < F.col("gap")
    return thin, cut(goals.select("named", "no_source", "source_size", "target", "epochs", "out", F.when(fits, F.col("filler")).alias("filler")))


def _copies(key: Column, epochs: Column, out: Column, filler: Column) -> Column:
    """How often a row is taken, by its key and its source's goals."""
    extra = out.isNull() | (key < out) | F.coalesce(key == filler, F.lit(False))
    return epochs + F.when(epochs >= MOST_EPOCHS, 0).otherwise(extra.cast("int"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source for every row."""
    thin, goals = _goals(docs, id_col, text_col, source_col, quality)
    planned = thin.join(small(goals), ["named", "no_source"]).withColumn("copies", _copies(F.col("key"), F.col("epochs"), F.col("out"), F.col("filler")).cast("long"))
    return planned.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None) -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken, all columns kept. Keys are computed again from the texts, so no text is shuffled."""
    _, goals = _goals(docs, id_col, text_col, source_col, quality)
    source = F.col(source_col).cast("string")
    _, key = _keyed(docs, text_col, id_col, quality)
    names = {c: f"__goal_{c}" for c in goals.columns}
    met = docs.withColumn("__key", key).withColumn("__named", F.coalesce(source, F.lit(""))).withColumn("__no_source", source.isNull())
    aside = small(goals.select(*[F.col(c).alias(n) for c, n in names.items()]))
    met = met.join(aside, (F.col("__named") == F.col("__goal_named")) & (F.col("__no_source") == F.col("__goal_no_source")))
    copies = _copies(F.col("__key"), *[F.col(names[c]) for c in ("epochs", "out", "filler")])
    return met.withColumn("__copies", copies).where(F.col("__copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
