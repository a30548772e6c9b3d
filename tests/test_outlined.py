"""Books dealt to parts of a few lines against the same in one part, and what is written on the way."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import joins, prefix, structure

#: Of each book its lines' levels; a blank line has none.
BOOKS = {
    1: [0, 0, 0, 0, 1, 0, 2, 0, 0, 0, 0, 0, 0, 1, 1, None, 0, 3, 0, 1],
    2: [1, 1, 1, 2, 0, None, None, None, None, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    3: [2, 0, 1, 0, 2, 0, 1, 2, 0, 0, 0, 2],
    4: [0] * 7,
    5: [None] * 4,
    None: [0, 1, 0, 0, 0, 0, 1, 0],
}


def book_rows(spark):
    rows = [(b, i, "" if level is None else f"  line {i} of {b} {'x' * (37 * i % 900)}", level or 0) for b, levels in BOOKS.items() for i, level in enumerate(levels)]
    rows += [(6, i, t, 0) for i, t in enumerate(["before", "Chapter 1 A", "one", "1.2 Part", "two", "", "Chapter 2 B", "x^2 = y", "three", "four", "five"])]
    return spark.createDataFrame(rows, "book long, pos int, text string, level int")


def plainly(spark):
    """What assembled has to give, row by row."""
    shown, by_book = [], {}
    for b, pos, text, level in sorted(book_rows(spark).collect(), key=lambda r: (str(r[0]), r[1])):
        by_book.setdefault(b, []).append((text.strip(), level))
    least = {r["book"]: r["chapter_level"] for r in structure.outline_levels(book_rows(spark)).collect()}
    for b, lines in by_book.items():
        chapter, chars, top = 0, 0, least[b]
        dealt = []
        for text, level in lines:
            if not text or (top is not None and 1 <= level < top):
                continue
            starts = text.startswith("Chapter") if top is None else level == top
            chapter += starts
            dealt.append((max(chapter, 1), starts, text))
        titles = {c: t for c, starts, t in dealt if starts}
        seqs = {}
        for c, starts, text in dealt:
            if not starts:
                seqs[c] = seqs.get(c, 0) + 1
                shown.append((b, list(seqs).index(c) + 1, titles.get(c, ""), seqs[c], 1 + chars // 1200, text))
                chars += len(text)
    return sorted(map(repr, shown))


def told(found):
    return sorted(repr(tuple(r)) for r in found.select("book", "num", "title", "seq", "page", "text").collect())


@pytest.mark.parametrize("part", [1, 3, 8192])
def test_parts_of_a_book_know_what_came_before(spark, part):
    rows = book_rows(spark)
    found = structure.assembled(rows, part=part)
    assert told(found) == plainly(spark)
    assert told(structure.assemble(structure.blocks(rows, part=part), part=part)) == plainly(spark)


def test_levels_may_be_given_for_some_books(spark):
    levels = spark.createDataFrame([(3, 1), (6, None)], "book long, chapter_level int")
    found = structure.blocks(book_rows(spark), levels, part=2)
    assert {r["book"] for r in found.collect()} == {3, 6}


def test_texts_are_not_written_on_the_way(spark, sf_dir, monkeypatch):
    """Six times 1 GB of documents did not fit the disk while every step of markdown_export wrote all texts."""
    from lectern.plans import lifecycle

    written = []

    def cut(df):
        written.append(df.columns)
        return joins.cut(df)

    for module in (structure, prefix):
        monkeypatch.setattr(module, "cut", cut)
    found = lifecycle.markdown_export(spark, sf_dir)
    assert written and not [c for columns in written for c in columns if c in ("text", "title", "raw")]
    assert found.agg(F.count_if(F.col("markdown").startswith("# "))).first()[0] == found.count()
