"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeated rows, further columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, size long, row long, bucket int, key string, node string"
LONG = " ".join(f"word{i % 977} runs{i % 31}" for i in range(20_000))


def table(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); the further columns clash with names that operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None, 9.5, False, -1, -2, 7, "k", "n") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


EDGES = [
    (3, None, None, None),
    (1, "", "en", "a"),
    (2, "same text here and there again", "en", "a"),
    (5, "same  text\there and there again", "en", "b"),
    (4, "same text here and there again", None, "b"),
    (4, "same text here and there again", None, "b"),
    (9, " \n\t ", "de", "b"),
    (7, LONG, "en", None),
    (None, "a row without an id", "en", "a"),
    (8, "12 34 !? 56", "fr", ""),
]
