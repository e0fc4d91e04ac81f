"""Small tables with every kind of awkward row."""

LONG = ("alpha beta gamma delta " * 30_000).strip()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, x string, key string, fp long"


def documents(spark, rows=None):
    """Nulls, empty and long texts, ties, repeated rows, and further columns with names that operators use themselves."""
    rows = rows if rows is not None else [
        (1, "The quick brown fox jumps over the lazy dog and runs away from it all day", "en"),
        (2, "the quick brown fox jumps over the lazy dog and runs away from it all day", "en"),
        (2, "the quick brown fox jumps over the lazy dog and runs away from it all day", "en"),
        (3, None, None),
        (4, "", "de"),
        (5, "  \n\t ", None),
        (6, "... !!! 123", "fr"),
        (7, LONG, "en"),
        (8, "un deux trois é è ç œuvre à la maison", "fr"),
        (None, "a row without an id", "en"),
        (10, "mail ann.lee@example.org or +1 (476) 555-6291, card 4539578763621486, 10.20.30.40 <|endoftext|> end", None),
    ]
    return spark.createDataFrame([(*r, None, None, "x", None, 7) for r in rows], SCHEMA)


def nothing(spark):
    return documents(spark, [])
