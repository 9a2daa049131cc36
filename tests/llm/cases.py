"""Documents that every operator must take: nulls, empty and long texts, repeats, extra columns with clashing names."""

LONG = "lorem ipsum dolor sit amet " * 4000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, shard string, `clean` int"


def odd_documents(spark):
    plain = "The quick brown fox jumps over the lazy dog and runs far away from the big bad wolf today"
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "b"),
        (3, " \t\n ", None, None),
        (4, plain, "en", "a"),
        (4, plain, "en", "a"),
        (5, plain, "en", None),
        (None, plain + " indeed", "en", "b"),
        (None, None, None, None),
        (6, LONG, "la", "c"),
        (7, "12 34 !!", "en", "c"),
        (8, "word", "en", "d"),
        (9, "\x00 nul é日本 <|im_end|>", "xx", "d"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", "y", 3) for r in rows], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
