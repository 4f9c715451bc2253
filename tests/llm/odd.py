"""Small tables with what can go wrong, for every operator."""

from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, size string, digest string, row_no string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    """n words that hardly repeat between seeds."""
    return " ".join(f"{WORDS[(seed * 7 + i * (seed % 5 + 1)) % 24]}{(seed * 31 + i * 17) % 97}" for i in range(n))


def docs(spark, rows):
    """Rows are (doc_id, text, lang, source); the extra columns clash with names operators use."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "b", "s", "d", "r") for r in rows], SCHEMA)


def odd_rows():
    copy = prose(5, 60)
    return [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, "   \n\t ", None, None),
        (4, copy, "en", "b"),
        (5, copy, "en", None),
        (5, copy, "en", None),
        (6, copy.upper(), "de", "b"),
        (7, "one two", "en", "c"),
        (8, "1234 !!! ...", "en", "c"),
        (9, prose(9, 30_000), "fr", "c"),
        (10, "naïve cafe\u0301 ﬁn 日本語 \U0001f600", "fr", "d"),
        (None, "a row without an id", "en", "d"),
        (None, None, None, None),
        (12, "bell\x07 and\x1fodd\x00 marks <|endoftext|>", "en", "a\x00b"),
        (13, "x" * 50_000, "en", "a"),
    ]


def odd_docs(spark):
    return docs(spark, odd_rows())


def no_docs(spark):
    return docs(spark, [])


def check_types(df, **kinds):
    """The result's columns have the types the contract names."""
    found = {f.name: f.dataType for f in df.schema}
    for name, kind in kinds.items():
        assert found[name] == getattr(T, kind)(), name
