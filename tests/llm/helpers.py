"""Small inputs and plain reference computations shared by the tests."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"wort{i % 977} text" for i in range(40_000))


def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    return [
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 10),
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 10),
        (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \t\n", "fr", "b", 3),
        (None, "no id here but some words", "en", "b", 5), (None, None, None, None, None),
        (5, LONG, "de", None, len(LONG)), (6, "1234 5678 --", "en", "a", 12), (7, "a", "fr", "a", 1),
        (8, "The quick brown fox jumps over the lazy dog again and again!", "en", "c", 10),
        (9, "Zeile eins\nZeile zwei\nZeile eins", "de", "c", 30),
    ]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def clashing(df):
    """The same rows with extra columns that have the names operators add."""
    from pyspark.sql import functions as F
    names = ["fingerprint", "component_id", "score", "predicted", "lang_pred", "languages", "size", "target",
             "taken", "repeats", "shard", "slot", "law", "root", "fp", "_body", "_uid", "_h", "_fp", "_id"]
    return df.select("*", *[F.lit(f"x-{n}").alias(n) for n in names])
