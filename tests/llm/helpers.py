"""Awkward tables and plain reference loops."""

import re

from pyspark.sql import functions as F

GAP = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in GAP.split(text or "") if w]


def documents(spark, rows):
    """(doc_id, text, lang, source, n_chars) from (doc_id, text, source)."""
    data = [(i, t, None, s, len(t) if t is not None else None) for i, t, s in rows]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long"
    )


#: Null and empty texts, blanks, a long line, other scripts, ties and repeats.
ODD = [
    (1, None, "a"),
    (2, "", None),
    (3, " \t\n ", "b"),
    (4, "one", "a"),
    (5, "word " * 3000, "a"),
    (6, "ünï code Ünï\ncode\ncode", None),
    (7, "Same text here for two rows", "b"),
    (8, "same TEXT here for two rows", "b"),
    (9, "x" * 50_000, "c"),
    (10, "###! *** $$$ <|> " * 40, "c"),
]


def clashing(df):
    """The table with columns named like the ones operators make."""
    for name in ("score", "n_words", "kept", "_words", "size", "_key", "_part", "label", "n", "id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


class Groups:
    def __init__(self):
        self.parent = {}

    def find(self, a):
        self.parent.setdefault(a, a)
        while self.parent[a] != a:
            a = self.parent[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
