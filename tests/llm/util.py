"""Small inputs with the awkward cases that every operator must take."""

from __future__ import annotations

import pandas as pd

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, cls string, text_hash string, score string"


def documents(spark, rows):
    """rows: (doc_id, text, lang). Further columns bear names that the operators use themselves."""
    full = [(i, t, g, "src0", None if t is None else len(t), "x", "y", "z", "w") for i, t, g in rows]
    return spark.createDataFrame(full, DOCS)


AWKWARD = [
    (1, None, None),
    (2, "", "en"),
    (3, " \n\t ", "en"),
    (None, "a row without id and some words in it", "en"),
    (5, "the same row twice over, the same row", "en"),
    (5, "the same row twice over, the same row", "en"),
    (6, "é" * 50 + " ünïcödé ß 漢字 \U0001f600 words", "fr"),
    (7, "0123 456 789", None),
    (8, "long " * 60_000, "en"),
    (-9, "x", "de"),
]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def pandas(df) -> pd.DataFrame:
    return df.toPandas()
