"""Small tables with everything that an operator must bear, written as Parquet like the real ones."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = {"score": 1.5, "size": 3, "n": 7, "held_out": True, "copies": 9, "rank": 2, "label": 4, "comp": 5, "_q": 1, "word": "x", "fp": "y"}

LONG = " ".join(f"word{k % 977} next{k % 31}" for k in range(30_000))


def edge_rows() -> list[tuple]:
    """doc_id, text, lang, source, n_chars."""
    t = "the quick brown fox jumps over the lazy dog and runs away from the old house by the sea"
    return [
        (1, "", "en", "a", 0),
        (2, None, None, None, None),
        (3, "one", "en", "a", 3),
        (4, LONG, "en", "b", len(LONG)),
        (5, t, "en", "a", len(t)),
        (5, t, "en", "a", len(t)),
        (6, t, "en", "b", len(t)),
        (7, t.upper(), "en", None, len(t)),
        (8, "12345 !!! ... 67", "de", "c", 16),
        (9, "  double  spaces\n\n\nand\ttabs \x1c \x85 \xa0 end ", "en", "c", 40),
        (10, "ünïcode 日本語 🙂🙂 test's we'll <|endoftext|> x" + "a" * 700, "fr", "c", 700),
        (11, " ".join(["same"] * 5000), "fr", "b", 25000),
        (None, "a row without an id", "en", "a", 19),
    ]


def documents(spark: SparkSession, rows: list[tuple] | None = None, extra: bool = True) -> DataFrame:
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows() if rows is None else rows, DOCS)
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()}) if extra else df


def write(spark: SparkSession, root: str, **tables: DataFrame) -> str:
    for name, df in tables.items():
        df.coalesce(2).write.mode("overwrite").parquet(os.path.join(root, f"{name}.parquet"))
    return str(root)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()
