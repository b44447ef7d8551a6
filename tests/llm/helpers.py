"""Rows with nulls, empty and long texts, ties, repeated rows and columns of odd names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, spans string, kind int, `__row_id` long, score double, vs string, `count` long"


def documents(spark, rows, path=None):
    """rows: (doc_id, text) or (doc_id, text, lang). Through Parquet, so that it is a plain scan."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "src0", None if r[1] is None else len(r[1]), k, "x", 1, -k, 0.5, "y", k) for k, r in enumerate(rows)]
    df = spark.createDataFrame(full, SCHEMA)
    if path is None:
        return df
    df.coalesce(2).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly mix some very old potions in the cellar".split()


def odd_rows():
    long = " ".join(WORDS[(k * 7 + k // 5) % len(WORDS)] + str(k % 31) for k in range(30_000))
    text = " ".join(WORDS * 3)
    return [(1, text), (2, text), (2, text), (None, text), (None, None), (3, None), (4, ""), (5, " \n\t "), (6, "a"), (7, "mail me@x.example.com or +1 (988) 555-2485 at 10.0.0.1"), (8, long), (9, long + " x"), (10, "1234 5678"), (None, "ünï çødé ▁   \x00 end"), (11, "!!! 123"), (12, text.upper())]
