"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash with those of operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, uid long, score double"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), "k", 1, 0.5) for d, t in rows], DOCS)


LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "one two"), (4, "one two"), (None, "one two"), (5, LONG), (6, "é" * 5000), (7, "a\x00b c"), (None, None)]
