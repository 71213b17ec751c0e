"""Small tables with nulls, empty and very long texts, ties, repeats and clashing column names."""

import random

from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars int, kept boolean, score double, row string, span string"


def docs(spark, texts, first_id=0):
    rows = [(first_id + i, t, "en", f"src{i % 3}", None if t is None else len(t), None, 0.5, "r", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def texts(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "tion", "Éaux", "keit", "señor", "it's", "naïve", "x1", "42", "…", "a_b", "don't", "日本", "😀ok"]
    out = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 80))) for _ in range(n)]
    return [*out, None, "", " \n\t ", out[0], out[0], out[1] + " \n", "\n".join(out[:4] * 2), " ".join(out) * 40]


def with_odd_rows(spark, frame):
    """Also a row without a doc_id and a row given twice."""
    extra = frame.limit(1)
    nulls = spark.createDataFrame([(None, "no id here at all, none", None, None, None, None, None, None, None)], DOCS)
    return frame.unionByName(extra).unionByName(nulls)


def labels(spark, rows):
    return spark.createDataFrame(rows, T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "quality", "toxic")]))
