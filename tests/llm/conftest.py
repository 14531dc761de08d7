import os

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

#: documents with further columns whose names the operators use inside.
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     *[T.StructField(c, T.StringType()) for c in ("key", "row", "digest", "h", "fp", "position", "keep_id", "words")]])

PASSAGE = " ".join(f"w{k}" for k in range(70))
EDGE = [
    (9001, None, "en", "a"), (9002, "", "en", "a"), (9003, "   \t\n ", None, None), (9004, "12345 !!! 678", "de", "a"),
    (9005, "one", "en", "b"), (9006, "one", "en", "b"), (9006, "one", "en", "b"), (9007, "One", "fr", "b"),
    (9008, "naïve café Übergröße 日本語 😀 ▁x  y\r\n\tz", "fr", None), (9009, PASSAGE, "en", "c"),
    (9010, "before " + PASSAGE + " after", "en", "c"), (9011, "x " + PASSAGE + " " + PASSAGE, None, "c"),
    (None, PASSAGE, "en", "c"), (None, None, None, None), (9012, "long " * 3000 + "x" * 4000, "en", "hot"),
    (9013, PASSAGE, "en", "c"), (9014, " ".join(f"w{k}" for k in range(49)), "en", "c"),
    (-5, "negative id and the quick brown fox", "en", "c"), (9015, "idiot the of and", "en", "c"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), *["clash"] * 8) for i, t, lang, s in EDGE]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def docs(spark, edge_docs):
    if not os.path.isdir(SF):
        return edge_docs.cache()
    return spark.read.parquet(f"{SF}/documents.parquet").unionByName(edge_docs, allowMissingColumns=True).repartition(5).cache()


@pytest.fixture(scope="session")
def doc_rows(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
