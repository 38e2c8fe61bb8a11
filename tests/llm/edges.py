"""Tables with everything that an operator must bear."""

from pyspark.sql import functions as F

CLASHING = ["keep", "score", "h", "fp", "rid", "label", "stratum", "broken", "shares", "spans", "toxicity", "bin_id", "quality", "toxic", "root", "n", "group_id", "shard", "text2", "size", "hit"]
LONG = "lorem ipsum dolor sit amet " * 8000
DOCS = [
    (1, "A plain text about the river and its banks.", "en", "s", 43),
    (2, None, "en", "s", None),
    (3, "", "en", None, 0),
    (4, " \n\t ", None, "s", 4),
    (None, "A plain text without an id, of its own.", "en", "s", 30),
    (None, None, None, None, None),
    (5, LONG, "en", "s", len(LONG)),
    (6, "x" * 50_000, "en", "s", 50_000),
    (1, "A plain text about the river and its banks.", "en", "s", 43),
    (7, "çà et là — 多字节 🙂 \x00 tab\tand\r\nreturn", "fr", "s", 36),
    (8, "token = \"0123456789abcdef0123\" for a@b.example.com", "en", "s", 50),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=DOCS):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def labels(spark, rows=((1, 1, 0), (5, 0, None), (6, None, 1), (None, 1, 1), (1, 1, 0), (8, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int").withColumn("label", F.lit("clash")).withColumn("text", F.lit("clash"))


def rows(df):
    return [tuple(r) for r in df.collect()]
