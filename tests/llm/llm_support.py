"""Rows that every operator must take: nulls, empty and long texts, repeated rows, clashing column names."""

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "lorem ipsum dolor sit amet " * 12_000


def hard_rows():
    return [
        (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, LONG, "en", "a", len(LONG)),
        (4, LONG, "en", "a", len(LONG)), (4, "other text with the same id", "fr", "b", 27), (None, "no id here at all", None, "b", 17),
        (5, "one", None, "b", 3), (6, "one", "fr", "b", 3), (7, "ünï cödé 😀 ßtraße", "de", "c", 17), (8, "123 456 !!", "de", "c", 10),
    ]


def hard_docs(spark):
    """The rows with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(hard_rows(), DOCS)
    names = "size score bits key node comp digest bands copy block shard slot words row term position chunk kept spans start end _copy2 "
    names += "_id _digest _copy _m _g _r _hits _words _kid _kd _general _removed _text _rest _s _source turn runs first rest"
    names = names.split()
    return df.withColumns({n: F.lit("x") for n in names})


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
