"""Rows and brute-force forms shared by the tests of this folder."""

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def frame(spark, rows, extra=False):
    """doc_id, text (+ lang, source, n_chars and columns whose names clash)."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    full = [(i, t, None, None, None, "b", "k", 1) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "blob_id string, fp string, weight int")


EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "A b c A b c"), (6, "A b c A b c"),
         (7, "word " * 30_000), (None, "no key here"), (8, "\U0001f600 é ß\r\nx\x0by")]
