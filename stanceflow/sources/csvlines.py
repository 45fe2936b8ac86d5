"""CSV files with line breaks inside quoted fields, read by many tasks.

Spark splits such a file only if a record is a line. Here the file is read as
lines, split as usual, and the lines are put together again: a line starts a
record if the number of quotes before it in its file is even. That number is the
sum of the counts of all earlier splits (one row per split) and a running sum
inside the line's own split. Records of one line, nearly all, go straight on to
the parser; only the lines of longer records are grouped by their record.

Quotes are those of RFC 4180: a field with a quote in it is quoted, and the quote
doubled. A file with an odd number of quotes raises an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv_records(spark: SparkSession, path: str, encoding: str = "UTF-8", quote: str = '"') -> DataFrame:
    """file, block (where the split starts), line (a number that grows inside a
    split), record (its text, without the line end): one row per record.
    ``encoding``: any that holds ASCII as it is."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.decode(F.col("value").cast("binary"), encoding).alias("value"))
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit(quote), F.lit("")))
    lines = lines.withColumn("odd", quotes % 2)
    every = Window.partitionBy("file")
    earlier = every.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("odd").alias("odd")) \
        .withColumn("open", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2) \
        .withColumn("bad", F.sum("odd").over(every) % 2 == 1) \
        .select("file", "block", "open", "bad")
    inside = Window.partitionBy("file", "block").orderBy("line")
    before = F.coalesce(F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    checked = F.when(F.col("bad"), F.raise_error(F.concat(F.lit("a quote is not closed in "), F.col("file"))).cast("long")) \
        .otherwise(F.col("open"))
    marked = lines.join(blocks, ["file", "block"]).withColumn("before", (checked + before) % 2) \
        .withColumn("starts", F.col("before") == 0) \
        .withColumn("start", F.last(F.when(F.col("starts"), F.col("line")), ignorenulls=True).over(
            inside.rowsBetween(Window.unboundedPreceding, 0)))
    alone = F.col("starts") & (F.col("odd") == 0)
    parts = marked.where(~alone)
    # the first lines of a split may belong to a record of an earlier one
    last = marked.groupBy("file", "block").agg(F.max("start").alias("start"))
    carried = last.withColumn("carried", F.last(F.when(F.col("start").isNotNull(), F.struct("block", "start")),
                                                ignorenulls=True).over(earlier)).select("file", "block", "carried")
    key = F.when(F.col("start").isNotNull(), F.struct("block", "start")).otherwise(F.col("carried"))
    longer = parts.join(carried, ["file", "block"]).withColumn("key", key).groupBy("file", "key").agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("lines")) \
        .select("file", F.col("key.block").alias("block"), F.col("key.start").alias("line"),
                F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"))
    single = marked.where(alone).select("file", "block", "line", F.col("value").alias("record"))
    return single.unionByName(longer).withColumn("record", F.regexp_replace("record", "\r$", "")) \
        .where(F.octet_length("record") > 0)


def read_split_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", header: bool = True) -> DataFrame:
    """All columns as strings, named by the first file's header (``_c0``, ... without
    one): the rows of ``spark.read.csv`` with ``multiLine``, in no particular order."""
    names = spark.read.option("header", header).option("escape", '"').option("encoding", encoding).csv(path).columns
    rows = csv_records(spark, path, encoding)
    if header:
        heads = rows.groupBy("file").agg(F.min(F.struct("block", "line")).alias("_head"))
        rows = rows.join(heads, "file").where(F.struct("block", "line") != F.col("_head"))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = rows.select(F.from_csv("record", F.lit(schema), {"escape": '"'}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
