"""Sources (S1-S8): labelled CSV, nested aspect JSON, literal-list cells,
generation files, split loading and vector tables.

Readers never infer schemas from data (a second pass over large inputs);
columns are taken by position and renamed, as the reference does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanceflow.sources.csvlines import read_split_csv

GENERATION_COLUMNS = ("Tweet", "Target", "GT Stance", "Prompt", "Generated Text", "Generated Stance")
ASPECT_JSON_SCHEMA = "raw_words string, aspects array<struct<term: array<string>, polarity: string>>"
ASPECT_CELL_SCHEMA = "array<struct<term: string, polarity: string>>"
# The sentinel of a literal-list cell that holds no aspect.
NO_ASPECT_TERM, NO_ASPECT_POLARITY = "noaspectterm", "none"


def read_labelled_csv(spark: SparkSession, path: str, names: Sequence[str] = ("text", "target", "stance"),
                      encoding: str = "ISO-8859-1", aux_col: str | None = "target_id",
                      multiline: bool | str = False) -> DataFrame:
    """S1 + S2: columns 0..len(names)-1 by position, renamed; the optional
    next column becomes ``aux_col`` (int), else the constant 1. Files are split
    among tasks; for files with line breaks inside quoted fields set ``multiline``:
    "split" keeps large files split (``csvlines``), True takes one task per file. A path that ends in .jsonl or
    .parquet is read as that format, by column position too."""
    if path.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(path)
    elif path.rstrip("/").endswith(".jsonl"):
        raw = spark.read.json(path)
    elif multiline == "split":
        raw = read_split_csv(spark, path, encoding)
    else:
        raw = (spark.read.option("header", True).option("encoding", encoding).option("escape", '"')
               .option("multiLine", multiline).csv(path))
    cols = raw.columns
    if len(cols) < len(names):
        raise ValueError(f"{path}: {len(cols)} columns, need {len(names)}")
    out = [F.col(f"`{cols[i]}`").alias(n) for i, n in enumerate(names)]
    if aux_col:
        if len(cols) > len(names):
            out.append(F.col(f"`{cols[len(names)]}`").cast("int").alias(aux_col))
        else:
            out.append(F.lit(1).alias(aux_col))
    return raw.select(*out)


def read_aspect_json(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Nested aspect documents {raw_words, aspects[{term[], polarity}]}, one per
    line; ``array`` for a file that is one JSON array (one task per file)."""
    return spark.read.schema(ASPECT_JSON_SCHEMA).option("multiLine", array).json(path)


def read_dictionary_json(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON object {slang: expansion} -> (slang,
    expansion); dictionaries are read whole, file by file."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,string>")
    return text.select(F.explode(entries).alias("slang", "expansion"))


def read_dictionary_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``slang<TAB>expansion`` (no quoting, no header)."""
    return spark.read.schema("slang string, expansion string").option("sep", "\t").option("quote", "") \
        .option("ignoreTrailingWhiteSpace", True).csv(path).where(F.col("slang").isNotNull())


def flatten_aspects(df: DataFrame, raw: str = "raw_words", aspects: str = "aspects",
                    keep: Sequence[str] = ()) -> DataFrame:
    """S3: one row per (document, aspect) with the term words joined by a
    space; documents without aspects give no rows."""
    ex = df.select(*keep, F.col(raw).alias("text"), F.explode(aspects).alias("_a"))
    return ex.select(*keep, "text", F.array_join("_a.term", " ").alias("aspect"),
                     F.col("_a.polarity").alias("polarity"))


def _aspects_of(cell: str):
    return F.from_json(F.col(cell), ASPECT_CELL_SCHEMA, {"allowSingleQuotes": "true"})


def split_aspect_cells(df: DataFrame, cell: str, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(aspect rows of the readable cells, unreadable cells with a reason).

    A null cell, one that is no list of literals (cut off, empty string) and one
    with an item that lacks its term or polarity are kept whole in the second
    frame, with all columns of ``df``; an empty list gives no rows."""
    parsed = _aspects_of(cell)
    bad_item = F.exists(parsed, lambda a: a.isNull() | a["term"].isNull() | a["polarity"].isNull())
    tagged = df.withColumn("reason", F.when(F.col(cell).isNull(), "missing cell").when(parsed.isNull(), "no list")
                           .when(bad_item, "item without term or polarity"))
    good = tagged.filter(F.col("reason").isNull() & (F.size(parsed) > 0))
    return parse_aspect_cell(good, cell, keep), tagged.filter(F.col("reason").isNotNull())


def parse_aspect_cell(df: DataFrame, cell: str, keep: Sequence[str] = ()) -> DataFrame:
    """A string cell holding a list literal with single quotes -> one row
    per aspect; the sentinel term marks a row without aspect (term null). A cell
    that cannot be read is a row of nulls; ``split_aspect_cells`` sets it aside."""
    parsed = _aspects_of(cell)
    ex = df.select(*keep, F.explode_outer(parsed).alias("_a"))
    sentinel = (F.col("_a.term") == NO_ASPECT_TERM) & (F.col("_a.polarity") == NO_ASPECT_POLARITY)
    return ex.select(*keep, F.when(sentinel, F.lit(None)).otherwise(F.col("_a.term")).alias("aspect"),
                     F.col("_a.polarity").alias("polarity"), (~sentinel).alias("has_aspect"))


def read_generations(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """The six generation columns as strings; an empty field is missing.
    ``multiline`` as in ``read_labelled_csv``."""
    schema = ", ".join(f"`{c}` string" for c in GENERATION_COLUMNS)
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
            .option("multiLine", multiline).option("nullValue", "").csv(path))


def load_splits(spark: SparkSession, root: str, dataset: str,
                eval_file: str = "raw_test_all_onecol.csv", **kw) -> DataFrame:
    """Train / val / test of one dataset as one frame with a split column;
    the test file name can be overridden."""
    files = {"train": "raw_train_all_onecol.csv", "val": "raw_val_all_onecol.csv", "test": eval_file}
    out = None
    for split, name in files.items():
        part = read_labelled_csv(spark, f"{root.rstrip('/')}/{dataset}/{name}", **kw).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def split_by_key(df: DataFrame, key: str = "doc_id", buckets: int = 10) -> DataFrame:
    """Deterministic train/val/test assignment of a keyed frame: key mod 10 of
    0-7 train, 8 val, 9 test."""
    k = F.pmod(F.col(key), F.lit(buckets))
    split = F.when(k < buckets - 2, F.lit("train")).when(k == buckets - 2, F.lit("val")).otherwise(F.lit("test"))
    return df.withColumn("split", split)


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """S7 for frames already in hand: tag and union by name."""
    out = None
    for split, df in parts.items():
        p = df.withColumn("split", F.lit(split))
        out = p if out is None else out.unionByName(p)
    return out
