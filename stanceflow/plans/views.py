"""Derived views over the given tables (FIXTURES.md section 3).

Each view is plain DataFrame arithmetic on the input tables, so the DuckDB
oracle can build exactly the same rows. Row fan-outs (seeds x epochs) are
generators on the row (``inline``), not joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanceflow.functions.labels import encode_label, stance_from_flags
from stanceflow.functions.text import tokenize

SEEDS = (1, 2, 3)
EPOCHS = (1, 2, 3, 4, 5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stance_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents JOIN labels: doc_id, text, target, target_text, stance, y."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    stance = stance_from_flags("toxic", "quality")
    return docs.join(labels, "doc_id").select(
        "doc_id", "text",
        F.col("lang").alias("target"),
        F.concat_ws(" ", "lang", "source").alias("target_text"),
        stance.alias("stance"),
        encode_label(stance, "stance").alias("y"),
    )


def seed_epoch_grid(seeds=SEEDS, epochs=EPOCHS):
    return F.inline(F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(e).alias("epoch"))
                              for s in seeds for e in epochs]))


def prediction_column(doc_id="doc_id", y="y", seed="seed", epoch="epoch"):
    h = F.col(doc_id) * 17 + F.col(seed) * 3 + F.col(epoch) * 11
    right = F.pmod(h, F.lit(10)) < F.lit(3) + F.pmod(F.col(epoch) * 3, F.lit(5))
    wrong = F.pmod(F.col(y) + 1 + F.pmod(F.col(doc_id) + F.col(seed), F.lit(2)), F.lit(3))
    return (F.when(F.pmod(h, F.lit(10)) == 9, F.lit(-1)).when(right, F.col(y)).otherwise(wrong)).cast("int")


def prediction_view(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """stance_view x seed {1,2,3} x epoch {1..5} with a deterministic prediction p."""
    sv = stance_view(spark, sf_dir)
    cols = ["doc_id", "target", "y"] + (["text", "target_text"] if with_text else [])
    grid = sv.select(*cols, seed_epoch_grid())
    return grid.withColumn("p", prediction_column())


def logits_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: three logits, each the sum of every third dimension (all
    dimensions count), y = label % 3."""
    emb = table(spark, sf_dir, "embeddings")
    dims = F.col("embedding").cast("array<double>")

    def logit(c):
        return F.aggregate(F.filter(dims, lambda x, i: i % 3 == c), F.lit(0.0), lambda a, x: a + x)

    logits = F.array(*[logit(c) for c in range(3)])
    return emb.select("vec_id", logits.alias("logits"), F.pmod(F.col("label"), F.lit(3)).cast("int").alias("y"))


# The parser edge strings (FIXTURES.md section 4, rows 0-10);
# row 4 uses a plain space instead of its newline in the generation view.
PARSER_STRINGS = (
    "[/INST] {'Stance': 'FAVOR'}",
    '[/INST]\n blah "Stance": "AGAINST" then Stance: NONE',
    "x Stance: FAVOR",
    "[/INST] Stance: favor",
    "[/INST] No\nStance",
    "[/INST] I think Neutral. favor",
    "[/INST] nostance",
    "unfavorable NONE",
    "",
    "[/INST] Stance:FAVOR",
    "a [/INST] none [/INST] FAVOR",
    "[/INST] no\u00a0stance",
    "[/INST] No  Stance",
)


def generation_text_column(doc_id="doc_id"):
    k = F.pmod(F.col(doc_id), F.lit(12))
    expr = None
    for i in range(11):
        s = PARSER_STRINGS[i].replace("\n", " ") if i == 4 else PARSER_STRINGS[i]
        expr = F.when(k == i, F.lit(s)) if expr is None else expr.when(k == i, F.lit(s))
    return expr.otherwise(F.lit(None).cast("string"))


def generation_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stance_view with a generated text chosen by doc_id % 12 (null for 11)."""
    sv = stance_view(spark, sf_dir)
    return sv.select("doc_id", "text", "target", "stance", "y", generation_text_column().alias("generated_text"))


def nested_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations regrouped per conversation into array<struct<role,text>>
    ordered by turn (the nested-document shape)."""
    conv = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return conv.groupBy("conv_id").agg(turns.alias("turns"))


# The literal normalisation dictionary of FIXTURES.md C5, base
# entries then the override source (later wins on a key clash).
DICT_BASE = (("the", "teh of"), ("en", "in"), ("la", ""), ("ona", "on  a"))
DICT_OVERRIDE = (("en", "inn"),)


def dictionary_frames(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    base = spark.createDataFrame(list(DICT_BASE), "slang string, expansion string")
    over = spark.createDataFrame(list(DICT_OVERRIDE), "slang string, expansion string")
    return base, over


def token_frame(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("tokens", tokenize(text))
