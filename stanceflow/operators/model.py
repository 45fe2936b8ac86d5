"""Target-aware text classifier on Spark ML (M1-M5).

The reference fine-tunes a transformer whose attention gets an additive bias
on the target span. The Spark re-aim keeps the data idea in a linear model:
hashed bag-of-words of the text, target terms weighted by 1 + alpha, and
text-target overlap terms; multinomial logistic regression is fitted with
Spark ML's distributed L-BFGS (one aggregation pass per iteration).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stanceflow.session import staged

#: Hash slots by default. Terms share slots once there are about as many as
#: slots; pass more for larger vocabularies.
TEXT_FEATURES = 1 << 16
TARGET_FEATURES = 1 << 11


def ta_features(df: DataFrame, alpha: float = 0.5, key: str = "doc_id", tokens: str = "tokens",
                target_tokens: str = "target_tokens") -> DataFrame:
    """M1 without hashing, as long rows (key, term, weight): the text's term
    counts by inverse document frequency, ln((n + 1) / (df + 1)), plus the
    target's term counts by 1 + alpha. ``key`` names a row.

    Terms are counted where the rows are and the counts written once; only a
    ``key`` that several rows share moves them (their counts add up). The
    frequency that most terms have, that of rare ones, needs no table; Spark
    broadcasts the table of the others when it is small. Runs jobs when called."""
    held = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    counts = term_counts(df, key, tokens, target_tokens)
    if (held["most"] or 0) > 1:
        counts = counts.groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.sum("aimed").alias("aimed"))
    counts = staged(counts, "term-counts")
    in_text = (F.col("tf") > 0) & F.col("term").isNotNull()
    held_by = staged(counts.where(in_text).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term-frequencies")
    usual = held_by.groupBy("df").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "df").first()
    usual = usual["df"] if usual else 0
    others = staged(held_by.where(F.col("df") != usual), "term-frequencies")
    df_of = F.when(in_text, F.coalesce("df", F.lit(usual)))
    idf = F.log(((held["n"] or 0) + 1) / (df_of + 1))
    weight = F.coalesce(F.col("tf") * idf, F.lit(0.0)) + F.col("aimed") * F.lit(1.0 + alpha)
    return counts.join(others, "term", "left").where((F.col("aimed") > 0) | in_text) \
        .select(key, "term", weight.alias("weight"))


def term_counts(df: DataFrame, key: str, tokens: str, target_tokens: str) -> DataFrame:
    """(key, term, tf, aimed): per row of ``df``, how often each of its terms
    stands in the text and in the target."""
    field = df.schema[key]
    schema = T.StructType([field, T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()),
                           T.StructField("aimed", T.LongType())])

    def run(batches):
        for batch in batches:
            lists = batch.columns[1:]
            rows = np.concatenate([np.repeat(np.arange(len(x)), pc.fill_null(pc.list_value_length(x), 0)) for x in lists])
            words = pa.chunked_array([x.flatten() for x in lists]).combine_chunks()
            words = words.dictionary_encode(null_encoding="encode")
            known = max(1, len(words.dictionary))
            met, which = np.unique(rows.astype(np.int64) * known + words.indices.to_numpy(), return_inverse=True)
            in_text = len(lists[0].flatten())
            tf, aimed = (np.bincount(w, minlength=len(met)) for w in (which[:in_text], which[in_text:]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(met // known)), words.dictionary.take(pa.array(met % known)),
                 pa.array(tf, pa.int64()), pa.array(aimed, pa.int64())], names=[batch.schema.names[0], "term", "tf", "aimed"])

    return df.select(key, tokens, target_tokens).mapInArrow(run, schema)


def with_feature_tokens(df: DataFrame, tokens: str = "tokens", target_tokens: str = "target_tokens") -> DataFrame:
    """M1 inputs: text tokens, target tokens and their overlap."""
    return df.withColumn("_overlap", F.array_intersect(F.col(tokens), F.col(target_tokens)))


def feature_pipeline(alpha: float = 0.5, tokens: str = "tokens", target_tokens: str = "target_tokens",
                     text_features: int = TEXT_FEATURES, target_features: int = TARGET_FEATURES) -> list:
    """M1: hashed text TF-IDF, target TF scaled by 1 + alpha, overlap TF."""
    scale = Vectors.dense(np.full(target_features, 1.0 + alpha))
    return [
        HashingTF(inputCol=tokens, outputCol="_tf_text", numFeatures=text_features),
        IDF(inputCol="_tf_text", outputCol="_idf_text", minDocFreq=1),
        HashingTF(inputCol=target_tokens, outputCol="_tf_target", numFeatures=target_features),
        ElementwiseProduct(inputCol="_tf_target", outputCol="_w_target", scalingVec=scale),
        HashingTF(inputCol="_overlap", outputCol="_tf_overlap", numFeatures=target_features),
        VectorAssembler(inputCols=["_idf_text", "_w_target", "_tf_overlap"], outputCol="features"),
    ]


def train_classifier(df: DataFrame, label: str = "y", alpha: float = 0.5, max_iter: int = 50,
                     reg: float = 0.01, tokens: str = "tokens", target_tokens: str = "target_tokens",
                     text_features: int = TEXT_FEATURES, target_features: int = TARGET_FEATURES) -> PipelineModel:
    """M2: three-class cross-entropy (multinomial logistic regression)."""
    lr = LogisticRegression(featuresCol="features", labelCol=label, family="multinomial", maxIter=max_iter,
                            regParam=reg, elasticNetParam=0.0, predictionCol="_pred", probabilityCol="_prob",
                            rawPredictionCol="_raw")
    pipe = Pipeline(stages=[*feature_pipeline(alpha, tokens, target_tokens, text_features, target_features), lr])
    return pipe.fit(with_feature_tokens(df, tokens, target_tokens).withColumn(label, F.col(label).cast("double")))


def score_classifier(model: PipelineModel, df: DataFrame, tokens: str = "tokens",
                     target_tokens: str = "target_tokens", out: str = "p") -> DataFrame:
    """M3: logits per row (as array<double>) and the argmax prediction."""
    scored = model.transform(with_feature_tokens(df, tokens, target_tokens))
    keep = [c for c in df.columns]
    return scored.select(*keep, vector_to_array("_raw").alias("logits"), F.col("_pred").cast("int").alias(out))


def log_loss(logits: str = "logits", y: str = "y") -> Column:
    """Cross-entropy of one row from its logits."""
    lg = F.col(logits)
    top = F.array_max(lg)
    total = F.aggregate(lg, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.log(total) + top - F.get(lg, F.col(y))


def seed_split(df: DataFrame, seed: int, key: str = "doc_id", val_share: int = 5) -> DataFrame:
    """Per-seed train / validation assignment: md5('seed:key') decides, so
    each seed sees a different, repeatable validation fold."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10)
    return df.withColumn("fold", F.when(h.cast("long") % val_share == 0, F.lit("val")).otherwise(F.lit("train")))


def score_batches(df: DataFrame, fn: Callable[[pd.DataFrame], Sequence[Sequence[float]]],
                  inputs: Sequence[str], out: str = "logits", batch_size: int = 32) -> DataFrame:
    """M4: a caller-supplied model over Arrow batches -> logits array column."""
    schema = df.select("*", F.lit(None).cast("array<double>").alias(out)).schema
    ins = list(inputs)

    def run(batches):
        for pdf in batches:
            made: list = []
            for start in range(0, len(pdf), batch_size):
                rows = fn(pdf[ins].iloc[start:start + batch_size].reset_index(drop=True))
                made += [list(map(float, r)) for r in rows]
            yield pdf.assign(**{out: made})

    return df.mapInPandas(run, schema)


def two_head(main: DataFrame, aux: DataFrame, alpha: float = 0.5, max_iter: int = 30) -> tuple:
    """M5: task 0 rows use the three-class head, task 1 rows the target-id
    head (trained on the auxiliary frame without class 1)."""
    main_model = train_classifier(main, "y", alpha, max_iter)
    aux_model = train_classifier(aux, "target_id", alpha, max_iter)
    return main_model, aux_model


def route(main_model: PipelineModel, aux_model: PipelineModel, df: DataFrame, task: str = "task") -> DataFrame:
    """Predictions of the head each row's task asks for."""
    s0 = score_classifier(main_model, df.filter(F.col(task) == 0))
    s1 = score_classifier(aux_model, df.filter(F.col(task) == 1).withColumn(
        "target_tokens", F.array().cast("array<string>")))
    return s0.unionByName(s1)
