"""Prompting and generation over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanceflow.functions.prompts import (
    HOSTED_TEMPLATES, LLM_TEMPLATES, LOG_PREFIX, SFT_TEMPLATES, render, template_parts,
)
from stanceflow.functions.text import tokenize

TEMPLATE_SETS = {"local": LLM_TEMPLATES, "hosted": HOSTED_TEMPLATES, "sft": SFT_TEMPLATES}


def get_template(family: str, name: str) -> str:
    try:
        return TEMPLATE_SETS[family][name]
    except KeyError:
        raise KeyError(f"no template {name!r} in family {family!r}") from None


def render_prompt(df: DataFrame, template: str, values: Mapping[str, str] | None = None,
                  out: str = "prompt") -> DataFrame:
    """Prompt column from a template; ``values`` maps placeholders to
    columns (default: text -> text, target -> target)."""
    vals = dict(values or {"text": "text", "target": "target"})
    return df.withColumn(out, render(template, vals))


def build_sft(df: DataFrame, template: str = SFT_TEMPLATES["chat-type1"], text: str = "text",
              target: str = "target", stance: str = "stance", out: str = "text") -> DataFrame:
    """The training text is the prompt with the gold answer and the end
    marker; it replaces the text column (train and eval alike). The prompt
    without the answer is kept as ``sft_prefix`` for G4."""
    vals = {"tweet": text, "tgt": target, "stance": stance}
    parts = template_parts(template)
    cut = next((i for i, (k, v) in enumerate(parts) if k == "var" and v == "stance"), len(parts))
    prefix_tpl = "".join(v.replace("$", "$$") if k == "lit" else "${" + v + "}" for k, v in parts[:cut])
    return (df.withColumn("sft_prefix", render(prefix_tpl, vals))
            .withColumn(out, render(template, vals)))


def truncate_sft(df: DataFrame, text: str = "text", prefix: str = "sft_prefix", answer: str = "stance",
                 max_len: int = 4096) -> DataFrame:
    """Keep the first max_len tokens; flag whether the answer survived
    (truncation cuts the tail, where the answer sits)."""
    toks = tokenize(text)
    answer_end = F.size(tokenize(prefix)) + F.size(tokenize(answer))
    return (df.withColumn("n_tokens", F.size(toks).cast("long"))
            .withColumn("sft_tokens", F.slice(toks, 1, max_len))
            .withColumn("n_kept", F.least(F.size(toks), F.lit(max_len)).cast("long"))
            .withColumn("answer_survived", answer_end <= max_len))


def generate(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], inputs: Sequence[str] = ("prompt",),
             out: str = "generated_text", batch_size: int = 4, checkpoint: bool = False) -> DataFrame:
    """A caller-supplied generator over Arrow batches of ``batch_size``
    rows (``fn(pandas.DataFrame of inputs) -> pandas.Series of str``).

    Generation is the costly step and a sampling model is not repeatable:
    with ``checkpoint=True`` the output is written once to the cluster's
    checkpoint folder, so later stages and retried tasks read the same texts
    instead of calling the model again."""
    cols = list(df.columns)
    schema = df.select(*cols, F.lit(None).cast("string").alias(out)).schema
    ins = list(inputs)

    def run(batches):
        for pdf in batches:
            made: list = []
            for start in range(0, len(pdf), batch_size):
                made += list(fn(pdf[ins].iloc[start:start + batch_size].reset_index(drop=True)))
            yield pdf.assign(**{out: made})

    generated = df.mapInPandas(run, schema)
    if checkpoint:
        from stanceflow.session import checkpoint_dir
        checkpoint_dir(df.sparkSession)
        generated = generated.checkpoint(eager=True)
    return generated


def strip_echo(df: DataFrame, generated: str = "generated_text", prompt: str = "prompt",
               out: str | None = None) -> DataFrame:
    """Remove every occurrence of the prompt from the output; an empty
    prompt leaves it unchanged (a prompt changed by decoding is not found)."""
    g, p = F.col(generated), F.col(prompt)
    stripped = F.when(p.isNull() | (p == ""), g).otherwise(F.replace(g, p, F.lit("")))
    return df.withColumn(out or generated, stripped)


def gen_log(df: DataFrame, generated: str = "generated_text", out: str = "log_line") -> DataFrame:
    """The raw log line."""
    return df.withColumn(out, F.concat(F.lit(LOG_PREFIX), F.col(generated)))
