"""Text cleaning over DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanceflow.functions.text import clean_aspect_tokens, clean_stance_tokens, split_words
from stanceflow.session import staged

#: Most characters of a dictionary that is sent to the tasks; a larger one is joined.
SENT_CHARS = 1 << 26


def clean_stance(df: DataFrame, pairs: Iterable[tuple[str, str]] | DataFrame = (), text: str = "text",
                 target: str = "target", text_out: str = "tokens", target_out: str = "target_tokens",
                 slang: str = "slang", expansion: str = "expansion") -> DataFrame:
    """The full stance cleaning on text and target. ``pairs`` is a few
    literal entries or a dictionary frame of any size."""
    if not isinstance(pairs, DataFrame):
        items = list(pairs)
        return (df.withColumn(text_out, clean_stance_tokens(text, items))
                .withColumn(target_out, clean_stance_tokens(target, items)))
    out = df.withColumn(text_out, clean_stance_tokens(text)).withColumn(target_out, clean_stance_tokens(target))
    entries = dictionary_entries(pairs, slang, expansion)
    for tokens in (text_out, target_out):
        out = normalize_by_entries(out, entries, tokens, tokens)
    return out


def clean_aspect(df: DataFrame, text: str = "text", target: str = "target", text_out: str = "tokens",
                 target_out: str = "target_tokens") -> DataFrame:
    """Tokenise + lowercase only (no dictionary)."""
    return (df.withColumn(text_out, clean_aspect_tokens(text))
            .withColumn(target_out, clean_aspect_tokens(target)))


def cap_tokens(df: DataFrame, tokens: str = "tokens", n: int = 100) -> DataFrame:
    """Keep the first n tokens, remember the length before and the flag."""
    return (df.withColumn("n_before", F.size(tokens))
            .withColumn("over_cap", F.size(tokens) > n)
            .withColumn(tokens, F.slice(tokens, 1, n)))


def length_profiles(df: DataFrame, datasets: Sequence[str], by: Sequence[str] = (), tokens: str = "tokens",
                    cap: int = 100) -> DataFrame:
    """C9 for several datasets from one aggregation of the token lengths."""
    n = F.col("_n")
    stats = df.select(*by, F.size(tokens).alias("_n")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(n).alias("max_len"), F.avg(n.cast("double")).alias("_avg"),
        F.avg(F.least(n, F.lit(cap)).cast("double")).alias("_avg_capped"), F.count_if(n > cap).alias("n_over_cap"))
    rows = [F.struct(F.lit(d).alias("dataset"),
                     F.col("_avg_capped" if d == "Covid19" else "_avg").alias("avg_len"),
                     (F.least("max_len", F.lit(cap)) > 140 if d == "Covid19" else F.col("max_len") > 120)
                     .alias("overflow")) for d in datasets]
    return stats.select(*by, "n_rows", "max_len", "n_over_cap", F.inline(F.array(*rows)))


def length_profile(df: DataFrame, by: Sequence[str] = (), tokens: str = "tokens", dataset: str = "SemEval2016",
                   cap: int = 100) -> DataFrame:
    """Max length before the cap, mean length after it, rows over the cap,
    and the overflow flag (> 140 for Covid19, tested after its cap, so never
    raised there; > 120 otherwise). Only Covid19 is capped."""
    n = F.size(tokens)
    capped = F.least(n, F.lit(cap)) if dataset == "Covid19" else n
    limit = 140 if dataset == "Covid19" else 120
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(n).alias("max_len"),
        F.avg(capped.cast("double")).alias("avg_len"),
        F.count_if(n > cap).alias("n_over_cap"),
        (F.max(capped) > limit).alias("overflow"),
    )


def merge_dicts(base: DataFrame, override: DataFrame, key: str = "slang", value: str = "expansion") -> DataFrame:
    """Two dictionary sources, the later wins on a key clash; the override
    value is right-stripped (a TSV line end)."""
    o = override.select(F.col(key), F.rtrim(F.col(value)).alias("_ov"))
    b = base.select(F.col(key), F.col(value).alias("_bv"))
    return b.join(o, key, "full_outer").select(key, F.coalesce("_ov", "_bv").alias(value))


def merged_hits(tokens: Column, hits: Column) -> Column:
    """``tokens`` with each hit (position, replacement; sorted by position) put
    in its place: the stretches between hits and the replacements, in turn.
    Linear in the tokens."""
    places = F.concat(F.array(F.lit(-1)), F.transform(hits, lambda h: h["_pos"]))
    upto = F.zip_with(hits, F.slice(places, F.lit(1), F.size(hits)), lambda h, before: F.concat(
        F.slice(tokens, before + 2, h["_pos"] - before - 1), h["_rep"]))
    rest = F.slice(tokens, F.element_at(places, -1) + 2, F.size(tokens))
    return F.concat(F.flatten(upto), rest)


@dataclass
class Entries:
    """A written dictionary: ``frame`` (_tok, _rep), one row per word, and what
    the tasks look it up in (words, words of all replacements, first one of
    each) unless it is too large to be sent."""

    frame: DataFrame
    sent: object | None


def dictionary_entries(dictionary: DataFrame, slang: str = "slang", expansion: str = "expansion") -> Entries:
    """The entries of a dictionary frame, written once and measured. Of a
    repeated slang word the smallest expansion counts. Up to ``SENT_CHARS``
    characters are sent to the tasks. Runs jobs when called."""
    d = (dictionary.where(F.col(slang).isNotNull()).groupBy(F.col(slang).alias("_tok"))
         .agg(F.coalesce(F.min(expansion), F.lit("")).alias("_exp"))
         .select("_tok", split_words(F.col("_exp")).alias("_rep")))
    d = staged(d, "dictionary")
    size = d.select(F.sum(F.length("_tok") + F.length(F.array_join("_rep", " ")) + 2)).first()[0] or 0
    if size > SENT_CHARS:
        return Entries(d, None)
    t = d.toArrow()
    words, reps = (c.combine_chunks() for c in (t.column("_tok"), t.column("_rep")))
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(reps).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return Entries(d, d.sparkSession.sparkContext.broadcast((words, reps.flatten(), first)))


def replaced(lists: pa.ListArray, words: pa.Array, reps: pa.Array, first: np.ndarray) -> pa.ListArray:
    """Token lists with every token found in ``words`` replaced by its stretch
    of ``reps``: ``first[i]`` to ``first[i + 1]`` for word i."""
    flat = lists.flatten()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    at = pc.index_in(flat, value_set=words.cast(flat.type))
    hits = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    start, count = np.arange(len(flat), dtype=np.int64), np.ones(len(flat), dtype=np.int64)
    entry = at.take(pa.array(hits)).to_numpy(zero_copy_only=False).astype(np.int64)
    start[hits], count[hits] = len(flat) + first[entry], first[entry + 1] - first[entry]
    ends = np.concatenate([[0], np.cumsum(count)])
    take = np.arange(ends[-1]) + np.repeat(start - ends[:-1], count)
    values = pa.chunked_array([flat, reps.cast(flat.type)]).take(pa.array(take)).combine_chunks()
    offsets = ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=lists.is_null() if lists.null_count else None)


def normalize_by_entries(df: DataFrame, entries: Entries, tokens: str = "tokens", out: str = "norm_tokens") -> DataFrame:
    """``df`` + ``out``, the tokens with each entry's word replaced.

    A dictionary that was sent is looked up where the rows are, so nothing is
    shuffled. Else only hits move: tokens meet the dictionary in an inner join,
    the hits of a token list are gathered under the list's digest, and the list
    is patched by position. The digest alone names a list, so rows need no key,
    and rows with equal or null keys are safe."""
    if entries.sent is not None:
        sent = entries.sent

        def look_up(lists: pa.Array) -> pa.Array:
            return replaced(lists, *sent.value)

        return df.withColumn(out, F.arrow_udf(look_up, "array<string>")(F.col(tokens)))
    digest = F.unhex(F.sha2(F.array_join(F.col(tokens), "\u0001", "\u0002"), 256))
    keyed = df.withColumn("_list", digest)
    found = (keyed.select("_list", F.posexplode(tokens).alias("_pos", "_tok")).join(entries.frame, "_tok")
             .groupBy("_list").agg(F.array_sort(F.collect_set(F.struct("_pos", "_rep"))).alias("_hits"))
             .withColumnRenamed("_list", "_found"))
    patched = merged_hits(F.col(tokens), F.col("_hits"))
    return (keyed.join(found, F.col("_list") == F.col("_found"), "left")
            .withColumn(out, F.when(F.col("_hits").isNull(), F.col(tokens)).otherwise(patched))
            .drop("_list", "_found", "_hits"))


def normalize_tokens_by(df: DataFrame, dictionary: DataFrame, tokens: str = "tokens", out: str = "norm_tokens",
                        slang: str = "slang", expansion: str = "expansion") -> DataFrame:
    """C5 / J5 with a dictionary frame of any size: ``df`` + ``out``, the tokens
    with each dictionary entry replaced by the words of its expansion (none when
    blank). The dictionary is written and measured when this is called."""
    return normalize_by_entries(df, dictionary_entries(dictionary, slang, expansion), tokens, out)


def normalize_join(df: DataFrame, dictionary: DataFrame, key: str, tokens: str = "tokens",
                   out: str = "norm_tokens", slang: str = "slang", expansion: str = "expansion",
                   keep: Sequence[str] = ()) -> DataFrame:
    """J5 as (key, keep..., out): one row per row of ``df``, whatever its key."""
    return normalize_tokens_by(df, dictionary, tokens, out, slang, expansion).select(key, *keep, out)
