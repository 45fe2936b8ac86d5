"""Pair encoding and target span as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The start / separator markers per model family.
MARKERS = {
    "Bert": ("[CLS]", "[SEP]"),
    "BertLite": ("[CLS]", "[SEP]"),
    "Bertweet": ("<s>", "</s>"),
}
PAD = "<pad>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pair_body(text_tokens, target_tokens, sep: str) -> Column:
    """E1 body: text tokens, separator, target tokens (one sequence)."""
    return F.concat(_col(text_tokens), F.array(F.lit(sep)), _col(target_tokens))


def encode_sequence(text_tokens, target_tokens, cls: str, sep: str, max_len: int | Column) -> Column:
    """E1 + E2 truncation: [CLS] body[:max_len-2] [SEP] (over-long bodies keep
    their prefix and the final slot is always the end separator)."""
    body = F.slice(pair_body(text_tokens, target_tokens, sep), 1, max_len - 2)
    return F.concat(F.array(F.lit(cls)), body, F.array(F.lit(sep)))


def pad_sequence(seq, max_len: int, pad: str = PAD) -> Column:
    n = F.size(_col(seq))
    return F.concat(_col(seq), F.array_repeat(F.lit(pad), F.lit(max_len) - n))


def attention_mask(seq, max_len: int) -> Column:
    n = F.size(_col(seq))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n))


def span_start(seq, sep: str) -> Column:
    """0-based index after the first separator (null when the sequence has
    no separator, e.g. encoded for another model family)."""
    b = F.array_position(_col(seq), F.lit(sep))
    return F.when(b > 0, b.cast("int"))


def span_end(seq, sep: str) -> Column:
    """0-based index of the separator after the first one; null when the
    text filled the sequence (no second separator)."""
    s = _col(seq)
    b = F.array_position(s, F.lit(sep))  # 1-based position of the first sep
    rest = F.slice(s, (b + 1).cast("int"), F.greatest(F.size(s) - b, F.lit(1)).cast("int"))
    k = F.array_position(rest, F.lit(sep))
    return F.when((b > 0) & (F.size(s) > b) & (k > 0), (b + k - 1).cast("int"))
