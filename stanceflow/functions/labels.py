"""Label maps as column expressions.

All maps are CASE expressions so they stay inside whole-stage codegen and
have a one-to-one DuckDB twin.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label encodings that must equal the reference's.
# stance:   AGAINST -> 0, NONE -> 1, FAVOR -> 2
# polarity: NEG -> 0, NEU -> 1, POS -> 2
# predictions also accept UNKNOWN -> -1 (a missing prediction)
# decoded names: NEG, NEU, POS (aspects) and Against, None, Favor (stance classes)
DOMAINS = {
    "stance": ("AGAINST", "NONE", "FAVOR"),
    "polarity": ("NEG", "NEU", "POS"),
}
DECODE_NAMES = {
    "polarity": ("NEG", "NEU", "POS"),
    "stance": ("Against", "None", "Favor"),
}
UNKNOWN = "UNKNOWN"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_label(c, domain: str = "stance") -> Column:
    """String label -> 0/1/2; any other value -> null."""
    names = DOMAINS[domain]
    col = _col(c)
    expr = F.when(col == names[0], F.lit(0))
    for i, name in enumerate(names[1:], start=1):
        expr = expr.when(col == name, F.lit(i))
    return expr.cast("int")


def encode_prediction(c, domain: str = "stance") -> Column:
    """Like encode_label, but a missing prediction is UNKNOWN = -1.

    The fill happens before the map: missing -> -1, a known name -> 0/1/2, any
    other string -> null (not -1). An empty string counts as missing: it is
    how a parser's "no match" is stored, and a CSV round trip reads it back
    as missing."""
    col = _col(c)
    return F.when(col.isNull() | (col == ""), F.lit(-1)).otherwise(encode_label(col, domain)).cast("int")


def decode_label(c, domain: str = "polarity") -> Column:
    names = DECODE_NAMES[domain]
    col = _col(c)
    return F.when(col == 0, F.lit(names[0])).when(col == 1, F.lit(names[1])).when(col == 2, F.lit(names[2]))


def stance_from_flags(toxic, quality) -> Column:
    """The stance rule of the derived stance view."""
    return (F.when(_col(toxic) == 1, F.lit("AGAINST"))
            .when(_col(quality) == 1, F.lit("FAVOR"))
            .otherwise(F.lit("NONE")))
