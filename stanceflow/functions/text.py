"""Text cleaning as column expressions.

Everything is a built-in string / higher-order array expression: it runs
inside whole-stage codegen, over whole texts, with no Python in the plan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokeniser pattern (letters, '#' and '@' runs; one of
# , . ! ? & / < > = $; digit runs) and the marker hashtags removed by substring.
TOKEN_PATTERN = r"[A-Za-z#@]+|[,.!?&/<>=$]|[0-9]+"
MARKER_TAGS = ("#SemST", "#semst")
RESERVED_WORDS = ("RT", "FAV")

# Our own noise patterns (the cleaning library is not part of the reference):
# URLs starting with a scheme or www. in either case, pictographic emoji blocks,
# and reserved words as whole words (letters of any script, digits and the
# underscore continue a word).
URL_PATTERN = r"(?i)(https?://|www\.)[^ \t\r\n]*"
RESERVED_PATTERN = r"(?<![\p{L}\p{N}_])(?:" + "|".join(RESERVED_WORDS) + r")(?![\p{L}\p{N}_])"
EMOJI_PATTERN = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]"

#: Most entries of a dictionary written into the plan.
LITERAL_PAIRS = 64


def empty_tokens() -> Column:
    return F.array().cast("array<string>")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_noise(c) -> Column:
    """C1 on the string: drop URLs, emoji and the reserved words (mentions and
    hashtags are kept)."""
    s = F.regexp_replace(F.regexp_replace(_col(c), URL_PATTERN, ""), EMOJI_PATTERN, "")
    return F.regexp_replace(s, RESERVED_PATTERN, "")


def drop_marker(c, tags: Iterable[str] = MARKER_TAGS) -> Column:
    """Substring delete of each marker, in order (so '#SemSTx' -> 'x')."""
    s = _col(c)
    for t in tags:
        s = F.replace(s, F.lit(t), F.lit(""))
    return s


def tokenize(c) -> Column:
    """Every match of the token pattern; anything else separates.
    Null text gives an empty token list."""
    toks = F.regexp_extract_all(_col(c), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.coalesce(toks, empty_tokens())


def lower_tokens(tokens) -> Column:
    """C4."""
    return F.transform(_col(tokens), lambda t: F.lower(t))


def split_words(s: Column) -> Column:
    """Python's ``str.split()``: whitespace runs, no empty pieces."""
    return F.filter(F.split(s, r"\s+"), lambda w: w != F.lit(""))


def normalize_tokens(tokens, pairs: Iterable[tuple[str, str]]) -> Column:
    """C5 for a few literal entries, held as a map from key to its value
    already split into words (one -> many, or none when blank): a single pass,
    values not lowered again. A map is searched entry by entry, so more than
    ``LITERAL_PAIRS`` entries are refused: use ``operators.text.normalize_join``.
    The token column is referenced once: lambdas run interpreted, so a second
    reference would tokenise the text again."""
    items = list(pairs)
    if not items:
        return _col(tokens)
    if len(items) > LITERAL_PAIRS:
        raise ValueError(f"{len(items)} literal entries: pass the dictionary as a DataFrame")
    m = F.create_map(*[x for k, v in items
                       for x in (F.lit(k), F.array(*[F.lit(w) for w in v.split()]).cast("array<string>"))])
    return F.flatten(F.transform(
        _col(tokens), lambda x: F.when(F.map_contains_key(m, x), F.element_at(m, x)).otherwise(F.array(x))))


def clean_stance_tokens(c, pairs: Iterable[tuple[str, str]] = ()) -> Column:
    """C6 for one column: C1 -> C2 -> C3 -> C4 -> C5. ``pairs`` is for a few
    literal entries; a dictionary of real size is a frame, see
    ``operators.text.clean_stance``."""
    return normalize_tokens(lower_tokens(tokenize(drop_marker(strip_noise(c)))), pairs)


def clean_aspect_tokens(c) -> Column:
    """C3 -> C4 only."""
    return lower_tokens(tokenize(c))


def join_tokens(tokens, sep: str = " ") -> Column:
    return F.array_join(_col(tokens), sep)
