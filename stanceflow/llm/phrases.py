"""Phrase mining and collocation scores after Toivonen.

All phrases of up to four words that occur ``minimum`` times or more in a
language are counted exactly:

1. a sample (every eighth row, by hash) is mined level by level with a lowered
   threshold; what is frequent there is proposed;
2. one full pass counts the proposals and their negative border together: a
   phrase is counted if the parts without its last and without its first word
   are both proposed, and every single word is counted;
3. a border phrase that proves frequent is a failure: longer phrases around it
   were not counted. A further pass counts just the phrases that hold a failure
   and whose two parts are frequent or hold a failure themselves; passes go on
   until one leaves no failure (the first one does, as it takes in all lengths).

A frequent phrase has frequent parts, so by induction every one of them has been
counted when no failure is left. The proposals reach the workers as a Bloom
filter of bounded size: a false positive only makes a pass count a phrase more.
Counts are exact because words and phrases are compared as such: each task
numbers the phrases of a bundle of texts and sends their words and number of
occurrences, which Spark sums.

Scores come from joins of the frequent phrases with their own parts; a row per
phrase and cut moves, never a text.

Defined results: null texts have no words; a null language is ``und`` (and one
with a language of that name); empty texts and texts of separators alone add
nothing; repeated rows count again; very long texts are handled whole; an empty
table gives an empty frame; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stanceflow.llm.common import Shared, release_memory, staged
from stanceflow.llm.wordarrays import bundles, spread, starts_of, translated

#: Separators of pieces ``[.,;:!?\x0A-\x0D]`` become line ends, a tab a space,
#: A-Z lower case.
PIECES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b
               for b in range(256))

#: One row in so many is in the sample.
SAMPLE = 8
#: The sample's threshold is this share of what ``minimum`` comes to there.
LOWERED = 0.6
#: Bits of a filter: 16 for each phrase, up to 16 MB whatever the corpus.
FILTER_BITS = (16, 27)
#: Bytes of text in a bundle.
BUNDLE_BYTES = 2_000_000
#: Parts that a language's ranking is first cut down in.
RANK_PARTS = 256

ROWS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()),
                     T.StructField("k", T.IntegerType()), T.StructField("n", T.LongType())])


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (finaliser of the
    splitmix64 generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _extended(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    return _mixed(h * np.uint64(0x9E3779B97F4A7C15) + word)


def _hashes(values: pa.Array) -> np.ndarray:
    """A hash per string: the sum of its bytes, each times a random number of its place."""
    values = pa.concat_arrays([values])
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
    letters = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(ends)
    weights = _mixed(np.arange(1, sizes.max(initial=0) + 1, dtype=np.uint64)) | np.uint64(1)
    parts = (letters.astype(np.uint64) + np.uint64(1)) * weights[spread(sizes)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(parts, dtype=np.uint64)))
    at = ends - ends[0]
    return sums[at[1:]] - sums[at[:-1]]  # modulo 2^64, like the sums


class Filter:
    """Bloom filter over phrase hashes, three places each."""

    def __init__(self, bits: int, cells: np.ndarray):
        self.mask, self.cells = np.uint64((1 << bits) - 1), cells

    @staticmethod
    def places(h: np.ndarray, mask: np.uint64):
        step = (h >> np.uint64(33)) | np.uint64(1)
        return [(h + np.uint64(j) * step) & mask for j in range(3)]

    def __contains__(self, h):
        raise TypeError("use has()")

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in self.places(h, self.mask):
            out &= (self.cells[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def filter_of(phrases: DataFrame) -> Shared:
    """The filter of (lang, phrase) rows, put together from 64-bit pieces."""
    spark = phrases.sparkSession
    bits = min(max((16 * phrases.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    mask = np.uint64((1 << bits) - 1)

    def run(batches):
        for batch in batches:
            langs, words = batch.column(0).dictionary_encode(), pc.split_pattern(batch.column(1), " ")
            coded = words.flatten().dictionary_encode()
            counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            at = starts_of(counts)[:-1]
            one = _mixed(np.repeat(_hashes(langs.dictionary)[langs.indices.to_numpy()], counts)
                         + _hashes(coded.dictionary)[coded.indices.to_numpy()])
            h = one[at]
            for k in range(1, int(counts.max(initial=1))):
                more = counts > k
                h[more] = _extended(h[more], one[at[more] + k])
            places = np.unique(np.concatenate(Filter.places(h, mask)))
            cell, first = np.unique(places >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first) if len(first) else places
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(value.view(np.int64))],
                                             names=["cell", "bits"])

    cells = phrases.select("lang", "phrase").mapInArrow(run, "cell long, bits long") \
        .groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    full = np.zeros(1 << (bits - 6), "<i8")
    full[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return Shared(spark, Filter(bits, full.view(np.uint8)))


class Bundle:
    """Words of a bundle of rows: number, language number, hash, and whether the
    next word is in the same piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        pieces = pc.split_pattern(translated(texts, PIECES), "\n")
        row_of = pc.list_parent_indices(pieces).to_numpy(zero_copy_only=False)
        words = pc.ascii_split_whitespace(pieces.flatten())
        piece = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
        coded_words = words.flatten().dictionary_encode()
        self.ids = coded_words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary = coded_words.dictionary
        empty = pc.index(self.vocabulary, "").as_py()
        if empty >= 0:
            real = self.ids != empty
            self.ids, piece = self.ids[real], piece[real]
        self.lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row_of[piece]]
        self.piece = piece

    def hashed(self) -> np.ndarray:
        return _mixed(_hashes(self.langs)[self.lang] + _hashes(self.vocabulary)[self.ids])

    def rows(self, at: np.ndarray, n: np.ndarray, k: int) -> pa.RecordBatch:
        """Output rows of the ``k``-word phrases that start at words ``at``."""
        place = np.repeat(at, k) + spread(np.full(len(at), k, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(at) + 1, k, dtype=np.int32)),
                                         self.vocabulary.take(pa.array(self.ids[place])))
        return pa.RecordBatch.from_arrays(
            [self.langs.take(pa.array(self.lang[at])), pc.binary_join(lists, " "),
             pa.array(np.full(len(at), k, np.int32)), pa.array(n.astype(np.int64))], names=ROWS.names)

    def totals(self) -> pa.RecordBatch:
        n = np.bincount(self.lang, minlength=len(self.langs))
        return pa.RecordBatch.from_arrays([self.langs, pa.array([""] * len(n)), pa.array(np.zeros(len(n), np.int32)),
                                           pa.array(n)], names=ROWS.names)


def _distinct(bundle: Bundle, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(one place, occurrences) of each ``k``-word phrase among those at ``at``, compared exactly."""
    size = len(bundle.vocabulary)
    number, most = bundle.lang[at] * size + bundle.ids[at], len(bundle.langs) * size
    if k == 1 and most < 4 * len(at):
        where, many = np.zeros(most, np.int64), np.bincount(number, minlength=most)
        where[number] = at
        return where[many > 0], many[many > 0]
    for j in range(1, k):
        if most > (1 << 62) // size:  # numbers so far anew, without gaps
            _, number = np.unique(number, return_inverse=True)
            most = len(at)
        number, most = number * size + bundle.ids[at + j], most * size
    _, first, many = np.unique(number, return_index=True, return_counts=True)
    return at[first], many


def _counted(bundle: Bundle, first: int, last: int, known: Filter | None, fresh: Filter | None):
    """Record batches of the phrases of ``first`` to ``last`` words whose two
    parts are known. With ``fresh``: of those that hold a fresh phrase, which
    makes a part count as known."""
    n = len(bundle.ids)
    at = np.arange(n)  # where a phrase of k words starts whose parts are known
    h = word = bundle.hashed() if last > 1 else None  # the hashes of these phrases
    new = np.zeros(n, bool)  # whether they hold a fresh one
    for k in range(1, last + 1):
        if k >= first and len(at):
            asked = at[new] if fresh is not None and k > 1 else at
            if len(asked):
                yield bundle.rows(*_distinct(bundle, asked, k), k)
        if k == last or not len(at):
            return
        good = known.has(h)
        if fresh is not None:
            new = new | fresh.has(h)
            good |= new
        place = np.full(n + 1, -1, np.int64)  # of a good phrase, in the arrays over it
        at, h, new = at[good], h[good], new[good]
        place[at] = np.arange(len(at))
        both = place[at + 1] >= 0
        both &= bundle.piece[at] == bundle.piece[np.minimum(at + k, n - 1)]
        both &= at + k < n
        new = new[both] | new[place[at[both] + 1]]
        at, h = at[both], h[both]
        h = _extended(h, word[at + k])


def count_phrases(docs: DataFrame, minimum: int, first: int, last: int, known: Shared | None = None,
                  fresh: Shared | None = None, totals: bool = False, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """(lang, phrase, k, n) of the phrases that ``_counted`` counts and that
    occur ``minimum`` times; with ``totals`` also a row of k = 0 per language
    with its number of words. ``docs``: columns lang, text."""
    def run(batches):
        for batch in bundles(batches, 1, bundle_bytes):
            bundle = Bundle(batch.column(0), batch.column(1))
            if totals:
                yield bundle.totals()
            yield from _counted(bundle, first, last, known and known(), fresh and fresh())
            del batch, bundle
            release_memory()

    return docs.select("lang", "text").mapInArrow(run, ROWS).groupBy("lang", "phrase", "k") \
        .agg(F.sum("n").alias("n")).where((F.col("k") == 0) | (F.col("n") >= minimum))


def sampled_phrases(docs: DataFrame, minimum: int, last: int, sample: int) -> DataFrame:
    """Proposals (lang, phrase) of up to ``last`` words: those that are frequent in the sample."""
    part = staged(docs.where(F.pmod(F.xxhash64("lang", "text"), F.lit(sample)) == 0), "sample")
    least = max(2, int(LOWERED * minimum / sample))
    proposed = staged(count_phrases(part, least, 1, 1).select("lang", "phrase"), "proposed")
    for k in range(2, last + 1):
        more = count_phrases(part, least, k, k, filter_of(proposed)).select("lang", "phrase")
        proposed = proposed.unionByName(staged(more, "proposed"))
    return proposed


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", minimum: int = 30, longest: int = 4,
                     sample: int = SAMPLE) -> DataFrame:
    """(lang, phrase, k, n): all phrases of up to ``longest`` words with ``minimum``
    or more occurrences in their language, and each language's number of words at k = 0."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    proposed = sampled_phrases(rows, minimum, longest - 1, sample)
    found = staged(count_phrases(rows, minimum, 1, longest, filter_of(proposed), totals=True), "phrases")
    shorter = F.col("k").between(1, longest - 1)
    fresh = staged(found.where(shorter).select("lang", "phrase").join(proposed, ["lang", "phrase"], "left_anti"),
                   "failures")
    held = fresh  # all failures so far: what holds one has been counted
    while not fresh.isEmpty():
        known, failed = filter_of(found.where(shorter)), filter_of(fresh)
        more = staged(count_phrases(rows, minimum, 2, longest, known, failed)
                      .join(found.select("lang", "phrase"), ["lang", "phrase"], "left_anti"), "phrases")
        found = found.unionByName(more)
        fresh = staged(_not_holding(more.where(shorter).select("lang", "phrase"), held), "failures")
        held = held.unionByName(fresh)
    return found


def _not_holding(phrases: DataFrame, held: DataFrame) -> DataFrame:
    """The (lang, phrase) rows without any of ``held`` inside."""
    w = F.split("phrase", " ")
    spans = F.explode(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(
        F.sequence(F.lit(1), F.size(w) - i + 1), lambda k: F.array_join(F.slice(w, i, k), " "))))
    inside = phrases.select("lang", F.col("phrase").alias("whole"), spans.alias("parts")) \
        .select("lang", "whole", F.explode("parts").alias("phrase")).join(held, ["lang", "phrase"], "left_semi") \
        .select("lang", F.col("whole").alias("phrase")).distinct()
    return phrases.join(inside, ["lang", "phrase"], "left_anti")


def exact_score(a: str, left: str, right: str) -> Column:
    """floor(2000000 a / (left + right)) of long columns; products may pass 64 bits."""
    a, left, right = (F.col(c).cast("decimal(20,0)") for c in (a, left, right))
    product, total = F.lit(2000000).cast("decimal(7,0)") * a, left + right
    return ((product - product % total) / total).cast("decimal(38,0)").cast("long")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", minimum: int = 30, longest: int = 4,
                 top: int = 2000, cover: int = 80, sample: int = SAMPLE) -> DataFrame:
    """Each language's first ``top`` phrases of two words and more: lang, rank,
    phrase, a, l, r, n, score. Of all cuts the lowest score counts; a phrase
    inside a longer one with ``cover`` percent of its occurrences or more goes."""
    found = frequent_phrases(docs, lang, text, minimum, longest, sample)
    totals = found.where("k = 0").select("lang", F.col("n").alias("total"))
    counts = found.where("k > 0")
    words = F.split("phrase", " ")
    candidates = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))

    def joined(frm, size):
        return F.array_join(F.slice("_w", frm, size), " ")

    cut = candidates.withColumn("_w", words).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))) \
        .select("lang", "phrase", "k", "a", "cut", joined(F.lit(1), F.col("cut")).alias("left"),
                joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    l_side = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    r_side = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    scored = cut.join(l_side, ["lang", "left"]).join(r_side, ["lang", "right"]) \
        .withColumn("score", exact_score("a", "l", "r")) \
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    inner = candidates.where("k > 2").withColumn("_w", words) \
        .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1))) \
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1))) \
        .select("lang", joined(F.col("at"), F.col("size")).alias("phrase"), F.col("a").alias("longer")) \
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = F.expr(f"CAST(longer AS DECIMAL(38,0)) * 100 >= CAST(a AS DECIMAL(38,0)) * {int(cover)}")
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~covered)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat = kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    short = flat.withColumn("_part", part) \
        .withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))) \
        .where(F.col("_place") <= top)
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")) \
        .where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"),
                                              "score")
