"""License scans by ordered signature rules.

A text is reduced to its words once; one Aho-Corasick pass over them finds
which rules' keywords occur, and only those rules' expressions run; the base
phrases are searched in every text. Detections
are taken by falling priority (then by place, then the longer one); one whose
words lie inside those of a detection already taken is suppressed.

Defined results: a null text counts as empty; a text without words has no
detections and score 0; overlapping places of one phrase all count; equal
detections of one place are one; repeated rows are rows of their own; an empty
table gives an empty frame; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stanceflow.llm.bpe import slices
from stanceflow.llm.common import cached
from stanceflow.llm.license_rules import BASE, Signature, signatures

SPACE = re.compile(" ")

#: Lower case for A-Z, a space for the other ASCII bytes that are no word bytes.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32
                   for b in range(256))


class Reach:
    """Largest end among the intervals that start at or before a place
    (a Fenwick tree of maxima: logarithmic, whatever the number of hits)."""

    def __init__(self):
        self.most: dict[int, int] = {}

    def add(self, start: int, end: int, size: int) -> None:
        i = start + 1
        while i <= size:
            self.most[i] = max(self.most.get(i, -1), end)
            i += i & -i

    def __call__(self, start: int) -> int:
        i, best = start + 1, -1
        while i:
            best = max(best, self.most.get(i, -1))
            i -= i & -i
        return best


class Scanner:
    def __init__(self, rules: list[Signature]):
        self.rules = [(r, regex.compile(rf"(?<= )(?:{r.pattern})(?= )")) for r in rules]
        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for word in r.keyword.split("|"):
                by.setdefault(word, []).append(i)
        for word, which in by.items():
            self.automaton.add_word(word, which)
        self.automaton.make_automaton()

    def words(self, text: str) -> list[bytes]:
        return text.encode().translate(WORD_BYTES).split()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, int]]]:
        """Base places (first word, label), and the detections that stand."""
        line = f" {b' '.join(words).decode()} "
        which = {i for _, rules in self.automaton.iter(line) for i in rules}
        places = []
        for phrase, label in BASE:
            at = line.find(f" {phrase} ")
            while at >= 0:
                places.append((at + 1, label))
                at = line.find(f" {phrase} ", at + 1)
        if not which and not places:
            return [], []
        spaces = [m.start() for m in SPACE.finditer(line)]

        def word_at(place: int) -> int:
            """Number of the word that starts at a place of the line."""
            return bisect_left(spaces, place) - 1

        base = [(word_at(at), label) for at, label in places]
        hits = []
        for i in sorted(which):
            rule, pattern = self.rules[i]
            for m in pattern.finditer(line):
                first = word_at(m.start())
                hits.append((-rule.priority, first, -(first + m[0].count(" ") + 1), i))
        taken: list[tuple[int, int, str, int]] = []
        reach = Reach()
        for priority, first, end, i in sorted(hits):
            if reach(first) < -end:
                taken.append((first, -end, self.rules[i][0].label, -priority))
                reach.add(first, -end, len(spaces))
        return sorted(base), sorted(taken)


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
         rules: list[Signature] | None = None) -> DataFrame:
    """``keep`` columns + n_words, base (array of struct<word, label>) and
    detections (array of struct<first, end, label, priority>)."""
    rules = rules or signatures()
    place = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType())]))
    found = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType()),
                                      T.StructField("label", T.StringType()), T.StructField("priority", T.LongType())]))
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_words", T.LongType()),
                           T.StructField("base", place), T.StructField("detections", found)])
    n = len(keep)
    key = ("licenses", hash(tuple(rules)))

    def run(batches):
        scanner = cached(key, lambda: Scanner(rules))
        base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        hit_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()),
                                       ("priority", pa.int64())]))
        for batch in batches:
            sizes, bases, hits = [], [], []
            for _, texts in slices(batch.column(n)):
                for t in texts:
                    words = scanner.words(t)
                    base, taken = scanner.scan(words)
                    sizes.append(len(words))
                    bases.append([{"word": w, "label": lab} for w, lab in base])
                    hits.append([{"first": a, "end": b, "label": lab, "priority": p} for a, b, lab, p in taken])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(sizes, pa.int64()), pa.array(bases, base_type), pa.array(hits, hit_type)],
                names=[*batch.schema.names[:n], "n_words", "base", "detections"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    def joined(*arrays):
        labels = F.concat(*[F.transform(a, lambda x: x["label"]) for a in arrays])
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    starts = F.transform("base", lambda x: x["word"])
    # chance that at least one detection is right, each by its priority
    wrong = F.aggregate("detections", F.lit(1.0), lambda a, x: a * (1 - x["priority"] / 100))
    return scan(docs).select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
                             F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                             joined(F.col("base")).alias("base_labels"),
                             joined(F.col("base"), F.col("detections")).alias("labels"),
                             (1 - wrong).alias("score"))
