"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its UTF-8 text).
A ledger holds the (blob, rule, rule version) triples scanned so far; a run
scans only unseen triples and joins the findings back to all paths and
versions of a blob, so copies and unchanged versions cost one hash each.

Everything is DataFrame expressions. Spark has no function for the places of
all matches; they come from ``split`` (the gaps) and ``regexp_extract_all``
(the matches) of the same pattern, whose lengths alternate through the text.
Positions are code points, the end is exclusive.

Defined results: a null text is an empty text; an empty text has no findings;
repeated rows are rows of their own (each gets the findings of its blob); an
empty table gives empty frames; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanceflow.llm.common import free_name, staged


@dataclass(frozen=True)
class Rule:
    """``needle``: a literal without which the pattern cannot match (a cheap
    test before the regex). ``group``/``least``: a match counts if that group
    has at least ``least`` characters; failing matches still consume text."""

    kind: str
    pattern: str
    version: int = 1
    needle: str | None = None
    group: int = 0
    least: int = 0


# The three base kinds. ``[0-9a-f]{24,}`` finds the runs of
# ``[0-9a-f]+`` with 24+ characters (runs are maximal, so short ones never hide
# a long one), likewise AKIA + 16. The assignment keeps its open form, since a
# failing match consumes text there.
ASSIGN = Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
              group=2, least=6)
ACCESS = Rule("access", r"AKIA[A-Z0-9]{16,}", needle="AKIA")
HEX = Rule("hex", r"[0-9a-f]{24,}")
BASE_RULES = (ASSIGN, ACCESS, HEX)

#: Our own additions: vendor token shapes and key blocks.
EXTRA_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", needle="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", needle="xox"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", needle="AIza"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", needle="eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", needle="PRIVATE KEY-----"),
)
RULES = BASE_RULES + EXTRA_RULES

SPAN = "array<struct<start:int,ord:int,kind:string,end:int,rule_version:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column], zero: int, levels: int = 2,
            block: int = 128) -> Column:
    """For each integer of an array, ``op`` over all before it (``zero`` for the
    first). Arrays are built block by block, as appending to one array copies it."""
    def plain(part):
        state = F.struct(F.lit(zero).alias("all"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, state, lambda s, x: F.struct(
            op(s["all"], x).cast("int").alias("all"), F.concat(s["out"], F.array(s["all"])).alias("out")))

    def blocks(v):
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block))
        return F.transform(starts, lambda b: plain(F.slice(v, (b * block + 1).cast("int"), F.lit(block))))

    def joined(parts):
        tops = running(F.transform(parts, lambda p: p["all"]), op, zero, levels - 1, block)
        return F.flatten(F.zip_with(parts, tops, lambda p, top: F.transform(
            p["out"], lambda x: op(top, x).cast("int"))))

    if levels == 1:
        return plain(values)["out"]
    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), joined)).otherwise(
        F.array().cast("array<int>")))


STEPS = "array<struct<gap:int,hit:int,part:int>>"


def steps_of(text: Column, rule: Rule) -> Column:
    """Per match of a rule the lengths of the gap before it, of the match and of
    the group that counts (and a last gap without a match)."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    steps = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
                         F.transform(matches, F.length).alias("hit"), F.transform(groups, F.length).alias("part"))
    test = text.rlike(rule.pattern)
    if rule.needle:
        test = F.contains(text, F.lit(rule.needle)) & test
    return F.when(test, steps).otherwise(F.array().cast(STEPS))


def spans_of(text: Column, rules: tuple[Rule, ...], todo: Column) -> Column:
    """Matches of the rules whose kinds are in ``todo``, rule by rule, as
    array<struct<start, ord, kind, end, rule_version>>. Linear in the text:
    places are running sums of the gaps' and matches' lengths."""
    each = [F.struct(F.when(F.array_contains(todo, r.kind), steps_of(text, r)).otherwise(F.array().cast(STEPS))
                     .alias("steps"), F.lit(i).alias("ord"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"),
                     F.lit(r.version).alias("rule_version")) for i, r in enumerate(rules)]

    def placed(r):
        before = running(F.transform(r["steps"], lambda s: s["gap"] + F.coalesce(s["hit"], F.lit(0))),
                         lambda x, y: x + y, 0)
        return F.filter(F.zip_with(r["steps"], before, lambda s, at: F.when(s["part"] >= r["least"], F.struct(
            (at + s["gap"]).alias("start"), r["ord"].alias("ord"), r["kind"].alias("kind"),
            (at + s["gap"] + s["hit"]).alias("end"), r["rule_version"].alias("rule_version")))),
            lambda s: s.isNotNull())

    return F.flatten(F.transform(F.array(*each), placed))


@dataclass
class Scan:
    """versions: the input's key columns + blob_id (``blob`` is its name there). findings: blob_id, spans
    (array by start, then rule order; blobs without findings have no row).
    ledger: blob_id, rule, rule_version of the triples seen so far, of rules in their present version only:
    findings of other versions are not kept, so their return is a new scan."""

    versions: DataFrame
    findings: DataFrame
    ledger: DataFrame
    blob: str = "blob_id"


def scan(docs: DataFrame, keys: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES,
         ledger: DataFrame | None = None, earlier: DataFrame | None = None) -> Scan:
    """Scan the unseen (blob, rule version) pairs of ``docs``.

    ``ledger`` and ``earlier`` are a former run's ``ledger`` and ``findings``, of
    which only what the present rule versions found is kept;
    ``keys`` are the columns that name a path and its version."""
    if len({(r.kind, r.version) for r in rules}) < len(rules):
        raise ValueError("two rules of one kind and version: a ledger cannot tell them apart")
    blob = free_name("blob_id", keys)
    body = free_name("_body", [*keys, blob])
    base = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias(body)) \
        .withColumn(blob, F.unhex(F.sha2(F.col(body).cast("binary"), 256)))
    versions = base.drop(body)
    blobs = base.select(F.col(blob).alias("blob_id"), F.col(body).alias("body")).dropDuplicates(["blob_id"])
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
    else:
        pairs = blobs.select("blob_id", F.inline(wanted))
        unseen = pairs.join(ledger, ["blob_id", "rule", "rule_version"], "left_anti") \
            .groupBy("blob_id").agg(F.collect_set("rule").alias("todo"))
        todo = blobs.join(unseen, "blob_id")
    spans = spans_of(F.col("body"), tuple(rules), F.col("todo"))
    fresh = todo.select("blob_id", spans.alias("spans")).where(F.size("spans") > 0)
    if earlier is not None:
        def place(s):
            """Place of the span's rule among the present ones, null if it is none of them."""
            return F.coalesce(*[F.when((s["kind"] == r.kind) & (s["rule_version"] == r.version), F.lit(i))
                                for i, r in enumerate(rules)])

        kept = F.transform(F.filter("spans", lambda s: place(s).isNotNull()), lambda s: F.struct(
            s["start"].alias("start"), place(s).alias("ord"), s["kind"].alias("kind"), s["end"].alias("end"),
            s["rule_version"].alias("rule_version")))
        old = earlier.select("blob_id", kept.alias("spans")).where(F.size("spans") > 0)
        fresh = fresh.unionByName(old).groupBy("blob_id") \
            .agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    findings = fresh.select("blob_id", F.sort_array("spans").alias("spans"))
    seen = blobs.select("blob_id", F.inline(wanted))
    if ledger is not None:
        present = F.struct("rule", "rule_version").isin(*[F.struct(F.lit(r.kind), F.lit(r.version)) for r in rules])
        seen = seen.unionByName(ledger.select("blob_id", "rule", "rule_version").where(present)).distinct()
    return Scan(versions, findings, seen, blob)


def join_back(result: Scan) -> DataFrame:
    """Findings on every path and version: key columns, blob, spans (empty
    array if none). The findings (one row per blob that has any) are written
    first: Spark then knows their size, and a blob with very many paths is the
    key of a plain join, which adaptive execution can split."""
    v = result.versions
    if "spans" in {c.lower() for c in v.columns}:
        raise ValueError("a key column is named spans")
    blob, spans = free_name("_blob", v.columns), free_name("_spans", v.columns)
    f = staged(result.findings, "findings").withColumnsRenamed({"blob_id": blob, "spans": spans})
    return v.join(f, v[result.blob] == F.col(blob), "left").drop(blob) \
        .withColumn("spans", F.coalesce(F.col(spans), F.array().cast(SPAN))).drop(spans)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


#: Characters in a piece of a text that is being redacted.
PIECE = 4096


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each maximal run of overlapping spans replaced by one
    ``[kind]`` mark (the kind of the run's first span).

    Each span's part beyond all earlier ones goes, cut at the borders of pieces
    of the text; each piece is put together from what stays of it."""
    def parts(found):
        reached = running(F.transform(found, lambda s: s["end"]), lambda x, y: F.greatest(x, y), 0)

        def cut(s, till):
            start = F.greatest(s["start"], till)
            mark = F.when(s["start"] >= till, F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
            pieces = F.sequence(F.floor(start / PIECE), F.floor((s["end"] - 1) / PIECE))
            return F.when(s["end"] > till, F.transform(pieces, lambda p, i: F.struct(
                p.cast("int").alias("piece"), (F.greatest(start, p * PIECE) - p * PIECE).cast("int").alias("start"),
                (F.least(s["end"], (p + 1) * PIECE) - p * PIECE).cast("int").alias("end"),
                F.when(i == 0, mark).otherwise(F.lit("")).alias("mark"))))

        return F.flatten(F.filter(F.zip_with(found, reached, cut), lambda x: x.isNotNull()))

    def put_together(gone):
        def of_piece(piece, p, owners):
            first = F.array_position(owners, p.cast("int"))
            mine = F.filter(F.slice(gone, first.cast("int"), F.lit(PIECE)), lambda g: g["piece"] == p)
            state = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
            text_ = F.aggregate(mine, state, lambda acc, g: F.struct(g["end"].alias("pos"), F.concat(
                acc["out"], F.substring(piece, acc["pos"] + 1, g["start"] - acc["pos"]), g["mark"]).alias("out")),
                lambda acc: F.concat(acc["out"], F.substring(piece, acc["pos"] + 1, F.lit(PIECE))))
            return F.when(first > 0, text_).otherwise(piece)

        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        return let(F.transform(gone, lambda g: g["piece"]), lambda owners: F.array_join(
            F.transform(pieces, lambda piece, p: of_piece(piece, p, owners)), ""))

    return F.when(F.size(spans) == 0, text).otherwise(
        let(F.sort_array(spans), lambda found: let(parts(found), put_together)))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, hash of the base spans, all spans."""
    rows = join_back(scan(docs, [key], text))
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_RULES))

    def count(rule):
        return F.size(F.filter("spans", lambda s: s["kind"] == rule.kind)).cast("long")

    return rows.select(key, count(ASSIGN).alias("n_assign"), count(ACCESS).alias("n_access"),
                       count(HEX).alias("n_hex"), F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
                       spans_text(F.col("spans")).alias("spans"))


#: Bits (a power of two) of the table that tells which blobs may have findings.
TABLE_BITS = 20


def may_be_found(blob: Column, findings: DataFrame, bits: int = TABLE_BITS) -> Column:
    """False for most blobs without findings, true for all with some: one bit of
    a table of fixed size, whatever the number of findings."""
    spark = findings.sparkSession
    place = F.xxhash64("blob_id").bitwiseAND(F.lit((1 << bits) - 1))
    cells = findings.select(F.shiftright(place, 6).alias("cell"), F.expr("1L").alias("one"),
                            place.bitwiseAND(F.lit(63)).cast("int").alias("at")) \
        .select("cell", F.expr("shiftleft(one, at)").alias("bits"))
    every = spark.range(1 << (bits - 6)).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("bits"))
    table = cells.unionByName(every).groupBy("cell").agg(F.bit_or("bits").alias("bits")) \
        .agg(F.array_sort(F.collect_list(F.struct("cell", "bits"))).alias("t")) \
        .select(F.transform("t", lambda x: x["bits"]).alias("t"))
    mine = F.xxhash64(blob).bitwiseAND(F.lit((1 << bits) - 1))
    word = F.get(table.scalar(), F.shiftright(mine, 6).cast("int"))
    return F.call_function("getbit", word, mine.bitwiseAND(F.lit(63)).cast("int")) == 1


def redact_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every found secret replaced by its ``[kind]`` mark and
    ``n_chars`` (if there) brought up to date; clean rows are unchanged.

    Rows whose blob cannot be among the findings go through as they are. The
    others meet the findings (one row per blob with secrets) in a merge join:
    they grow with the corpus, so they are broadcast at no size."""
    cols = docs.columns
    blob, spans = free_name("_blob", cols), free_name("_spans", cols)
    found = staged(scan(docs, [], text).findings, "findings")
    keyed = docs.withColumn(blob, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))
    maybe = may_be_found(F.col(blob), found)
    marks = found.select(F.col("blob_id").alias(blob), F.col("spans").alias(spans))
    out = keyed.where(maybe).join(marks.hint("merge"), blob, "left")
    hit = F.col(spans).isNotNull()
    out = out.withColumn(text, F.when(hit, redact(F.col(text), F.col(spans))).otherwise(F.col(text)))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(hit, F.length(text).cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*cols).unionByName(keyed.where(~maybe).select(*cols))


def scan_incremental(docs: DataFrame, keys: list[str], path: str, text: str = "text",
                     rules: tuple[Rule, ...] = RULES) -> Scan:
    """``scan`` with a ledger kept under ``path`` (Parquet: findings, ledger), which
    is made by the first run. A run scans only what the ledger lacks and appends
    that; the findings come back whole. They are written before the ledger, so a
    run that dies between is made up for by the next one's scan."""
    spark = docs.sparkSession
    parts = {"ledger": "blob_id binary, rule string, rule_version int", "findings": f"blob_id binary, spans {SPAN}"}
    kept = {}
    for name, schema in parts.items():
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{name}")
        kept[name] = spark.read.schema(schema).parquet(f"{path}/{name}")
    before = staged(kept["ledger"], "ledger")
    fresh = scan(docs, keys, text, rules, before)
    fresh.findings.write.mode("append").parquet(f"{path}/findings")
    new = fresh.ledger.join(before, ["blob_id", "rule", "rule_version"], "left_anti")
    new.write.mode("append").parquet(f"{path}/ledger")
    every = spark.read.schema(parts["findings"]).parquet(f"{path}/findings")
    known = spark.read.schema(parts["ledger"]).parquet(f"{path}/ledger")
    return scan(docs, keys, text, rules, known, every)
