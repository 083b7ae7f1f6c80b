"""Secrets in documents, by a ledger of scanned contents.

Every text is addressed by its SHA-256. The ledger holds one row per (content, rule, rule version) that was ever
scanned, with the spans found; a run scans only pairs that are missing, appends them, and joins the findings back to
all documents that hold the content. Everything is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.blocks import unused


@dataclass(frozen=True)
class Rule:
    """A pattern; ``least`` characters of group ``group`` make a match a finding. Raise ``version`` with any change."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join([*map(any_case, ("password", "passwd", "secret", "token")), any_case("api") + "_?" + any_case("key")])
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# The least lengths of access keys and hex strings stand in the pattern: a run that is too short holds no long one.
RULES = (Rule("assign", ASSIGN, 2, 12), Rule("access", "AKIA[A-Z0-9]{14,}"), Rule("hex", "[0-9a-f]{16,}"))
SPANS = "array<struct<start:int,end:int>>"
LEDGER = f"content binary, rule string, version int, spans {SPANS}"
PART = 256  # items whose results are appended one by one; the parts are then appended whole
STRIP = 1024  # code points of a text that are walked to reach a position in it


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step(at, item)`` gives for one item after the other: the next ``at`` (an integer, 0 at first) and an array of ``kind`` to append.

    An append copies what is there, so items are taken in parts of ``PART``: the work grows with the items, not with their square.
    """
    none = F.array().cast(f"array<{kind}>")

    def append(acc: Column, x: Column) -> Column:
        at, more = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], more).alias("out"))

    def part(acc: Column, xs: Column) -> Column:
        return F.aggregate(xs, F.struct(acc["at"].alias("at"), none.alias("out")), append, lambda s: F.struct(s["at"].alias("at"), F.concat(acc["out"], F.array(s["out"])).alias("out")))

    def parts(xs: Column) -> Column:
        last = F.greatest(F.floor((F.size(xs) - 1) / PART), F.lit(0))
        return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.slice(xs, (k * PART + 1).cast("int"), PART))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.flatten(F.aggregate(let(items, parts), start, part, lambda acc: acc["out"]))


def spans_of(text: Column, rule: Rule) -> Column:
    """Leftmost matches that do not overlap, as code points (start, end exclusive); short ones are dropped at the end."""
    matched, sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matched.alias("hit"), sized.alias("part"))  # the last gap has no hit
    lengths = F.transform(F.filter(steps, lambda x: x["hit"].isNotNull()), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["part"]).alias("part")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        end = at + x["gap"] + x["hit"]
        span = F.array(F.struct((at + x["gap"]).alias("start"), end.alias("end")))
        return end, F.when(x["part"] >= rule.least, span).otherwise(F.array().cast(SPANS))

    return F.when(text.rlike(rule.pattern), running(lengths, "struct<start:int,end:int>", step)).otherwise(F.array().cast(SPANS))


def content_key() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("content")


def record(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks of the texts of ``docs``, add it, and return the ledger. Null texts count as empty."""
    spark = docs.sparkSession
    spark.createDataFrame([], LEDGER).coalesce(1).write.mode("append").parquet(ledger)  # a new ledger starts empty
    active = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    # copies fall together before the shuffle
    texts = docs.select(content_key(), F.coalesce("text", F.lit("")).alias("text")).groupBy("content").agg(F.first("text").alias("text"))
    done = spark.read.schema(LEDGER).parquet(ledger).groupBy("content").agg(F.collect_set(F.struct("rule", "version")).alias("done"))
    missing = F.array_except(active, F.coalesce("done", F.array().cast("array<struct<rule:string,version:int>>")))
    texts = texts.join(done, "content", "left").withColumn("todo", missing).where(F.size("todo") > 0)
    entries = [
        F.when(F.array_contains("todo", F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"))), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r).alias("spans")))
        for r in rules
    ]
    scanned = texts.select("content", F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("e")).select("content", "e.*")
    scanned.write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, name: str = "findings") -> DataFrame:
    """Every column of ``docs`` and ``name``: array of (start, kind, end, rank), by start, then rank of the rule.

    ``ledger`` is a folder that all executors reach; it is made when missing. Null texts count as empty. Equal texts are
    scanned once, whatever their number; a text is scanned again only for rules or versions it has not met. A column of ``docs``
    called ``name`` is replaced. Repeated rows each get their row; empty tables give an empty result. Work and memory grow with the
    length of a text and the number of its findings. One run writes a ledger at a time.
    """
    known = record(docs, ledger, rules)
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule")).cast("int")
    versions = docs.sparkSession.createDataFrame([(r.kind, r.version) for r in rules], "rule string, version int")
    current = known.where(F.size("spans") > 0).join(F.broadcast(versions), ["rule", "version"])
    listed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank"), s["end"].alias("end"), F.col("rule").alias("kind")))
    findings = current.withColumn("rank", rank).withColumn("found", listed).groupBy("content").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("findings"))
    kept = docs.drop(name)
    key, own = unused(kept.columns, "__content"), unused(kept.columns, "__findings")
    rows = kept.withColumn(key, content_key()).join(findings.withColumnsRenamed({"content": key, "findings": own}), key, "left")
    found = F.coalesce(own, F.array().cast(findings.schema["findings"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in kept.columns], found.alias(name))


def listed(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def redact(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with ``mark`` in place of each finding; findings that overlap become one.

    ``findings`` stand by rising start. What lies between them is taken from strips of the text, as a position is found only by walking to it.
    """
    def step(at: Column, f: Column) -> tuple[Column, Column]:
        gap = F.array(F.struct(at.alias("start"), f["start"].alias("end")))
        return F.greatest(at, f["end"]), F.when(f["start"] >= at, gap).otherwise(F.array().cast(SPANS))

    def cut(strips: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / STRIP).cast("int"), F.floor(end / STRIP).cast("int")

        def piece(strip: Column, k: Column) -> Column:
            low = F.when(k == 0, start % STRIP).otherwise(F.lit(0))
            high = F.when(k == last - first, end % STRIP).otherwise(F.lit(STRIP))
            return F.substring(strip, low + 1, high - low)

        return F.array_join(F.transform(F.slice(strips, first + 1, last - first + 1), piece), "")

    def rest(strips: Column) -> Column:
        kept = F.transform(running(findings, "struct<start:int,end:int>", step), lambda g: F.concat(cut(strips, g["start"], g["end"]), F.lit(mark)))
        tail = cut(strips, F.array_max(F.transform(findings, lambda f: f["end"])), F.length(text))
        return F.array_join(F.concat(kept, F.array(tail)), "")

    strips = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRIP}}}"), F.lit(0))
    return F.when(F.size(findings) > 0, let(strips, rest)).otherwise(text)
