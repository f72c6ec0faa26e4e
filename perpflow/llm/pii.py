"""Personal data: four base patterns and bootstrapped contextual extraction, in DataFrame operations only.

Base spans are leftmost non-overlapping matches of fixed patterns that also pass a check (octets,
Luhn, digit counts). The bootstrap then learns where such data stands:

1. seeds: whole valid base spans, each an instance with its kind; of spans that overlap the first. An instance is lower case,
   and its digits alone if it is a card, a phone or made of digits, brackets, dashes and spaces;
2. patterns: the one and the two words before a seed or a candidate. A candidate is a run of words of digits, brackets, dashes and dots
   with single spaces between them, or another word that holds a digit or an at sign, outside all base spans;
3. a graph of instances and patterns, weighted by how often they meet, is scored in turn for ``ROUNDS`` rounds:
   a pattern by the reliability of all its instances, an instance by that of its patterns;
4. patterns with at least ``MIN_INSTANCES`` reliable instances and reliability of ``TRUST`` give their kind to
   the candidates in them, from end to end.

Texts are passed over once for spans and once for candidates; what follows works on those few. Patterns and
instances are aggregated before every shuffle and joined, never gathered.

Offsets are code points, end exclusive. Matching time is linear in the text: a match can only
begin where a run of its characters begins, or where the last match ended.

Cases: null text is empty; texts without personal data give a row without spans; repeated rows
give repeated rows; equal texts under one id share what is found; ties between kinds go to the
first in the order of KINDS; an empty table gives an empty result; extra columns are ignored by
``find`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from perpflow.llm.text import steady
from perpflow.session import cut_lineage

ROUNDS = 3
TRUST = 0.9
MIN_INSTANCES = 5
#: The kinds of base spans, in the order in which ties are listed.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns; possessive, and begun only at the start of a run or at the end of the last match.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no match of the pattern.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Base spans are overwritten with this before candidates are looked for, so that each is one word.
MASK = "\ue000"
_NUMBER = rf"[(+-]*+[0-9][0-9().+-]*+(?=[^\p{{L}}\p{{N}}\s@{MASK}]*+(?!\S))"
TOKEN = rf"(?:(?<!\S)|\G)(?:{_NUMBER}(?:(?<=[0-9)])\x20{_NUMBER})*+\S*+|[^\s0-9@{MASK}]*+[0-9@{MASK}]\S*+)"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, stop, match, before) of all matches; ``before`` is the text just before, 64 characters at most.

    Pieces between matches and the matches themselves are laid end to end; finished blocks of 256
    spans are put aside so that very many matches stay cheap.
    """
    span = "struct<start: bigint, stop: bigint, match: string, before: string>"
    zero = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{span}>").alias("some"), F.array().cast(f"array<array<{span}>>").alias("full"))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["piece"])
        stop = start + F.length(part["match"])
        one = F.array(F.struct(start.alias("start"), stop.alias("stop"), part["match"].alias("match"), F.right(part["piece"], F.lit(64)).alias("before")))
        more = F.when(
            F.size(acc["some"]) >= 256, F.struct(stop.alias("at"), one.alias("some"), F.concat(acc["full"], F.array(acc["some"])).alias("full"))
        ).otherwise(F.struct(stop.alias("at"), F.concat(acc["some"], one).alias("some"), acc["full"].alias("full")))
        return F.when(part["match"].isNull(), acc).otherwise(more)

    return F.aggregate(parts, zero, step, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["some"]))))


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        octet = lambda p: F.length(F.regexp_replace(p, r"^0+(?=.)", "")) <= 3
        small = lambda p: F.when(octet(p), F.regexp_replace(p, r"^0+(?=.)", "")).otherwise("999").cast("int") <= 255
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _base(kind: str, text: Column) -> Column:
    """Valid spans of a kind as (start, kind number, stop)."""
    order = KINDS.index(kind)
    need = F.contains(text, F.lit(NEEDED[kind])) if NEEDED[kind] else text.rlike("[0-9]")
    if kind == "ip":
        need = need & text.rlike(r"[0-9]\.[0-9]")
    kept = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["match"]))
    spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("kind"), m["stop"].alias("stop")))
    return F.when(need, spans).otherwise(F.array().cast("array<struct<start: bigint, kind: int, stop: bigint>>"))


def _masked(text: Column, base: Column) -> Column:
    """The text with every base span overwritten, at the same length."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        start, stop = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["stop"])
        cut = F.substr(text, acc["at"].cast("int") + 1, (start - acc["at"]).cast("int"))
        return F.struct(stop.alias("at"), F.concat(acc["parts"], F.array(cut, F.repeat(F.lit(MASK), (stop - start).cast("int")))).alias("parts"))

    whole = F.aggregate(base, zero, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, acc["at"].cast("int") + 1)))
    return F.when(F.size(base) == 0, text).otherwise(whole)


def _apart(base: Column) -> Column:
    """Of base spans that overlap, the first."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start: bigint, kind: int, stop: bigint>>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["stop"].alias("at"), F.concat(acc["kept"], F.array(s)).alias("kept")))

    return F.aggregate(base, zero, step, lambda acc: acc["kept"])


def _instance(text: Column, kind: Column) -> Column:
    digits = kind.isin(KINDS.index("card"), KINDS.index("phone")) | (kind.isNull() & text.rlike(r"^[\x20()0-9+-]++$"))
    return F.when(digits, F.regexp_replace(text, "[^0-9]", "")).otherwise(F.lower(text))


def _tokens(text: Column, masked: Column, base: Column, seeds: Column) -> Column:
    """Seeds, which have a kind, and candidates, trimmed of marks around them, with the two words before."""
    found = F.when(masked.rlike(f"[0-9@{MASK}]"), matches(masked, TOKEN)).otherwise(
        F.array().cast("array<struct<start: bigint, stop: bigint, match: string, before: string>>"))
    none = F.lit(None).cast("int")

    def tidy(m: Column) -> Column:
        front = F.length(F.regexp_extract(m["match"], r"^[^\p{L}\p{N}@+(]*+", 0))
        core = F.regexp_replace(F.substr(m["match"], front + 1), r"[^\p{L}\p{N}]++$", "")
        words = F.filter(F.split(F.lower(m["before"]), r"\s+"), lambda w: w != "")
        one = F.when(F.size(words) >= 1, F.concat(F.lit("1 "), F.element_at(words, -1)))
        two = F.when(F.size(words) >= 2, F.concat(F.lit("2 "), F.array_join(F.slice(words, -2, 2), " ")))

        def row(start: Column, stop: Column, token: Column, kind: Column) -> Column:
            return F.struct(start.alias("start"), stop.alias("stop"), token.alias("token"), one.alias("one"), two.alias("two"), kind.alias("kind"))

        candidate = F.array(row(m["start"] + front, m["start"] + front + F.length(core), _instance(core, none), none))
        inside = F.filter(seeds, lambda b: (b["start"] >= m["start"]) & (b["start"] < m["stop"]))
        whole = F.transform(inside, lambda b: row(
            b["start"], b["stop"], _instance(F.substr(text, b["start"].cast("int") + 1, (b["stop"] - b["start"]).cast("int")), b["kind"]), b["kind"]))
        covered = F.exists(base, lambda b: (b["start"] < m["stop"]) & (b["stop"] > m["start"]))
        return F.when(covered, whole).when(core.rlike("[0-9@]"), candidate).otherwise(F.slice(candidate, 1, 0))

    return F.flatten(F.transform(found, tidy))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, base, tokens): what is found in the texts."""
    steady(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    spans = rows.select("doc_id", "text", F.array_sort(F.concat(*(_base(k, F.col("text")) for k in KINDS))).alias("base"))
    masked = spans.select("*", _masked(F.col("text"), F.col("base")).alias("masked"), _apart(F.col("base")).alias("seeds"))
    return masked.select(
        "doc_id", F.xxhash64("text").alias("digest"), "base",
        _tokens(F.col("text"), F.col("masked"), F.col("base"), F.col("seeds")).alias("tokens"))


def _occurrences(found: DataFrame) -> DataFrame:
    """Seeds, which have a kind, and candidates in their patterns."""
    token = found.select("doc_id", "digest", F.explode("tokens").alias("t")).select("doc_id", "digest", "t.*")
    return token.withColumn("pattern", F.explode(F.array("one", "two"))).where("pattern IS NOT NULL").select(
        "doc_id", "digest", "start", "stop", "token", "kind", "pattern")


def trusted_patterns(occurrences: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, least: int = MIN_INSTANCES) -> DataFrame:
    """(pattern, kind, reliability): patterns in which a token may be taken for a kind."""
    edges = cut_lineage(occurrences.groupBy("token", "pattern").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind")))
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    seeds = edges.where("kind IS NOT NULL").groupBy("token").agg(F.min("kind").alias("kind")).withColumn("reliability", F.lit(1.0))
    strength = edges.groupBy("token").agg(F.sum("n").alias("total"))
    instances, patterns = seeds, None
    for turn in range(rounds):
        met = edges.select("token", "pattern", "n").join(instances, "token")
        patterns = (
            met.groupBy("pattern", "kind").agg(
                F.sum(F.col("n") * F.col("reliability")).alias("weight"), F.sum((F.col("reliability") >= trust).cast("int")).alias("support"))
            .join(totals, "pattern").select("pattern", "kind", (F.col("weight") / F.col("total")).alias("reliability"), "support"))
        patterns = cut_lineage(patterns)
        if turn == rounds - 1:
            break
        strong = patterns.where(F.col("support") >= least)
        learned = (
            edges.select("token", "pattern", "n").join(strong, "pattern").groupBy("token", "kind")
            .agg(F.sum(F.col("n") * F.col("reliability")).alias("weight")).join(strength, "token")
            .select("token", "kind", (F.col("weight") / F.col("total")).alias("reliability"))
            .join(seeds.select("token"), "token", "left_anti"))
        instances = cut_lineage(seeds.unionByName(learned))
    return patterns.where((F.col("support") >= least) & (F.col("reliability") >= trust)).select("pattern", "kind", "reliability")


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, least: int = MIN_INSTANCES) -> DataFrame:
    """(doc_id, digest, base, all_spans) for every row; spans are (start, kind number, stop)."""
    found = cut_lineage(base_spans(docs))
    seen = _occurrences(found)
    new = (
        seen.where("kind IS NULL").drop("kind").join(trusted_patterns(seen, rounds, trust, least), "pattern")
        .groupBy("doc_id", "digest", "start", "stop").agg(F.max(F.struct("reliability", -F.col("kind"))).alias("best"))
        .groupBy("doc_id", "digest").agg(
            F.collect_list(F.struct("start", (-F.col("best.col2")).alias("kind"), "stop")).alias("added")))
    same = F.col("f.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("f.digest") == F.col("n.digest"))
    nothing = F.array().cast("array<struct<start: bigint, kind: int, stop: bigint>>")
    return found.drop("tokens").alias("f").join(new.alias("n"), same, "left").select(
        "f.doc_id", "f.digest", "f.base", F.array_sort(F.concat("f.base", F.coalesce("n.added", nothing))).alias("all_spans"))


def _is(order: int):
    return lambda span: span["kind"] == order


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """Counts and digest of the base spans, and all spans written out, for every row."""
    found = find(docs, **options)
    counts = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("all_spans")).alias("spans"),
        (F.size("all_spans") - F.size("base")).cast("long").alias("n_found"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span (and whatever overlaps it) replaced by the kind in brackets."""
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        cut = F.substr(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        fresh = F.struct(s["stop"].alias("at"), F.concat(acc["parts"], F.array(cut, F.get(tags, s["kind"]))).alias("parts"))
        longer = F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["parts"].alias("parts"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(longer)

    return F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, acc["at"].cast("int") + 1)))


def redact(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with personal data in ``text`` replaced, all columns kept."""
    spans = find(docs, **options).where("size(all_spans) > 0").groupBy("doc_id", "digest").agg(F.first("all_spans").alias("all_spans"))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("s.doc_id")) & (F.xxhash64(F.coalesce("d.text", F.lit(""))) == F.col("s.digest"))
    joined = docs.alias("d").join(spans.alias("s"), same, "left")
    new = F.when(F.col("s.all_spans").isNull(), F.col("d.text")).otherwise(redacted(F.col("d.text"), F.col("s.all_spans")))
    return joined.select(*(new.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns))
