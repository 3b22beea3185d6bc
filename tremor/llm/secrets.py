"""Operator 13: secret scans by a trigram inverted index. DataFrame functions only.

Every rule is a regular expression. From its parse the Boolean trigram query that each match must meet
is derived: a literal needs all of its trigrams, alternatives need one of their queries, and what can
be anything asks for nothing. The index has, for every trigram of the queries and every shard of rows,
the keys of the rows that hold it, letters in either case; the postings of a shard are intersected and
united as the queries say, and only the rows that remain are verified by the rule's expression.
Rules without a mandatory trigram scan all texts.

A shard has about ``SHARD`` rows, so a trigram that every text holds is a bounded list a shard; rows
are dealt by a hash of id and text, and equal rows share a key. Positions come from the lengths of the
matches and of the pieces between them, in blocks, so the work follows the matches of a text.

Defined results: null texts are empty; null ids and rows that repeat are rows as all others; a text
of any length is one row; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import table
from tremor.llm.registry import query

#: Rows of a shard of the index.
SHARD = 4096
#: Matches whose positions are added up one by one; longer lists go by blocks of so many.
CHUNK = 256
#: Strings that a part of a rule may stand for before it counts as anything.
MOST = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group whose length, and least length that, a match must have; 0 is the whole match.
    group: int = 0
    least: int = 1


#: Kinds of the contract, in its order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # a whole run is one match, so the least length of these two can stand in the expression
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Further public formats of credentials.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{15,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"(?i)authorization: bearer [A-Za-z0-9._~+/=-]{16,}"),
)
RULES = BASE + MORE


def _both(kind: str, parts: list):
    """An and / or of queries; None asks for nothing."""
    if kind == "or" and (not parts or None in parts):
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return parts[0] if len(parts) == 1 else (kind, *parts) if parts else None


def _of_strings(strings: set[str]):
    """The query of a part that stands for exactly one of the strings; one that holds another asks for no less."""
    strings = {s for s in strings if not any(o != s and o in s for o in strings)}
    return _both("or", [_both("and", [s[k : k + 3] for k in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items) -> set[str] | None:
    """Lower-case characters of a set, or None where they are many."""
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < MOST:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _node(op, value) -> tuple[set[str] | None, object]:
    """(strings that the node can stand for, or None; its query)."""
    if op is sre.LITERAL:
        return {chr(value).lower()}, None
    if op is sre.IN:
        return _class(value), None
    if op is sre.SUBPATTERN:
        return _sequence(value[3])
    if op is sre.BRANCH:
        each = [_sequence(x) for x in value[1]]
        strings = set().union(*(s for s, _ in each)) if all(s is not None for s, _ in each) else None
        return (strings, None) if strings is not None and len(strings) <= MOST else (None, _both("or", [_of_strings(s) if s is not None else q for s, q in each]))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = value
        strings, found = _sequence(inner)
        if strings is not None and high <= 2 and sum(len(strings) ** n for n in range(low, high + 1)) <= MOST:
            return {"".join(x) for n in range(low, high + 1) for x in product(sorted(strings), repeat=n)}, None
        return None, (found if strings is None else _of_strings(strings)) if low else None
    if op is sre.AT:
        return {""}, None
    return None, None


def _sequence(nodes) -> tuple[set[str] | None, object]:
    """Neighbouring parts with few strings are joined before their trigrams are taken."""
    run, parts, exact = {""}, [], True
    for op, value in nodes:
        strings, found = _node(op, value)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a in run for b in strings}
            continue
        parts += [_of_strings(run), found]
        exact, run = False, strings if strings is not None else {""}
    if exact:
        return run, None
    return None, _both("and", [*parts, _of_strings(run)])


def trigram_query(pattern: str):
    """The Boolean query over lower-case trigrams that every match meets: a trigram, ("and" or "or", queries...), or None."""
    strings, found = _sequence(sre_parser.parse(pattern))
    return found if strings is None else _of_strings(strings)


def trigrams(found) -> list[str]:
    if found is None:
        return []
    return [found] if isinstance(found, str) else sorted({t for part in found[1:] for t in trigrams(part)})


def _keys(found) -> Column:
    """Row keys that meet a query, from the map ``postings`` of a shard."""
    if isinstance(found, str):
        return F.coalesce(F.try_element_at("postings", F.lit(found)), F.array().cast("array<bigint>"))
    out, *rest = map(_keys, found[1:])
    for part in rest:
        out = F.array_intersect(out, part) if found[0] == "and" else F.array_union(out, part)
    return out


def postings(rows: DataFrame, wanted: list[str], shards: int) -> DataFrame:
    """(shard, trigram, keys) of rows (key, text): the rows of each shard that hold each of the trigrams."""
    low = rows.select("key", F.lower("text").alias("low"))  # also lowers letters beyond A-Z, which can only add candidates
    held = low.select("key", F.explode(F.filter(F.split(F.lit("\x01".join(wanted)), "\x01"), lambda t: F.contains(F.col("low"), t))).alias("trigram"))
    return held.groupBy(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "trigram").agg(F.collect_set("key").alias("keys"))


def _named(keys: Column, kind: str) -> Column:
    return F.transform(keys, lambda x: F.struct(x.alias("key"), F.lit(kind).alias("kind")))


def candidates(rows: DataFrame, rules, shards: int) -> DataFrame:
    """(key, kinds): the rules whose trigram query a row (key, text) meets, for rules that have one."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    wanted = sorted({t for q in queries.values() for t in trigrams(q)})
    found = postings(rows, wanted, shards)
    by_shard = found.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("postings"))
    met = [_named(_keys(q), kind) for kind, q in queries.items()]
    return by_shard.select(F.explode(F.concat(*met)).alias("m")).groupBy("m.key").agg(F.collect_set("m.kind").alias("kinds"))


def _running(a: Column) -> Column:
    """Running sums of an array, which is at most CHUNK long or has one entry for each CHUNK matches."""
    return F.aggregate(a, F.array().cast("array<int>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + x)))


def with_spans(rows: DataFrame, rules) -> DataFrame:
    """Adds ``spans`` to rows (text, kinds): an array of (start, place, end, kind), sorted.

    Leftmost matches of each rule that don't overlap, too short ones dropped; positions are code
    points, the end is exclusive. A rule looks at a text if it has no trigram query or is among the
    text's ``kinds``. Steps are projections of their own, so what is used twice is evaluated once.
    """
    text, matches, parts, gaps = F.col("text"), {}, {}, {}
    for k, r in enumerate(rules):
        found = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
        matches[f"w{k}"] = found if trigram_query(r.pattern) is None else F.when(F.array_contains("kinds", F.lit(r.kind)), found)
    rows = rows.withColumns(matches)
    for k, r in enumerate(rules):  # texts without a match are not read again
        parts[f"p{k}"] = F.when(F.size(f"w{k}") > 0, F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group))) if r.group else F.col(f"w{k}")
        gaps[f"g{k}"] = F.when(F.size(f"w{k}") > 0, F.split(text, r.pattern, -1))
    rows = rows.withColumns(parts | gaps)
    rules_of = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), F.col(f"w{k}").alias("w"), F.col(f"p{k}").alias("p"), F.col(f"g{k}").alias("g")) for k, r in enumerate(rules)))
    rows = rows.withColumn("m", F.filter(rules_of, lambda x: F.size(x["w"]) > 0))

    # lengths of each match and the piece before it, in blocks; the piece after the last match is cut off
    def blocks(x: Column) -> Column:
        last = F.floor((F.size(x["w"]) - 1) / CHUNK).cast("int")
        each = F.slice(F.zip_with(x["g"], x["w"], lambda g, w: F.length(g) + F.coalesce(F.length(w), F.lit(0))), F.lit(1), F.size(x["w"]))
        return F.transform(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(each, b * CHUNK + 1, F.lit(CHUNK))), _running)

    rows = rows.withColumn("blocks", F.transform("m", blocks))
    rows = rows.withColumn("before", F.transform("blocks", lambda each: F.concat(F.array(F.lit(0)), _running(F.transform(each, lambda b: F.element_at(b, -1))))))
    ends = F.zip_with("blocks", "before", lambda each, before: F.flatten(F.zip_with(each, F.slice(before, F.lit(1), F.size(each)), lambda b, s: F.transform(b, lambda x: x + s))))
    rows = rows.withColumn("ends", ends)

    def placed(x: Column, ends: Column) -> Column:
        fine = F.filter(F.arrays_zip(x["w"].alias("w"), x["p"].alias("p"), ends.alias("end")), lambda m: F.length(m["p"]) >= x["least"])
        return F.transform(fine, lambda m: F.struct((m["end"] - F.length(m["w"])).alias("start"), x["place"].alias("place"), m["end"].alias("end"), x["kind"].alias("kind")))

    return rows.withColumn("spans", F.array_sort(F.flatten(F.zip_with("m", "ends", placed))))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(doc_id, spans): spans are arrays of (start, place, end, kind) by start, then the order of the rules."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    shards = max(1, docs.count() // SHARD)
    found = candidates(rows, rules, shards).withColumnRenamed("key", "found")
    met = rows.join(found, F.col("key") == F.col("found"), "left").select("doc_id", "text", "kinds")
    return with_spans(met, rules).select("doc_id", "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _sql() -> str:
    """The same spans in SQL, positions by the lengths of pieces and matches."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT nr, {k} place, {quoted(r.kind)} kind, {r.least} least, regexp_extract_all(x, {quoted(r.pattern)}) m, regexp_extract_all(x, {quoted(r.pattern)}, {r.group}) g, string_split_regex(x, {quoted(r.pattern)}) s FROM d WHERE regexp_matches(x, {quoted(r.pattern)})"
        for k, r in enumerate(RULES)
    )
    shown = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place)"
    return f"""
WITH d AS (SELECT row_number() OVER () nr, doc_id, coalesce(text, '') x FROM documents),
f AS ({found}),
u AS (SELECT nr, place, kind, least, unnest(range(1, len(m) + 1)) i, unnest(m) m, unnest(g) g, unnest(s[1:len(m)]) s FROM f),
p AS (SELECT *, sum(length(s) + length(m)) OVER (PARTITION BY nr, place ORDER BY i) stop FROM u),
b AS (SELECT nr, place, kind, CAST(stop - length(m) AS BIGINT) start, CAST(stop AS BIGINT) stop FROM p WHERE length(g) >= least),
t AS (SELECT nr, {', '.join(f"count(*) FILTER (place = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))},
  coalesce({shown} FILTER (place < {len(BASE)}), '') base, {shown} spans FROM b GROUP BY nr)
SELECT doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (nr)
"""


SQL = _sql()


@query("op13_secrets", SQL)
def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def of_place(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["place"] == k)).cast("long")

    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    return found.select("doc_id", *(of_place(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
