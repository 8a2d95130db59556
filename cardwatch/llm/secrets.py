"""Secret scan over a trigram index, with DataFrame functions only."""

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cardwatch.llm.lines import row_key


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost and non-overlapping, whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The first three rules and their order are fixed values. A run of hexadecimal digits is maximal in any leftmost
# search, so asking for 32 in the pattern gives the matches that dropping shorter ones afterwards would give; the
# same holds for what follows AKIA, where a later start in the same run is always shorter.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Published formats of credentials that the base rules do not name.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + MORE


def required_strings(pattern: str) -> set[str] | None:
    """Lower-case strings of which every match holds at least one; None if there is no such set of useful strings.

    The parsed pattern is read from left to right. Literals, small classes, alternatives, groups and optional parts
    extend a set of possible strings; anything else ends it. The set whose shortest string is longest is taken.
    """
    return _best(_runs(re._parser.parse(pattern)))


def _best(runs):
    useful = [r for r in runs if r and min(map(len, r)) >= 3]
    return max(useful, key=lambda r: (min(map(len, r)), -len(r))) if useful else None


def _choices(op, arg):
    """All strings that one parsed item stands for, lowered, or None if they are too many to list."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        if all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            return {chr(a).lower() for _, a in arg}
        return None
    if name == "SUBPATTERN":
        return _sequence(arg[3])
    if name == "BRANCH":
        options = [_sequence(x) for x in arg[1]]
        return None if None in options else set().union(*options)
    if name == "MAX_REPEAT" and arg[1] == 1:
        once = _sequence(arg[2])
        return once if once is None or arg[0] == 1 else once | {""}
    return None


def _sequence(items):
    out = {""}
    for op, arg in items:
        found = _choices(op, arg)
        if found is None or len(out) * len(found) > 64:
            return None
        out = {a + b for a in out for b in found}
    return out


def _runs(items):
    runs, now = [], {""}
    for op, arg in items:
        found = _choices(op, arg)
        if found is None or len(now) * len(found) > 64:
            runs.append(now)
            now = {""} if found is None else found
        else:
            longer = {a + b for a in now for b in found}
            # An item that may be absent does not lengthen what is certain; what came before stays a candidate.
            if "" in found:
                runs.append(now)
            now = longer
    return [*runs, now]


def trigram_query(rule: Rule) -> list[frozenset[str]] | None:
    """The rule's Boolean query: any of these sets with all of its trigrams present, or None for a full scan."""
    strings = required_strings(rule.pattern)
    return strings and sorted(
        {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted
    )


def scan_secrets(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find secrets: one row per input row with its id, its text's key, and ``found``, an array of
    (start, rank, kind, end) in code points, end exclusive, ordered by start and then by the rules' order.

    Each rule's pattern is turned into a Boolean query over trigrams. An inverted index of the trigrams that occur in
    the queries is built over all documents; its lists are intersected by counting the trigrams of each alternative
    per document, and only the candidates are searched with the rule's expression. Rules without trigrams of their
    own search every document.

    A null text is empty and has no secrets; rows with null or repeated ids are searched like others; an empty table
    gives an empty table. Other columns are not read.
    """
    whole = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    body = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(F.col(f"`{id_col}`"), whole).alias("key"), whole.alias("body"))
    indexed = {r.kind: q for r in rules if (q := trigram_query(r))}
    terms = sorted({t for q in indexed.values() for s in q for t in s})
    named = body
    if terms:
        low = body.select("key", F.lower("body").alias("low"))
        present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), t) for t in terms]))
        postings = low.select("key", F.explode(present).alias("trigram"))
        wanted = [(t, k, i, len(s)) for k, q in indexed.items() for i, s in enumerate(q) for t in sorted(s)]
        query = docs.sparkSession.createDataFrame(wanted, "trigram string, kind string, alternative int, needed int")
        hits = (
            postings.join(F.broadcast(query), "trigram")
            .groupBy("key", "kind", "alternative", "needed")
            .agg(F.count_distinct("trigram").alias("n"))
            .where("n = needed")
            .groupBy("key")
            .agg(F.collect_set("kind").alias("kinds"))
        )
        named = body.join(hits, "key", "left")
    else:
        named = body.withColumn("kinds", F.array().cast("array<string>"))
    searches = []
    for rank, rule in enumerate(rules):
        pattern = F.lit(rule.pattern)
        gaps = F.transform(F.split("body", rule.pattern, -1), lambda s: F.length(s))
        whole_match = F.transform(F.regexp_extract_all("body", pattern, F.lit(0)), lambda s: F.length(s))
        group = F.transform(F.regexp_extract_all("body", pattern, F.lit(rule.group)), lambda s: F.length(s))
        possible = F.array_contains("kinds", rule.kind) if rule.kind in indexed else F.lit(True)
        parts = F.arrays_zip(gaps.alias("gap"), whole_match.alias("len"), group.alias("part"))
        searches.append(
            F.when(
                possible & F.col("body").rlike(rule.pattern),
                F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), parts.alias("parts")),
            )
        )
    matches = (
        named.select("key", F.explode(F.array_compact(F.array(*searches))).alias("s"))
        .select("key", "s.rank", "s.kind", "s.least", F.posexplode("s.parts").alias("pos", "m"))
        .where("m.len IS NOT NULL")
        .select("key", "rank", "kind", "least", "pos", "m.gap", "m.len", "m.part")
        .distinct()  # of rows that are there twice
    )
    w = W.partitionBy("key", "rank").orderBy("pos")
    spans = (
        matches.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(w))
        .where("part >= least")
        .select("key", F.struct((F.col("end") - F.col("len")).alias("start"), "rank", "kind", "end").alias("span"))
    )
    found = spans.groupBy("key").agg(F.array_sort(F.collect_list("span")).alias("found"))
    return body.select("id", "key").join(found, "key", "left")


def as_text(found, keep=lambda span: F.lit(True)):
    """kind:start:end of the spans, comma-joined."""
    each = F.transform(
        F.filter(found, keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.coalesce(F.array_join(each, ","), F.lit(""))
