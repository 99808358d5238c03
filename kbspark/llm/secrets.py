"""Secret scans over a trigram inverted index.

For every rule a Boolean trigram query is derived from its regular expression: the texts it
can match must hold all trigrams of one of several alternatives. Postings of these trigrams
are intersected, and only the candidates are checked with the expression itself. A rule
without mandatory trigrams is checked on every text.

Defined results: a null text is empty and has no findings; documents that share a doc_id, and
those without one, are candidates together, and each is checked on its own text; rows without
findings are returned with zero counts; no rows give no rows.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import let, staged
from kbspark.session import NARROW_ROWS, at_most, small_side


def _either(word: str) -> str:
    """The letters of a word in either case, as character classes."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; ``group`` must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The key words and token shapes that are looked for.
KEYWORDS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
RULES = (
    Rule("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
# Most strings that a stretch of an expression may stand for before it is given up.
MOST = 64


def _strings(nodes) -> list[set[str] | None]:
    """The expression as a sequence of small sets of lower-case strings; None where anything may stand."""
    out: list[set[str] | None] = []
    for op, arg in nodes:
        if op is sre.LITERAL:
            out.append({chr(arg).lower()})
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            out.append({chr(a).lower() for _, a in arg})
        elif op is sre.SUBPATTERN:
            out += _strings(arg[3])
        elif op is sre.BRANCH:
            ways = [_exact(_strings(way)) for way in arg[1]]
            out.append(set().union(*ways) if all(w is not None for w in ways) else None)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            one = _exact(_strings(body))
            if one is not None and (low, high) == (0, 1):
                out.append(one | {""})
            elif one is not None and low == high and len(one) == 1:
                out.append({next(iter(one)) * low})
            else:
                out += [one, None] if low and one is not None else [None]
        else:
            out.append(None)
    return out


def _exact(parts: list[set[str] | None]) -> set[str] | None:
    found = {""}
    for part in parts:
        if part is None or len(found) * len(part) > MOST:
            return None
        found = {a + b for a in found for b in part}
    return found


def trigram_query(pattern: str) -> list[list[str]]:
    """Alternatives of lower-case trigrams, of which a match must hold all of at least one.

    An empty list means that no trigram is mandatory. Letters are folded, as in the index.
    """
    alternatives: list[set[str]] = [set()]
    run = {""}

    def close(strings: set[str]) -> None:
        nonlocal alternatives
        folded = {s for s in strings if not any(s != t and s.startswith(t) for t in strings)}
        if folded and all(len(s) >= 3 for s in folded) and len(folded) * len(alternatives) <= MOST:
            grams = [{s[i : i + 3] for i in range(len(s) - 2)} for s in folded]
            alternatives = [a | g for a in alternatives for g in grams]

    for part in [*_strings(sre_parser.parse(pattern)), None]:
        if part is not None and len(run) * len(part) <= MOST:
            run = {a + b for a in run for b in part}
            continue
        close(run)
        run = part if part is not None else {""}
    return [sorted(a) for a in sorted(alternatives, key=sorted)] if all(alternatives) else []


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Inverted index (trigram, doc_id) of the given trigrams over lower-cased whole texts."""
    low = F.lower(F.coalesce("text", F.lit("")))
    given = F.array(*[F.lit(t) for t in trigrams])
    held = let(low, lambda text: F.filter(given, lambda t: F.contains(text, t)))
    return docs.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, list[list[str]]]) -> DataFrame:
    """(doc_id, rules): a bit for every rule one of whose alternatives is wholly posted.

    Each trigram of the index is looked up in the table of alternatives, which has a few rows a
    rule; the intersection is a count per document and alternative.
    """
    rows = [
        (1 << rule, a, gram, len(grams))
        for rule, ways in queries.items() for a, grams in enumerate(ways) for gram in grams
    ]
    table = index.sparkSession.createDataFrame(rows, "rule long, way int, trigram string, need long")
    whole = index.join(F.broadcast(table), "trigram").groupBy("doc_id", "rule", "way", "need").agg(
        F.count_distinct("trigram").alias("held")).filter(F.col("held") == F.col("need"))
    return whole.groupBy("doc_id").agg(F.bit_or("rule").alias("rules"))


def find(text: Column, number: int, rule: Rule) -> Column:
    """Spans (start, number, end) in code points of a rule's matches that pass.

    The text is split at the matches: the lengths of what lies between and of the matches
    add up to the places.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), 0)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), rule.group), lambda g: F.length(g))
    gaps = F.transform(F.split(text, rule.pattern), lambda g: F.length(g))
    lengths = F.transform(matches, lambda m: F.length(m))
    kind = "array<struct<start: int, number: int, end: int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))
    rows = F.arrays_zip(gaps.alias("gap"), lengths.alias("length"), sizes.alias("size"))

    def step(state: Column, row: Column) -> Column:
        begin = state["at"] + row["gap"]
        end = begin + F.coalesce(row["length"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(number).alias("number"), end.alias("end"))
        passes = row["length"].isNotNull() & (row["size"] >= rule.least)
        return F.struct(end.alias("at"), F.when(passes, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    found = F.aggregate(rows, start, step)["spans"]
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(F.array().cast(kind))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``spans`` (start, number of the rule, end), sorted, of every row.

    The index is staged. Candidates are a narrow table: it is sent to the texts while it is
    small, and joined by doc_id beyond that.
    """
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    indexed = {i: q for i, q in queries.items() if q}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if indexed:
        index = staged(postings(rows, sorted({t for q in indexed.values() for way in q for t in way})), "postings")
        found = staged(candidates(index, indexed), "candidates").select(F.col("doc_id").alias("_id"), "rules")
        rows = rows.join(small_side(found, at_most(found, NARROW_ROWS)), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    else:
        rows = rows.withColumn("rules", F.lit(0).cast("long"))
    none = F.array().cast("array<struct<start: int, number: int, end: int>>")
    held = [
        F.when(F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0, find(F.col("text"), i, r)).otherwise(none)
        if i in indexed else find(F.col("text"), i, r)
        for i, r in enumerate(rules)
    ]
    return rows.select("doc_id", F.array_sort(F.concat(*held)).alias("spans"))


def _numbered(number: int):
    return lambda span: span["number"] == number


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = F.array(*[F.lit(r.base) for r in rules])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["number"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    own = F.filter("spans", lambda s: F.get(base, s["number"]))
    counts = [
        F.size(F.filter("spans", _numbered(i))).cast("long").alias(f"n_{r.kind}")
        for i, r in enumerate(rules) if r.base
    ]
    return scan(docs, rules).select("doc_id", *counts, F.sha2(shown(own), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
