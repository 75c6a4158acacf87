"""Secret scans (operator 10): a trigram inverted index in front of regular expressions, DataFrame functions only.

Each rule's regular expression is parsed into a Boolean query over lower-case trigrams (an OR of ANDs) that every
match implies. The index holds, for the trigrams any rule asks for, the rows they occur in; the postings
of a clause's trigrams are intersected by row, and rows where some clause is complete are the rule's candidates.
A rule whose expression has no mandatory trigram scans every row. Candidates are verified on the whole text.
"""

from __future__ import annotations

import re._constants as k
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, columns_or_null, folded, literal_rows


@dataclass(frozen=True)
class Rule:
    """least: characters of the given group that a match needs; shorter matches are dropped and not tried again."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: Kinds, patterns and lengths, the first three as the contract has them.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: Strings that a run of literals may stand for before it is cut, and characters of a class that are spelled out.
MOST_STRINGS, MOST_CHARS = 64, 4

#: An OR of ANDs; {frozenset()} holds for every text.
Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset([frozenset()])


def _both(a: Query, b: Query) -> Query:
    return _least({x | y for x in a for y in b})


def _least(clauses: set[frozenset[str]]) -> Query:
    """Without clauses that hold another one."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _of_strings(strings: set[str]) -> Query:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _spelled(op: object, arg: object) -> set[str] | None:
    """The lower-case strings a node stands for, None if too many or unbounded."""
    if op is k.LITERAL:
        return {chr(arg).lower()}
    if op is k.IN:
        chars: set[str] = set()
        for o, a in arg:
            if o is k.LITERAL:
                chars.add(chr(a).lower())
            elif o is k.RANGE and a[1] - a[0] < MOST_CHARS:
                chars |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return chars if len(chars) <= MOST_CHARS else None
    if op is k.SUBPATTERN:
        return _spelled_all(arg[-1])
    if op is k.BRANCH:
        each = [_spelled_all(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if op is k.MAX_REPEAT and arg[1] == 1:
        inner = _spelled_all(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    if op is k.MAX_REPEAT and arg[0] == arg[1] and arg[0] <= 8:
        inner = _spelled_all(arg[2])
        return {"".join(x) for x in product(inner, repeat=arg[0])} if inner is not None and len(inner) ** arg[0] <= MOST_STRINGS else None
    return None


def _spelled_all(nodes: object) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        s = _spelled(op, arg)
        if s is None or len(out) * len(s) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in s}
    return out


def _query(nodes: object) -> Query:
    out, run = ALWAYS, {""}
    for op, arg in nodes:
        s = _spelled(op, arg)
        if s is not None and len(run) * len(s) <= MOST_STRINGS:
            run = {a + b for a in run for b in s}
            continue
        out, run = _both(out, _of_strings(run)), {""}
        if s is not None:
            run = s
        elif op is k.SUBPATTERN:
            out = _both(out, _query(arg[-1]))
        elif op is k.BRANCH:
            out = _both(out, _least(set().union(*[_query(x) for x in arg[1]])))
        elif op is k.MAX_REPEAT and arg[0] > 0:
            out = _both(out, _query(arg[2]))
    return _both(out, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """What the lower-case trigrams of any text with a match must fulfil; ALWAYS if nothing is mandatory."""
    return _query(parser.parse(pattern))


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram queries hold, by the inverted index."""
    spark = rows.sparkSession
    clauses = [(r.kind, c, g, len(cl)) for r in rules if (q := trigram_query(r.pattern)) != ALWAYS for c, cl in enumerate(sorted(map(sorted, q))) for g in cl]
    grams = sorted({g for _, _, g, _ in clauses})
    if not grams:
        return literal_rows(spark, [], "doc_id bigint, kinds array<string>")
    lower = rows.select("doc_id", F.lower("text").alias("text"))
    posting = lower.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.contains("text", F.lit(g)), F.lit(g)) for g in grams]))).alias("gram"))
    index = Table(posting, "trigrams").df
    asked = F.broadcast(literal_rows(spark, clauses, "kind string, clause int, gram string, needs bigint"))  # a few rows for each rule
    met = index.join(asked, "gram").groupBy("doc_id", "kind", "clause", "needs").agg(F.count_distinct("gram").alias("n")).where("n = needs")
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def spans_of(rule: Rule, rank: int, when: Column) -> tuple[Column, Column]:
    """The rule's matches in the text, and the spans (start, rank, kind, end) that they make: positions are the lengths of what the matches leave and of the matches."""
    pattern = F.lit(rule.pattern)
    hit = when & F.rlike("text", pattern)
    parts = F.when(hit, F.struct(F.split("text", rule.pattern, -1).alias("rest"), F.regexp_extract_all("text", pattern, 0).alias("whole"), F.regexp_extract_all("text", pattern, rule.group).alias("part")))
    got = F.col(f"m_{rule.kind}")

    def step(before: Column, i: Column) -> tuple[Column, Column]:
        at = before + F.length(F.get(got["rest"], i))
        end = at + F.length(F.get(got["whole"], i))
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return end, F.when(F.length(F.get(got["part"], i)) >= rule.least, F.array(span)).otherwise(none)

    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return parts, F.when(got.isNotNull(), folded(F.size(got["whole"]), none, step)).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text, found): a row for each row of docs, found: its spans by start, then by the rules' order.

    Offsets are code points, end exclusive. Null texts count as empty and have no spans; repeated rows each get
    theirs; rows that share a doc_id share candidates, and each is verified on its own text; a null doc_id is like any.
    """
    rows = columns_or_null(docs, doc_id="bigint", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    some = candidates(rows, rules).select(F.col("doc_id").alias("id"), "kinds")
    marked = rows.join(some, F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "text", "kinds")
    made, spans = [], []
    for rank, rule in enumerate(rules):
        scans_all = trigram_query(rule.pattern) == ALWAYS
        parts, found = spans_of(rule, rank, F.lit(True) if scans_all else F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)))
        made.append(parts.alias(f"m_{rule.kind}"))
        spans.append(found)
    return marked.select("doc_id", "text", *made).select("doc_id", "text", F.array_sort(F.concat(*spans)).alias("found"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda s: s["rank"] < F.lit(3))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    n = [count(r.kind) for r in RULES if r.base]
    return found.select("doc_id", *n, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
