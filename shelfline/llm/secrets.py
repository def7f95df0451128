"""Secret scans over a trigram index, in DataFrame operations only.

Each rule's pattern gives a Boolean query over trigrams that any match must hold (an AND of ORs; from Python's own
parse of the pattern, on the driver). The inverted index holds a posting (trigram, text key) for just those trigrams.
Postings are intersected by key, as bits; keys that satisfy a rule's query make a table of candidates, which is joined to
the texts, where the rule's pattern verifies them. A rule without mandatory trigrams scans every text. The key is a hash
of the text: equal texts share postings, and a collision could only add a candidate. Spark broadcasts the candidates if
their table is small enough for that, and no text is shuffled then; otherwise both sides are dealt by key and salt, so
that the copies of one text meet their candidate in several tasks.

Spans come from splitting a text at a pattern: the lengths of the pieces between matches and of the matches add up to
code-point positions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, settled

try:  # the parser of patterns moved in Python 3.11
    from re import _parser as _sre
except ImportError:
    import sre_parse as _sre

SALTS = 8
_MOST, _WIDE = 64, 8  # strings that a run, and a node, may stand for before it counts as unknown


@dataclass(frozen=True)
class Rule:
    """pattern: one for Java and for RE2; least: code points of group `group` from which a match counts."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are the contract's; the others find further well-known formats.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)


def _strings(node) -> set[str] | None:
    """The lower-cased strings that a parsed sequence stands for; None if there are too many."""
    out = {""}
    for op, arg in node:
        name = str(op)
        if name == "LITERAL":
            own = {chr(arg).lower()}
        elif name == "IN" and not any(str(o) in ("NEGATE", "CATEGORY") for o, _ in arg):
            own = set()
            for o, a in arg:
                own |= {chr(a).lower()} if str(o) == "LITERAL" else {chr(c).lower() for c in range(a[0], min(a[1], a[0] + _MOST) + 1)}
        elif name == "BRANCH":
            parts = [_strings(x) for x in arg[1]]
            own = None if any(p is None for p in parts) else set().union(*parts)
        elif name == "SUBPATTERN":
            own = _strings(arg[-1])
        elif name.endswith("REPEAT") and arg[1] <= 4:
            inner = _strings(arg[2])
            own = None if inner is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(inner, repeat=n)}
        else:
            own = None
        if own is None or len(own) > _WIDE or len(out) * len(own) > _MOST:
            return None
        out = {a + b for a in out for b in own}
    return out


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """AND over runs of an OR over the run's strings of an AND over a string's trigrams. Empty: nothing is mandatory.

    A run is a stretch of the pattern's top level with few enough strings. A run one of whose strings is shorter than
    three characters demands nothing.
    """
    nodes = [(op, arg) for op, arg in _sre.parse(pattern)]
    flat = []
    for op, arg in nodes:
        if str(op).endswith("REPEAT") and arg[0] > 0 and arg[1] > 4:
            flat += [(op, (1, 1, arg[2])), (None, None)]  # at least once; what follows it doesn't touch
        else:
            flat.append((op, arg))
    query, run = [], []
    for item in [*flat, (None, None)]:
        if item[0] is not None and _strings([*run, item]) is not None:
            run.append(item)
            continue
        found = _strings(run) if run else None
        if found and all(len(x) >= 3 for x in found):
            either = {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in found}
            query.append(sorted(sorted(x) for x in either if not any(y < x for y in either)))
        run = [item] if item[0] is not None and _strings([item]) is not None else []
    return query


def terms(rules=RULES) -> list[str]:
    """The trigrams that the rules' queries name."""
    return sorted({t for r in rules for either in trigram_query(r.pattern) for whole in either for t in whole})


def postings(df: DataFrame, text: Column, key: Column, rules=RULES) -> DataFrame:
    """term (a trigram's number in terms(rules)), key: which lower-cased texts hold which of the trigrams."""
    low = df.select(key.alias("key"), ascii_lower(text).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(terms(rules))]))
    return low.select(F.explode(held).alias("term"), "key")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """key, rules: for each key that satisfies a query, the bits of the rules whose query it satisfies."""
    names = {t: i for i, t in enumerate(terms(rules))}
    parts = range(len(names) // 62 + 1)
    own = index.groupBy("key").agg(*[F.coalesce(F.bit_or(F.when(F.floor(F.col("term") / 62) == p, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("term") % 62).cast("int")))), F.lit(0)).alias(f"m{p}") for p in parts])
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if query:
            holds = F.lit(True)
            for either in query:
                some = F.lit(False)
                for whole in either:
                    need = [sum(1 << names[t] % 62 for t in whole if names[t] // 62 == p) for p in parts]
                    all_ = F.lit(True)
                    for p in parts:
                        if need[p]:
                            all_ &= F.col(f"m{p}").bitwiseAND(F.lit(need[p])) == need[p]
                    some |= all_
                holds &= some
            bits += F.when(holds, 1 << k).otherwise(0)
    return own.select("key", bits.alias("rules")).where("rules <> 0")


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind, rank>> of the rule's matches that count, code points, end exclusive."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    zipped = F.arrays_zip(F.transform(matches, lambda x: F.length(x)).alias("m"), F.slice(gaps, F.lit(1), F.size(matches)).alias("g"))
    counts = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x) >= rule.least) if rule.group else F.transform(matches, lambda x: F.length(x) >= rule.least)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("done"))
    walked = F.aggregate(
        zipped,
        start,
        lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.concat(a["done"], F.array(F.struct((a["at"] + x["g"]).alias("start"), (a["at"] + x["g"] + x["m"]).alias("end")))).alias("done")),
        lambda a: a["done"],
    )
    rank = [r.kind for r in RULES].index(rule.kind) if rule in RULES else len(RULES)
    kept = F.filter(F.arrays_zip(walked.alias("s"), counts.alias("ok")), lambda x: x["ok"])
    return F.transform(kept, lambda x: F.struct(x["s"]["start"].alias("start"), F.lit(rank).alias("rank"), x["s"]["end"].alias("end"), F.lit(rule.kind).alias("kind")))


def scan(df: DataFrame, text: str = "text", rules=RULES, out: str = "spans") -> DataFrame:
    """Adds `out`: array of (start, rank, end, kind) of all secrets, by start and then by the rules' order.

    Null and empty texts give an empty array. Rows that repeat are scanned each. A column already named `out` is
    replaced; all others stay.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key, salt, bits = (fresh(df, c) for c in ("_key", "_salt", "_rules"))
    found = settled(candidates(postings(df, whole, F.xxhash64(whole), rules), rules), "candidates")
    found = found.select(F.col("key").alias(key), F.explode(F.array(*map(F.lit, range(SALTS)))).alias(salt), F.col("rules").alias(bits))
    # Any salt will do, as each of them finds the candidate.
    keyed = df.withColumn(key, F.xxhash64(whole)).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = keyed.join(found, [key, salt], "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    spans = []
    for k, rule in enumerate(rules):
        may = F.coalesce(F.col(bits).bitwiseAND(F.lit(1 << k)), F.lit(0)) != 0 if trigram_query(rule.pattern) else F.lit(True)
        spans.append(F.when(may & whole.rlike(rule.pattern), _spans(whole, rule)).otherwise(none))
    return joined.withColumn(out, F.array_sort(F.concat(*spans))).drop(key, salt, bits)


def redact(df: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> DataFrame:
    """Replaces every span of `spans` in the text by the mark; overlapping spans become one mark. Null texts stay null."""
    t, s = F.col(f"`{text}`"), F.col(f"`{spans}`")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    new = F.aggregate(
        s,
        start,
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(x["start"] < a["at"], a["done"]).otherwise(F.concat(a["done"], F.substring(t, a["at"] + 1, x["start"] - a["at"]), F.lit(mark))).alias("done"),
        ),
        lambda a: F.concat(a["done"], F.substring(t, a["at"] + 1, F.length(t))),
    )
    return df.withColumn(text, F.when(F.size(s) > 0, new).otherwise(t))


BASE = ("assign", "access", "hex")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document; null and empty texts have none. Rows that share a doc_id are scanned one by one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).select("doc_id", "spans")
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_sql() -> str:
    """The same in DuckDB: RE2 splits, and positions are running sums of lengths."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for rank, r in enumerate(RULES):
        parts.append(
            f"""SELECT doc_id, {rank} AS rank, {q(r.kind)} AS kind, length(g) AS counted, length(m) AS m,
       sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, text ORDER BY i) AS stop
FROM (SELECT doc_id, text, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[1:len(ms)]) AS gap
      FROM (SELECT doc_id, text, regexp_extract_all(text, {q(r.pattern)}) AS ms, regexp_extract_all(text, {q(r.pattern)}, {r.group}) AS gs, string_split_regex(text, {q(r.pattern)}) AS gaps
            FROM docs WHERE regexp_matches(text, {q(r.pattern)})))
QUALIFY length(g) >= {r.least}"""
        )
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)}),
spelled AS (SELECT doc_id, rank, kind, stop - m AS start, kind || ':' || CAST(stop - m AS BIGINT) || ':' || CAST(stop AS BIGINT) AS s FROM found),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(s, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base, string_agg(s, ',' ORDER BY start, rank) AS spans FROM spelled GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)"""
