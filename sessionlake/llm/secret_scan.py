"""Secret scans by a trigram inverted index. DataFrame functions only.

Each rule is a regex. ``trigram_query`` derives from it a Boolean query that every text with a match satisfies: the parse tree's literal
parts become sets of strings, a string needs all its trigrams, a set any of its strings, a sequence all its parts. A rule whose query holds
for any text (it has no mandatory trigram) scans fully.

The index has one posting (trigram, document) for each trigram that some query names and that the lower-cased text holds, written to the shared folder
sorted by trigram in each part. A rule's candidates come from intersecting postings: they are merged per document into bit sets, on which the
queries are Boolean expressions. Candidates are verified by the regex itself, on the original text.

Places come from splitting a text at a regex's matches: the lengths of pieces and matches add up to the starts, in code points.

Scale. The index is over the rules' trigrams only, so it has a bounded number of narrow rows per document. Merging postings is a
grouped sum with partial sums; the join back to the texts is by document id and text hash, a sort-merge join that Spark can split.

Defined results. Null counts as empty: no spans. Texts of any length are scanned whole, in time that grows with their length. Spans that start together
come in the order of the rules. Repeated rows and null ids stay, an empty table gives no rows, other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import stored


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: The group whose length counts (0: the match), and its least length.
    group: int = 0
    least: int = 0


#: Fixed by the contract, in its order.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: The method's own rules, public formats of tokens and keys.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 36),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]+", 0, 27),
    Rule("url_password", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._-]+@"),
)

#: A query: True, or ("tri", t), ("and", queries), ("or", queries).
Query = bool | tuple

_MOST_STRINGS = 64


def trigram_query(regex: str) -> Query:
    """The Boolean trigram query (over lower-cased text) that every match of ``regex`` satisfies."""
    exact, query = _walk(sre_parser.parse(regex))
    return _and([query, _any_of(exact)])


def _and(queries: list[Query]) -> Query:
    parts = [q for q in queries if q is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _or(queries: list[Query]) -> Query:
    return True if any(q is True for q in queries) or not queries else queries[0] if len(queries) == 1 else ("or", queries)


def _any_of(strings: set[str] | None) -> Query:
    if not strings:
        return True
    return _or([_and([("tri", t) for t in sorted({s[i : i + 3] for i in range(len(s) - 2)})]) for s in sorted(strings)])


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """(the strings that the sequence can be, or None if too many; a query for the rest of what it needs)."""
    run: set[str] | None = {""}
    needs: list[Query] = []
    whole = True  # run is still all of the sequence
    for kind, value in nodes:
        part, query = _node(kind, value)
        needs.append(query)
        if part is not None and run is not None and len(run) * len(part) <= _MOST_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        needs.append(_any_of(run))
        whole = False
        run = part if part is not None else {""}
    if whole:
        return run, _and(needs)
    return None, _and([*needs, _any_of(run)])


def _node(kind, value) -> tuple[set[str] | None, Query]:
    if kind is sre.LITERAL:
        return {chr(value).lower()}, True
    if kind is sre.IN:
        chars: set[str] = set()
        for k, v in value:
            if k is sre.LITERAL:
                chars.add(chr(v).lower())
            elif k is sre.RANGE and v[1] - v[0] < 16:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 16 else (None, True)
    if kind is sre.SUBPATTERN:
        return _walk(value[3])
    if kind is sre.BRANCH:
        parts = [_walk(v) for v in value[1]]
        if all(exact is not None for exact, _ in parts):
            return set().union(*(exact for exact, _ in parts)), _or([q for _, q in parts])
        return None, _or([_and([q, _any_of(exact)]) for exact, q in parts])
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, body = value
        exact, query = _walk(body)
        if exact is not None and most == 1:
            return ({""} | exact, True) if least == 0 else (exact, query)
        return None, _and([query, _any_of(exact)]) if least > 0 else True
    if kind is sre.AT:
        return {""}, True
    return None, True


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams_of, query[1]))


_WORD = 62  # trigrams in one long


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings trigram, doc_id, text_hash of the given trigrams."""
    text = F.array(F.lower(F.coalesce("text", F.lit(""))))
    names = F.array(*[F.lit(t) for t in trigrams])
    held = F.flatten(F.transform(text, lambda t: F.filter(names, lambda g: F.contains(t, g))))  # the text is lower-cased once
    postings = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(held).alias("trigram"))
    return stored(postings.select("trigram", "doc_id", "text_hash").sortWithinPartitions("trigram"), "trigram-index")


def candidates(index: DataFrame, queries: dict[str, Query], trigrams: list[str]) -> DataFrame:
    """doc_id, text_hash and kinds (of the rules whose queries the document's postings satisfy)."""
    place = F.array_position(F.array(*[F.lit(t) for t in trigrams]), F.col("trigram")) - 1
    words = range(-(-len(trigrams) // _WORD))
    bits = [
        F.bit_or(F.when(F.floor(place / _WORD) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (place % _WORD).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"w{w}")
        for w in words
    ]
    merged = index.groupBy("doc_id", "text_hash").agg(*bits)
    at = {t: i for i, t in enumerate(trigrams)}

    def holds(q: Query) -> Column:
        if q[0] == "tri":
            i = at[q[1]]
            return F.col(f"w{i // _WORD}").bitwiseAND(F.lit(1 << (i % _WORD))) != 0
        out = holds(q[1][0])
        for part in q[1][1:]:
            out = out & holds(part) if q[0] == "and" else out | holds(part)
        return out

    kinds = F.filter(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]), lambda k: k.isNotNull())
    return merged.select("doc_id", "text_hash", kinds.alias("kinds")).where(F.size("kinds") > 0)


_RUN = 256


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, end, kind>> of a rule's leftmost matches that are long enough."""
    matches = F.regexp_extract_all(text, F.lit(rule.regex if rule.group else f"({rule.regex})"), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else matches
    parts = F.arrays_zip(F.split(text, rule.regex, -1).alias("p"), matches.alias("m"), values.alias("v"))
    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        enough = F.length(x["v"]) >= rule.least
        return F.struct(F.coalesce(end, start).alias("at"), F.when(enough, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

    # Growing a list copies it, so lists grow within runs of _RUN parts only; then each run's spans are moved by the length of the runs before it.
    runs = F.transform(F.sequence(F.lit(1), F.size(parts), F.lit(_RUN)), lambda at: F.aggregate(F.slice(parts, at, _RUN), F.struct(F.lit(0).alias("at"), empty.alias("found")), add))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(runs, zero, lambda s, r: F.struct((s["at"] + r["at"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])

    def moved(run: Column, by: Column) -> Column:
        return F.transform(run["found"], lambda x: F.struct((x["start"] + by).alias("start"), x["order"].alias("order"), (x["end"] + by).alias("end"), x["kind"].alias("kind")))

    return F.flatten(F.zip_with(runs, starts, moved))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and spans array<struct<start, order, end, kind>> (sorted; code points, end exclusive) of every row."""
    docs = docs.select("doc_id", "text")
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    trigrams = sorted(set().union(*map(trigrams_of, indexed.values())))
    found = candidates(build_index(docs, trigrams), indexed, trigrams)
    found = found.select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"), "kinds")
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    joined = keyed.join(found.hint("merge"), keyed.doc_id.eqNullSafe(found.c_id) & (keyed.text_hash == found.c_hash), "left")
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    spans = []
    for order, rule in enumerate(rules):
        if queries[rule.kind] is True:  # a cheap test of the same regex spares most texts the splitting
            gate = text.rlike(re_at_least(rule))
        else:
            gate = F.array_contains("kinds", rule.kind)
        spans.append(F.when(gate, _spans(text, rule, order)).otherwise(none))
    return joined.select("doc_id", F.sort_array(F.concat(*spans)).alias("spans"))


def re_at_least(rule: Rule) -> str:
    """For a rule that is one repeated class: the class repeated often enough; else the rule's regex."""
    one_class = rule.regex[0] == "[" and rule.regex.endswith("]+") and rule.regex.count("[") == 1 and not rule.group
    return f"{rule.regex[:-1]}{{{rule.least}}}" if one_class and rule.least else rule.regex


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text_of(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return found.select(
        "doc_id", *[count(r.kind) for r in BASE], F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans")
    )


def oracle() -> str:
    """The contract in DuckDB: every rule over every text."""
    parts = []
    for order, r in enumerate(BASE + MORE):
        regex = r.regex.replace("(?i:password|passwd|secret|token|api_?key)", "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")").replace("'", "''")
        parts.append(
            f"SELECT doc_id, '{r.kind}' AS kind, {order} AS ord, regexp_split_to_array(text, '{regex}') AS p, "
            f"regexp_extract_all(text, '{regex}') AS m, regexp_extract_all(text, '{regex}', {r.group}) AS v, {r.least} AS least FROM documents"
        )
    return f"""
WITH k AS ({" UNION ALL ".join(parts)}),
i AS (SELECT doc_id, kind, ord, least, p, m, v, unnest(range(1, len(m) + 1)) AS n FROM k WHERE len(m) > 0),
s AS (
  SELECT doc_id, kind, ord,
    (coalesce(list_sum(list_transform(p[1:n], lambda x: length(x))), 0)
     + coalesce(list_sum(list_transform(m[1:n - 1], lambda x: length(x))), 0))::BIGINT AS a,
    length(m[n]) AS size
  FROM i WHERE length(v[n]) >= least),
g AS (
  SELECT doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, ord) FILTER (ord < {len(BASE)}) AS base,
    string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, ord) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g USING (doc_id)
"""
