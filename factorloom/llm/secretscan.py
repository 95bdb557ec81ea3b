"""Secrets in texts through a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived: every text that matches the
rule holds all trigrams of at least one of its alternatives.  The inverted index holds a posting
(trigram, place) for each trigram that some query names; intersecting the postings gives the candidates,
which are read again and verified with the expression itself.  A rule without mandatory trigrams scans
every text.  Trigrams are taken from lower-cased text, so that rules that ignore case can use them too.

Positions are code points, the end exclusive.  Matches are leftmost and do not overlap within a rule;
those whose value is too short are dropped after matching.  Null and empty texts have no spans; repeated
rows and null ids are scanned like any other, told apart by their place.  Columns of any name may stand
beside id and text.  A rule must not repeat a group of changing length: the engine's matcher recurses once
a repetition there, and a long text would exhaust its stack, so such a rule is refused when it is made.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.located import PLACE, given_back, held, with_place
from factorloom.plans.staging import stage

#: A query is a set of alternatives; each is a set of trigrams that must all be there.
Query = frozenset
ANY: Query = frozenset([frozenset()])
MOST_STRINGS, MOST_ALTERNATIVES = 64, 32
#: Repetitions of a group up to so many are no danger to the matcher's stack.
LONGEST_REPEAT = 100


@dataclass(frozen=True)
class Rule:
    """A kind of secret: expression, group that holds the value, least length of the value."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    def __post_init__(self):
        if _repeats_a_group(rp.parse(self.pattern)):
            raise ValueError(f"rule {self.kind} repeats a group; use a character class")


def _repeats_a_group(parsed) -> bool:
    """Whether an unbounded repetition stands over more than one character or class."""
    for op, value in parsed:
        if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            _, most, part = value
            single = len(part) == 1 and part[0][0] in (rc.LITERAL, rc.NOT_LITERAL, rc.IN, rc.ANY)
            if (most > LONGEST_REPEAT and not single) or _repeats_a_group(part):
                return True
        elif op is rc.SUBPATTERN and _repeats_a_group(value[3]):
            return True
        elif op is rc.BRANCH and any(_repeats_a_group(p) for p in value[1]):
            return True
    return False


# The three base kinds.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),  # a run of capitals and digits is one match, so its length can stand in the expression
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES


@dataclass(frozen=True)
class Shape:
    """What is known of the strings a part can match: all of them, or their beginnings, ends and a query."""

    exact: frozenset | None
    heads: frozenset
    tails: frozenset
    query: Query


def _least(query) -> Query:
    """Drops alternatives that ask for more than another one."""
    kept = frozenset(a for a in query if not any(b < a for b in query))
    return kept if len(kept) <= MOST_ALTERNATIVES else ANY


def _both(a: Query, b: Query) -> Query:
    if a == ANY or b == ANY:
        return b if a == ANY else a
    return _least({x | y for x in a for y in b})


def _either(a: Query, b: Query) -> Query:
    return _least(a | b)


def _holding(strings: frozenset) -> Query:
    """Query for texts that hold one of the strings."""
    return _least({frozenset(s[i: i + 3] for i in range(len(s) - 2)) for s in strings})


def _known(strings) -> Shape:
    strings = frozenset(strings)
    return Shape(strings, strings, strings, ANY)


UNKNOWN = Shape(None, frozenset([""]), frozenset([""]), ANY)


def _loose(shape: Shape) -> Shape:
    """The same part without its full list of strings."""
    if shape.exact is None:
        return shape
    heads = frozenset(s[:3] for s in shape.exact)
    tails = frozenset(s[-3:] for s in shape.exact)
    if len(heads) > MOST_STRINGS:
        heads = frozenset([""])
    if len(tails) > MOST_STRINGS:
        tails = frozenset([""])
    return Shape(None, heads, tails, _holding(shape.exact))


def _then(a: Shape, b: Shape) -> Shape:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _known(x + y for x in a.exact for y in b.exact)
    joins = frozenset(x[-2:] + y[:2] for x in a.tails for y in b.heads)
    across = _holding(joins) if len(joins) <= MOST_STRINGS else ANY
    heads = frozenset(x + y for x in a.exact for y in b.heads) if a.exact is not None else a.heads
    tails = frozenset(x + y for x in a.tails for y in b.exact) if b.exact is not None else b.tails
    first, second = _loose(a), _loose(b)
    heads = frozenset(h[:3] for h in heads)
    tails = frozenset(t[-3:] for t in tails)
    if len(heads) > MOST_STRINGS:
        heads = first.heads
    if len(tails) > MOST_STRINGS:
        tails = second.tails
    return Shape(None, heads, tails, _both(_both(first.query, second.query), across))


def _or(a: Shape, b: Shape) -> Shape:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_STRINGS:
        return _known(a.exact | b.exact)
    a, b = _loose(a), _loose(b)
    return Shape(None, a.heads | b.heads, a.tails | b.tails, _either(a.query, b.query))


def _shape(parsed) -> Shape:
    whole = _known([""])
    for op, value in parsed:
        whole = _then(whole, _shape_of(op, value))
    return whole


def _shape_of(op, value) -> Shape:
    if op is rc.LITERAL:
        return _known([chr(value).lower()]) if value < 128 else UNKNOWN
    if op is rc.IN:
        letters = set()
        for kind, item in value:
            if kind is rc.LITERAL and item < 128:
                letters.add(chr(item).lower())
            elif kind is rc.RANGE and item[1] < 128 and item[1] - item[0] < MOST_STRINGS:
                letters.update(chr(c).lower() for c in range(item[0], item[1] + 1))
            else:
                return UNKNOWN
        return _known(letters) if len(letters) <= 8 else UNKNOWN
    if op is rc.SUBPATTERN:
        return _shape(value[3])
    if op is rc.BRANCH:
        first, *rest = [_shape(p) for p in value[1]]
        for other in rest:
            first = _or(first, other)
        return first
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
        least, most, part = value
        inner = _shape(part)
        if least == 0:
            return _or(_known([""]), inner) if most == 1 and inner.exact is not None else UNKNOWN
        once = _loose(inner)
        return inner if least == most == 1 else Shape(None, once.heads, once.tails, once.query)
    if op is rc.AT:
        return _known([""])
    return UNKNOWN


def trigram_query(pattern: str) -> Query:
    """Boolean trigram query that every matching text satisfies, over lower-cased trigrams."""
    query = _loose(_shape(rp.parse(pattern))).query
    return ANY if frozenset() in query else query


def trigram_index(placed: DataFrame, text_col: str, trigrams: list[str]) -> DataFrame:
    """Postings (trigram number, place) of the given trigrams, ordered by trigram within the files."""
    low = placed.select(*PLACE, F.lower(held(text_col)).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    postings = low.select(*PLACE, F.explode(found).alias("trigram"))
    return stage(postings.sortWithinPartitions("trigram"), "trigram-postings")


def candidates(postings: DataFrame, trigrams: list[str], queries: dict[str, Query]) -> DataFrame:
    """Rows (place, rules): the postings of each text intersected against every rule's query."""
    bit = {t: i for i, t in enumerate(trigrams)}
    words = -(-len(trigrams) // 60)
    held = postings.groupBy(*PLACE).agg(*[
        F.bit_or(F.when(F.floor(F.col("trigram") / 60) == w, F.expr(f"shiftleft(1L, trigram % 60)")).otherwise(F.lit(0).cast("long"))).alias(f"held{w}")
        for w in range(words)
    ])

    def met(query: Query) -> Column:
        any_of = F.lit(False)
        for alternative in sorted(query, key=sorted):
            all_of = F.lit(True)
            for w in range(words):
                mask = sum(1 << bit[t] % 60 for t in alternative if bit[t] // 60 == w)
                if mask:
                    all_of = all_of & (F.col(f"held{w}").bitwiseAND(F.lit(mask).cast("long")) == mask)
            any_of = any_of | all_of
        return any_of

    rules = F.array_compact(F.array(*[F.when(met(q), F.lit(kind)) for kind, q in queries.items()]))
    return held.select(*PLACE, rules.alias("rules")).filter(F.size("rules") > 0)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule in a text: array of (start, place of the rule, end, kind)."""
    cut, matches = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.least else matches
    span = "struct<start:long,rule:int,end:long,kind:string>"
    parts = F.arrays_zip(F.slice(cut, 1, F.size(matches)).alias("gap"), matches.alias("match"), values.alias("value"))

    def add(done: Column, part: Column) -> Column:
        start = done["at"] + F.length(part["gap"])
        end = start + F.length(part["match"])
        found = F.struct(start.alias("start"), F.lit(order).alias("rule"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        more = F.when(F.length(part["value"]) >= rule.least, F.concat(done["spans"], F.array(found))).otherwise(done["spans"])
        return F.struct(end.alias("at"), more.alias("spans"))

    none = F.array().cast(f"array<{span}>")
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    return F.when(text.rlike(rule.pattern), F.aggregate(parts, zero, add, lambda done: done["spans"])).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, place, found): the spans of every text ordered by start and rule."""
    return _scan(with_place(docs), rules, id_col, text_col)


def _scan(placed: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = [r for r in rules if queries[r.kind] != ANY]
    order = {r.kind: i for i, r in enumerate(rules)}
    content = F.coalesce(held(text_col), F.lit(""))
    rows = placed.select(held(id_col).alias("id"), content.alias("content"), *PLACE)

    def spans(which) -> Column:
        each = [spans_of(F.col("content"), r, order[r.kind]) for r in which]
        return F.concat(*each) if each else F.array().cast("array<struct<start:long,rule:int,end:long,kind:string>>")

    full = rows.select("id", *PLACE, spans([r for r in rules if queries[r.kind] == ANY]).alias("scanned"))
    if not indexed:
        return full.select(F.col("id").alias(id_col), *PLACE, F.array_sort("scanned").alias("found"))
    trigrams = sorted({t for r in indexed for a in queries[r.kind] for t in a})
    hits = candidates(trigram_index(placed, text_col, trigrams), trigrams, {r.kind: queries[r.kind] for r in indexed})
    hits = stage(hits, "secret-candidates")
    read = rows.join(hits, list(PLACE))
    none = F.array().cast("array<struct<start:long,rule:int,end:long,kind:string>>")
    each = [F.when(F.array_contains("rules", r.kind), spans_of(F.col("content"), r, order[r.kind])).otherwise(none) for r in indexed]
    verified = stage(read.select(*PLACE, F.concat(*each).alias("verified")).filter(F.size("verified") > 0), "secret-verified")
    found = F.array_sort(F.concat("scanned", F.coalesce("verified", none)))
    return full.join(verified, list(PLACE), "left").select(F.col("id").alias(id_col), *PLACE, found.alias("found"))


def spans_text(found: Column) -> Column:
    """kind:start:end of spans in order, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kinds(found: Column, kinds) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*kinds))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, each secret replaced by its kind in angle brackets; null texts stay null."""
    placed = with_place(docs)
    found = _scan(placed, rules, id_col, text_col).filter(F.size("found") > 0).select(*PLACE, "found")
    text = held(text_col)

    def replace(done: Column, span: Column) -> Column:
        gap = F.substring(text, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        covered = span["start"] < done["at"]  # a span inside or across an earlier one prolongs it
        added = F.when(covered, F.lit("")).otherwise(F.concat(gap, F.lit("<"), span["kind"], F.lit(">")))
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), F.concat(done["out"], added).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = lambda done: F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
    cleaned = F.when(F.col("found").isNull(), text).otherwise(F.aggregate(F.col("found"), zero, replace, rest))
    joined = placed.join(stage(found, "secret-found"), list(PLACE), "left")
    return given_back(joined, **{text_col: cleaned})
