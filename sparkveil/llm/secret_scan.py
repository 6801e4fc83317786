"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule is a regular expression. ``trigram_query`` derives a Boolean query over lower-case
trigrams that every match must satisfy. The index holds postings (trigram, document) for the
trigrams that the rules ask for. A document's postings are intersected as bits, the rules' queries
pick candidates, and only candidates are verified with the regular expressions. Rules without a
mandatory trigram scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.session import materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``value`` is the group whose length counts (0: the match), ``least`` its
    smallest length; a shorter match is dropped but has used up its text."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 0


#: The rules of the base scan, in their order.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Published formats of keys and tokens that the method adds.
ADDED = (
    Rule("private_key", r"-----BEGIN\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY(?:\x20BLOCK)?-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("vcs_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]*://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/@]+@"),
)
RULES = BASE + ADDED
#: Candidate documents are broadcast up to this many rows of 16 bytes; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1 << 19
_EXACT = 12


# ---- Boolean trigram queries: True, or ("and"|"or", operands), or a trigram ----

def _and(*parts):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(*parts):
    if any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: list[str]):
    """Any of these strings occurs."""
    return _or(*[_and(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


class _Pattern:
    """A regular expression as nodes: ("text", the few strings a node can match, lower-cased), ("any",),
    ("group", sequences, one for each branch) and ("times", least, most or None, sequence). It knows what
    the rules use: literals and escapes, classes, groups, branches and quantifiers."""

    SHORT = {"t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r"}

    def __init__(self, pattern: str):
        self.p, self.at = pattern, 0
        self.branches = self._branches()
        if self.at != len(pattern):
            raise ValueError(f"unbalanced pattern {pattern!r}")

    def _next(self, n: int = 1) -> str:
        self.at += n
        return self.p[self.at - n : self.at]

    def _branches(self) -> list[list[tuple]]:
        out = [self._sequence()]
        while self.p[self.at : self.at + 1] == "|":
            self.at += 1
            out.append(self._sequence())
        return out

    def _sequence(self) -> list[tuple]:
        nodes = []
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            nodes.append(self._counted(self._atom()))
        return nodes

    def _counted(self, node: tuple) -> tuple:
        m = re.compile(r"[?*+]|\{(\d+)(,?)(\d*)\}").match(self.p, self.at)
        if not m:
            return node
        self.at = m.end()
        if self.p[self.at : self.at + 1] in ("?", "+"):  # lazy or possessive: the same strings
            self.at += 1
        if m[1] is None:
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[m[0]]
        else:
            least, most = int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1])
        return ("times", least, most, [node])

    def _atom(self) -> tuple:
        c = self._next()
        if c == "(":
            m = re.compile(r"\?(?:[a-z]*:|P<\w+>)").match(self.p, self.at)
            self.at = m.end() if m else self.at
            if self.p[self.at : self.at + 1] == "?":
                raise ValueError(f"look-around is not understood: {self.p!r}")
            branches = self._branches()
            if self._next() != ")":
                raise ValueError(f"unbalanced pattern {self.p!r}")
            return ("group", branches)
        if c == "[":
            return self._class()
        if c in ".^$":
            return ("any",)
        return self._escape() if c == "\\" else ("text", [c.lower()])

    def _escape(self) -> tuple:
        c = self._next()
        if c == "x":
            return ("text", [chr(int(self._next(2), 16)).lower()])
        if c in self.SHORT:
            return ("text", [self.SHORT[c]])
        return ("any",) if c.isalnum() else ("text", [c])

    def _class(self) -> tuple:
        negated, chars, known = self.p[self.at : self.at + 1] == "^", set(), True
        self.at += negated
        while True:
            c = self._next()
            if c == "]":
                break
            if not c:
                raise ValueError(f"unbalanced pattern {self.p!r}")
            node = self._escape() if c == "\\" else ("text", [c.lower()])
            known = known and node[0] == "text" and not (self.p[self.at : self.at + 1] == "-" and self.p[self.at + 1 : self.at + 2] != "]")
            chars |= set(node[1]) if node[0] == "text" else set()
        return ("text", sorted(chars)) if known and not negated and len(chars) <= 5 else ("any",)


def _strings(node: tuple) -> list[str] | None:
    """All the texts a node can match, lower-cased, if they are few."""
    if node[0] == "text":
        return node[1]
    if node[0] == "group":
        parts = [_sequence_strings(x) for x in node[1]]
        return None if any(p is None for p in parts) or sum(map(len, parts)) > _EXACT else [s for p in parts for s in p]
    if node[0] == "times" and node[1:3] == (0, 1):
        inner = _sequence_strings(node[3])
        return None if inner is None else ["", *inner]
    return None


def _sequence_strings(nodes: list[tuple]) -> list[str] | None:
    out = [""]
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > _EXACT:
            return None
        out = [a + b for a in out for b in more]
    return out


def _query(nodes: list[tuple]):
    """The query of a sequence: what its runs of known strings ask for, and its other parts."""
    parts, run = [], [""]
    for node in nodes:
        more = _strings(node)
        if more is not None and len(run) * len(more) <= _EXACT:
            run = [a + b for a in run for b in more]
            continue
        parts.append(_of_strings(run))
        run = [""]
        if more is not None:
            run = more
        elif node[0] == "group":
            parts.append(_or(*[_query(x) for x in node[1]]))
        elif node[0] == "times" and node[1] >= 1:
            parts.append(_query(node[3]))
    return _and(*parts, _of_strings(run))


def trigram_query(pattern: str):
    """What lower-case trigrams a text needs to match: True if nothing is mandatory. The strings are
    ASCII, and the index lower-cases the texts, so the case of the pattern doesn't matter."""
    return _or(*[_query(x) for x in _Pattern(pattern).branches])


def trigrams_of(query) -> list[str]:
    if query is True:
        return []
    if isinstance(query, str):
        return [query]
    return list(dict.fromkeys(t for q in query[1] for t in trigrams_of(q)))


def holds(query, has):
    """Evaluate a query; ``has`` gives the truth of a trigram as a bool or Column."""
    if isinstance(query, str):
        return has(query)
    parts = [holds(q, has) for q in query[1]]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


# ---- index ----

_WORD = 60  # bits of a posting word in use


def trigram_index(df: DataFrame, id_col: str, text_col: str, trigrams: list[str]) -> DataFrame:
    """Postings ``trigram`` (position in ``trigrams``), ``id`` of the documents that contain it."""
    rows = df.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_low"))
    present = F.array(*[F.when(F.col("_low").contains(t), F.lit(i)) for i, t in enumerate(trigrams)])
    return rows.select("id", F.explode(F.array_compact(present)).alias("trigram"))


def candidates(postings: DataFrame, queries: list, trigrams: list[str]) -> DataFrame:
    """``id, rules``: the documents whose postings satisfy a query, and the bits of those queries."""
    at = {t: i for i, t in enumerate(trigrams)}
    words = range(-(-len(trigrams) // _WORD))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("trigram"), F.lit(_WORD)).cast("int"))
    own = [F.bit_or(F.when(F.floor(F.col("trigram") / _WORD) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words]
    docs = postings.groupBy("id").agg(*own)
    has = lambda t: F.col(f"w{at[t] // _WORD}").bitwiseAND(F.lit(1 << (at[t] % _WORD)).cast("long")) != 0
    rules = reduce(lambda a, b: a.bitwiseOR(b), [F.when(holds(q, has), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, q in enumerate(queries)])
    return docs.select("id", rules.alias("rules")).where("rules != 0")


def find_spans(text: Column, rule: Rule, order: int) -> Column:
    """The spans of a rule in a text, as structs start, order, end, in code points: the pieces
    between the matches and the matches alternate, so their lengths give the positions."""
    found, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("p"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,end:int>>").alias("spans"))

    def step(acc, x):
        start = acc["at"] + F.char_length(x["p"])
        end = start + F.char_length(x["m"])
        value = F.char_length(F.regexp_extract(x["m"], rule.pattern, rule.value)) if rule.value else F.char_length(x["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(value >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(steps, first, step, lambda acc: acc["spans"])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: ``doc_id`` and ``found``, all spans as structs start, order (of the
    rule), end, sorted.

    Defined cases: a null text counts as empty and has no spans; a text of any length is scanned whole
    (its list of spans is built match by match, which is quadratic in the matches of one rule in one
    text); rows with the same id are looked up
    together, which only adds candidates; a null id is an id like any other; repeated rows are
    returned as often as they came; an empty table gives an empty result; other columns are ignored.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    indexed = [i for i, q in enumerate(queries) if q is not True]
    trigrams = list(dict.fromkeys(t for i in indexed for t in trigrams_of(queries[i])))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if indexed:
        postings = trigram_index(df, id_col, text_col, trigrams)
        written = materialize(candidates(postings, [queries[i] for i in indexed], trigrams), "secret-candidates")
        found = written.withColumnRenamed("id", "_id")
        if written.count() <= BROADCAST_ROWS:
            found = F.broadcast(found)
        rows = rows.join(found, F.col("id").eqNullSafe(F.col("_id")), "left")
    else:
        rows = rows.withColumn("rules", F.lit(0).cast("long"))
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")
    spans = []
    for i, rule in enumerate(rules):
        if i in indexed:
            bit = F.lit(1 << indexed.index(i)).cast("long")
            verify = F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(bit) != 0
        else:  # a long enough run must be there at all
            verify = F.col("text").rlike(_at_least(rule))
        spans.append(F.when(verify, find_spans(F.col("text"), rule, i)).otherwise(none))
    return rows.select(F.col("id").alias(id_col), F.array_sort(F.concat(*spans)).alias("found"))


def _at_least(rule: Rule) -> str:
    """For a rule that is one repeated class: the class repeated ``least`` times."""
    if rule.value == 0 and rule.least > 1 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        return f"{rule.pattern[:-1]}{{{rule.least}}}"
    return rule.pattern


def span_list(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
