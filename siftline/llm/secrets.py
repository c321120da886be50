"""Secret scans: a trigram index narrows down which rules can match which text; candidates are verified by the rules.

Each rule's regular expression gives a Boolean trigram query: an OR of sets of trigrams, lower case, of which a match has
one set whole. The index holds a posting (trigram, text key) for every trigram of the queries that a text has. Postings of
a set are intersected by counting them per text; a text with all of a set is a candidate for the rule. A rule whose
expression promises no trigram (a run of hex digits) scans every text. Then all rules are verified on the texts: where a
match lies comes from the lengths of the pieces between matches, in code points.

DataFrame functions only. Edge cases: a null text is empty and has no spans; the key of a text hashes doc_id and text, so
repeated rows share postings and each keeps its row, and keys that collide only add candidates, which verification drops.
Null doc_ids are kept. Letters of `assign` fold in ASCII only. A span is the whole match. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before_each, bound, plain_names


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern`, leftmost and non-overlapping, whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds come first, in this order.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    # to the END line, or over the lines of base64 if there is none
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:(?:[\r\n]+[A-Za-z]+-[A-Za-z]+: [^\r\n]{0,200}){0,4}[A-Za-z0-9+/=\r\n\t ]*-----END [A-Z ]{0,24}PRIVATE KEY-----|[A-Za-z0-9+/=\r\n]*)"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"://[A-Za-z0-9._%+-]*:[A-Za-z0-9._%+!$&*-]{3,}@"),
)
RULES = BASE + MORE
#: Alternatives of a string that are followed up, and characters of a class that count as alternatives.
MOST_STRINGS, MOST_CHARACTERS = 64, 6


_GROUP = re.compile(r"\?(?:[a-z]*:|P<\w+>)")
_QUANTIFIER = re.compile(r"(?:([?*+])|\{(\d+)(,?)(\d*)\})[?+]?")
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}


def parts_of(pattern: str) -> list[list[tuple]]:
    """The branches of a pattern, each a list of (options, least, most).

    options: the characters that a part may be, a list of branches for a group, or None if they are many or unknown; most:
    None without a bound. Look-around and back references are refused.
    """
    at = 0

    def escape() -> set[str] | None:
        nonlocal at
        c, at = pattern[at], at + 1
        if c == "x":
            at += 2
            return {chr(int(pattern[at - 2 : at], 16))}
        if c.isdigit():
            raise ValueError(f"back reference in {pattern}")
        return {c} if not c.isalpha() else {_ESCAPED[c]} if c in _ESCAPED else None

    def one_of() -> set[str] | None:
        nonlocal at
        found, known, begin = set(), pattern[at] != "^", at
        at += not known
        while pattern[at] != "]" or at == begin:
            c, at = pattern[at], at + 1
            members = escape() if c == "\\" else {c}
            if members and pattern[at] == "-" and pattern[at + 1] != "]":
                last, at = pattern[at + 1], at + 2
                members = {chr(k) for k in range(ord(min(members)), ord(last) + 1)}
            known &= members is not None
            found |= members or set()
        at += 1
        return found if known else None

    def branches() -> list[list[tuple]]:
        nonlocal at
        found: list[list[tuple]] = [[]]
        while at < len(pattern) and pattern[at] != ")":
            c, at = pattern[at], at + 1
            if c == "|":
                found.append([])
                continue
            if c in "^$":
                continue
            if c == "(":
                if pattern[at] == "?":
                    head = _GROUP.match(pattern, at)
                    if not head:
                        raise ValueError(f"look-around in {pattern}")
                    at = head.end()
                options = branches()
                at += 1
            else:
                options = one_of() if c == "[" else escape() if c == "\\" else None if c == "." else {c}
            least, most = 1, 1
            if many := _QUANTIFIER.match(pattern, at):
                at = many.end()
                mark, low, comma, high = many.groups()
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[mark] if mark else (int(low), int(high) if high else None if comma else int(low))
            found[-1].append((options, least, most))
        return found

    return branches()


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of lower-case trigrams of which every match contains one set whole; None if nothing is certain."""
    clauses: list[set[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if sets and frozenset() not in sets:
            clauses.append({a for a in sets if not any(b < a for b in sets)})

    def exact(options, least: int, most: int | None) -> set[str] | None:
        """All the strings that a part can match, if they are few."""
        if isinstance(options, list):
            each = [exact_all(b) for b in options]
            options = None if any(e is None for e in each) else set().union(*each)
        elif options is not None:
            options = {c.lower() for c in options}
            options = options if len(options) <= MOST_CHARACTERS else None
        if options is None or most is None or most > 5 or len(options) ** most > MOST_STRINGS:
            return None
        return {"".join(p) for n in range(least, most + 1) for p in product(options, repeat=n)}

    def exact_all(parts) -> set[str] | None:
        strings = {""}
        for part in parts:
            found = exact(*part)
            if found is None or len(strings) * len(found) > MOST_STRINGS:
                return None
            strings = {a + b for a in strings for b in found}
        return strings

    branches, strings = parts_of(pattern), {""}
    for part in branches[0] if len(branches) == 1 else [(branches, 1, 1)]:
        found = exact(*part)
        if found is None or len(strings) * len(found) > MOST_STRINGS:
            close(strings)
            strings = found if found is not None else {""}
        else:
            strings = {a + b for a in strings for b in found}
    close(strings)
    query = [frozenset()]
    for clause in clauses:  # the clauses hold together; one that would make too many sets is left out
        if len(query) * len(clause) <= MOST_STRINGS:
            query = [a | b for a in query for b in clause]
    return None if query == [frozenset()] else sorted(set(query), key=sorted)


def keyed(docs: DataFrame) -> DataFrame:
    """_key, doc_id, the whole row as _row, and text, a null text empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col("doc_id"), text).alias("_key"), "doc_id", F.struct(*docs.columns).alias("_row"), text.alias("text"))


def postings(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The index: (_key, trigram) for every trigram of the rules' queries that a text has."""
    grams = sorted({g for r in rules for s in trigram_query(r.pattern) or [] for g in s})
    known = F.array(*(F.lit(g) for g in grams))
    found = F.transform(F.array(F.lower("text")), lambda low: F.filter(known, lambda g: F.contains(low, g)))[0]
    return texts.select("_key", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """_key and the kinds whose trigram query the postings of the text meet."""
    wanted = [(r.kind, i, g, len(s)) for r in rules for i, s in enumerate(trigram_query(r.pattern) or []) for g in sorted(s)]
    wanted = index.sparkSession.createDataFrame(wanted, "kind string, branch int, trigram string, needed int")
    met = index.join(F.broadcast(wanted), "trigram").groupBy("_key", "kind", "branch").agg(F.count_distinct("trigram").alias("n"), F.first("needed").alias("needed"))
    return met.where("n = needed").groupBy("_key").agg(F.collect_set("kind").alias("kinds"))


SPAN = "struct<start:int,rank:int,kind:string,stop:int,first:int,last:int>"


def spans_of(text: Column, rule: Rule, rank: int = 0) -> Column:
    """Array of the rule's matches as SPAN: start and stop in code points, first and last in bytes, ends exclusive."""
    pattern = F.lit(rule.pattern)
    whole, part = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    sized = lambda x, *more: F.struct(F.length(x).alias("chars"), F.octet_length(x).alias("bytes"), *more)
    hits = F.zip_with(whole, part, lambda w, p: sized(w, F.length(p).alias("group")))
    met = F.zip_with(F.transform(F.split(text, rule.pattern, -1), lambda g: sized(g)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))

    def placed(met: Column) -> Column:
        moved = F.transform(met, lambda m: F.struct((m.gap.chars + m.hit.chars).alias("chars"), (m.gap.bytes + m.hit.bytes).alias("bytes")))
        zero = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("bytes"))
        at = before_each(moved, zero, lambda a, b: F.struct((a.chars + b.chars).alias("chars"), (a.bytes + b.bytes).alias("bytes")))

        def span(a: Column, m: Column) -> Column:
            start, first = a.chars + m.gap.chars, a.bytes + m.gap.bytes
            ends = ((start + m.hit.chars).alias("stop"), first.alias("first"), (first + m.hit.bytes).alias("last"))
            return F.when(m.hit.group >= rule.least, F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), *ends))

        return F.filter(F.zip_with(at, met, span), lambda x: x.isNotNull())

    return bound(F.filter(met, lambda m: m.hit.isNotNull()), placed).cast(f"array<{SPAN}>")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the row of each document as _row, its text, and found: an array of SPAN in the order of its fields."""
    whole = docs.schema
    docs, _ = plain_names(docs, "doc_id", "text")
    texts = keyed(docs)
    narrowed = candidates(postings(texts, rules), rules)
    joined = texts.join(narrowed.hint("shuffle_hash"), "_key", "left")
    none, found = F.array().cast(f"array<{SPAN}>"), []
    for rank, rule in enumerate(rules):
        possible = F.array_contains("kinds", rule.kind) if trigram_query(rule.pattern) else F.col("text").rlike(rule.pattern)
        found.append(F.when(possible, spans_of(F.col("text"), rule, rank)).otherwise(none))
    return joined.select("doc_id", F.col("_row").cast(whole).alias("_row"), "text", F.array_sort(F.concat(*found)).alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans of each document."""
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long")
    return scanned.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs, all columns (whatever their names) and rows, with each secret in a text replaced by its kind in angle brackets, n_chars set anew.

    Spans that overlap are masked together under the kind of the first. Texts without secrets stay as they are.
    """
    docs, back = plain_names(docs, "doc_id", "text", "n_chars")
    scanned = scan_secrets(docs, rules)
    seen = before_each(F.transform("found", lambda s: s["last"]), F.lit(0), lambda a, b: F.greatest(a, b))

    def pieces(raw: Column) -> Column:
        kept = lambda a, b: F.substring(raw, a + 1, b - a).cast("string")
        masked = F.zip_with("found", seen, lambda s, at: F.when(s["first"] >= at, F.concat(kept(at, s["first"]), F.lit("<"), s.kind, F.lit(">"))).otherwise(""))
        return F.concat(F.array_join(masked, ""), kept(F.array_max(F.transform("found", lambda s: s["last"])), F.octet_length(raw)))

    masked = bound(F.col("text").cast("binary"), pieces)
    scanned = scanned.withColumn("_masked", F.when(F.size("found") > 0, masked))
    columns = {c: F.col("_row")[c] for c in docs.columns}
    columns["text"] = F.coalesce(F.col("_masked"), F.col("_row")["text"])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("_masked").isNotNull(), F.length("_masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row")["n_chars"])
    return back(scanned.select(*(v.alias(c) for c, v in columns.items())))
