"""Chat formatting: schema fingerprints choose declarative mappings from any known layout to canonical turns.

A record's fingerprint hashes the sorted nested field paths that it fills, out of the paths that the mappings know. A
mapping names the paths that it needs, those it may use, and the turns that it makes of them; its fingerprints are those
of all such choices. A record whose fingerprint belongs to no mapping gets null turns and the layout null.

The template writes a turn as

    ### role:
    text
    </turn>

Control strings inside a text (### and </turn>) get one more backslash in front of them and of any backslashes that already
precede them, so that reading back takes that one away and is exact. Roles are percent-encoded where they need it. The
text under the loss mask is that of assistant turns; the mask is kept as spans of code points of the formatted string.

DataFrame functions only. Edge cases: null texts and roles are empty; turns of one conversation lie in order of (turn, role,
text), null turns first, so ties have a defined order and repeated rows stay. A row with a null conv_id is a conversation
by itself.
An empty table gives an empty result. Extra columns are no paths of a mapping and are ignored. One conversation is
one string, so it has to fit a row; conversations are spread by their ids.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import before_each, bound

OPEN, CLOSE = "### ", "\n</turn>\n"
CONTROL = r"(\\*)(###|</turn>)"
ESCAPED = r"\\(\\*)(###|</turn>)"
TURNS = "array<struct<role:string,text:string>>"
#: Names of speakers in the layout of `from` and `value`; in other layouts roles are kept as they stand.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """turns: (role or path of the role, path of the text) in order; `each` is the array that holds them, if one does.

    renamed: whether the layout's names of speakers are those of ROLES.
    """

    layout: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    each: str | None = None
    renamed: bool = False

    def path_sets(self) -> list[tuple[str, ...]]:
        """Every set of paths that fits, apart from none at all."""
        return [p for n in range(len(self.may) + 1) for extra in combinations(self.may, n) if (p := tuple(sorted((*self.needs, *extra))))]


MAPPINGS = (
    Mapping("turn rows", (), ("conv_id", "turn", "role", "text"), (("@role", "text"),)),
    Mapping("messages", ("messages[].role",), ("messages[].content",), (("@role", "content"),), "messages"),
    Mapping("from and value", ("conversations[].from",), ("conversations[].value",), (("@from", "value"),), "conversations", True),
    Mapping("instruction", ("instruction",), ("system", "input", "output"), (("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Mapping("prompt and completion", ("prompt",), ("system", "completion"), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and response", ("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question and answer", ("question",), ("answer",), (("user", "question"), ("assistant", "answer"))),
)
KNOWN = sorted({p for m in MAPPINGS for s in m.path_sets() for p in s})


def field_paths(schema: StructType, prefix: str = "") -> list[str]:
    """Nested paths of a schema's leaves, arrays marked by []."""
    out = []
    for f in schema.fields:
        kind, name = f.dataType, prefix + f.name
        if isinstance(kind, ArrayType):
            kind, name = kind.elementType, name + "[]"
        out += field_paths(kind, name + ".") if isinstance(kind, StructType) else [name]
    return out


def _filled(path: str) -> Column:
    array, _, field = path.partition("[].")
    return F.exists(F.col(array), lambda x: x[field].isNotNull()) if field else F.col(path).isNotNull()


def _hash(paths: Column) -> Column:
    return F.substring(F.sha2(paths, 256), 1, 16)


def with_fingerprint(records: DataFrame) -> DataFrame:
    """records with `fingerprint`: the hash of the known nested paths that each fills."""
    there = sorted(set(field_paths(records.schema)) & set(KNOWN))
    return records.withColumn("fingerprint", _hash(F.concat_ws(",", *(F.when(_filled(p), F.lit(p)) for p in there)) if there else F.lit("")))


def _turns(mapping: Mapping, there: set[str]) -> Column:
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    spoken = lambda role: F.coalesce(names[F.lower(role)], role) if mapping.renamed else role

    def column(path: str) -> Column:
        return F.col(path).cast("string") if path in there else F.lit(None).cast("string")

    if mapping.each:
        ((role, text),) = mapping.turns
        has_text = f"{mapping.each}[].{text}" in there
        return F.transform(F.col(mapping.each), lambda m: turn(spoken(m[role[1:]]), m[text].cast("string") if has_text else F.lit(None).cast("string")))
    made = []
    for role, path in mapping.turns:
        first, _, second = path.partition("+")
        text = F.when(column(second) != "", F.concat_ws("\n\n", column(first), column(second))).otherwise(column(first)) if second else column(first)
        one = turn(spoken(column(role[1:])) if role.startswith("@") else F.lit(role), text)
        made.append(F.array(one) if first in mapping.needs or role.startswith("@") else F.when(column(first).isNotNull(), F.array(one)).otherwise(F.array().cast(TURNS)))
    return F.concat(*made).cast(TURNS)


def canonical_turns(records: DataFrame) -> DataFrame:
    """records with fingerprint, layout and turns, by the mapping that the fingerprint selects; unknown: null."""
    marked, there = with_fingerprint(records), set(field_paths(records.schema))
    known = [(",".join(s), m.layout) for m in reversed(MAPPINGS) for s in m.path_sets()]
    layouts = F.create_map(*(x for paths, layout in dict(known).items() for x in (_hash(F.lit(paths)), F.lit(layout))))
    marked = marked.withColumn("layout", layouts[F.col("fingerprint")])
    turns = F.lit(None).cast(TURNS)
    for m in MAPPINGS:
        if set(m.needs) <= there:
            turns = F.when(F.col("layout") == m.layout, _turns(m, there)).otherwise(turns)
    return marked.withColumn("turns", turns)


def gather(rows: DataFrame) -> DataFrame:
    """conv_id and the turns of each conversation, from rows of one turn each (conv_id, turn, role, text).

    A row without a conv_id belongs to no other and is a conversation by itself.
    """
    blank = F.array(F.struct(F.lit("").alias("role"), F.lit("").alias("text")))  # a row of nulls only is an empty turn
    made = canonical_turns(rows).select("conv_id", "turn", F.coalesce("turns", blank).alias("turns"))
    apart = made.where("conv_id IS NULL").select("conv_id", "turns")
    said = made.where("conv_id IS NOT NULL").select("conv_id", "turn", F.explode("turns").alias("said"))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn"), F.lit(-(2**62))).alias("turn"), "said.role", "said.text")))
    return said.groupBy("conv_id").agg(ordered.alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns")).unionByName(apart)


def format_chat(chats: DataFrame) -> DataFrame:
    """chats (turns as arrays of role and text) with `formatted` and `loss` in place of turns.

    loss: the spans of assistant texts, start and stop in code points, first and last in bytes, ends exclusive.
    """
    parts = F.transform("turns", lambda t: F.struct((t.role == "assistant").alias("learnt"), F.concat(F.lit(OPEN), F.url_encode(t.role), F.lit(":\n")).alias("head"), F.regexp_replace(t.text, CONTROL, r"\\$1$2").alias("body")))
    made = chats.withColumn("_parts", parts).drop("turns")
    formatted = F.array_join(F.transform("_parts", lambda p: F.concat(p.head, p.body, F.lit(CLOSE))), "")
    both = lambda chars, raw: F.struct(chars.alias("chars"), raw.alias("bytes"))
    moved = F.transform("_parts", lambda p: both(F.length(p.head) + F.length(p.body) + len(CLOSE), F.octet_length(p.head) + F.octet_length(p.body) + len(CLOSE)))
    at = before_each(moved, both(F.lit(0), F.lit(0)), lambda a, b: both(a.chars + b.chars, a.bytes + b.bytes))

    def span(a: Column, p: Column) -> Column:
        start, first = a.chars + F.length(p.head), a.bytes + F.octet_length(p.head)
        ends = ((start + F.length(p.body)).alias("stop"), first.alias("first"), (first + F.octet_length(p.body)).alias("last"))
        return F.when(p.learnt, F.struct(start.alias("start"), *ends))

    loss = F.filter(F.zip_with(at, "_parts", span), lambda s: s.isNotNull())
    return made.withColumns({"formatted": formatted, "loss": loss}).drop("_parts")


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string."""
    parts = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")
    role = lambda p: F.url_decode(F.regexp_replace(F.substring_index(p, "\n", 1), "^### |:$", ""))
    return F.transform(parts, lambda p: F.struct(role(p).alias("role"), _plain(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped span by span."""
    said = lambda raw: F.transform(loss, lambda s: _plain(F.substring(raw, s["first"] + 1, s["last"] - s["first"]).cast("string")))
    return F.array_join(bound(formatted.cast("binary"), said), "")
