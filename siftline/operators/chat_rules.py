"""Rules over the order of messages in a conversation, one record each; at most one finding per row and rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..findings import ERROR, WARNING, findings
from ..functions.json_values import items_of, quoted
from . import messages
from .file_rules import first_match, usable

# Phrasings of evaluation instructions.
EVAL_PHRASES = (
    r"(?i)respond (only )?with (one of|the letter|just|a single)",
    r"(?i)answer (only )?with (a|the) (letter|option|choice)",
    r"(?i)the correct answer is",
    r"(?i)choose (from|one of|between) the (following|options|choices)",
    r"(?i)select (your answer|the correct) from",
    r"(?i)from the following options",
    r"(?i)answer in the format",
    r"(?i)pick (one of|the correct|the best)",
)


def _folded(value: str, name: str, kind: str = "variant") -> str:
    """SQL for a member by its name, or else for the last one in order of keys whose name differs in case only; of another type, NULL."""
    # the long s and the sign for kelvin are the only other letters that fold to ASCII ones
    members = f"map_filter(try_variant_get({value}, '$', 'map<string,variant>'), (fold_k, fold_v) -> lower(translate(fold_k, '\u017f\u212a', 'sk')) = '{name}')"
    found = f"coalesce(try_variant_get({value}, '$.{name}', 'variant'), try_element_at(map_values({members}), -1))"
    return found if kind == "variant" else f"try_variant_get({found}, '$', '{kind}')"


def conversations(docs: DataFrame, content: bool = False, tools: bool = False) -> DataFrame:
    """(path, row, messages) of objects whose messages have the expected shape, with at least one.

    A member of another type than expected, in any message, makes the whole row one that these rules cannot read, and
    it is left out; nulls and missing members are empty. `content` and `tools` say which members a rule reads. Names of members may
    be in any case.
    """
    base = docs.where("tag = 'object'").select("path", "row", items_of(F.expr(_folded("doc", "messages"))).alias("m")).where(F.size("m") > 0)
    names = ["role"] + ["content"] * content + ["tool_call_id"] * tools
    texts = " AND ".join(f"coalesce(schema_of_variant({_folded('x', n)}), 'VOID') IN ('VOID', 'STRING')" for n in names)
    calls = _folded("x", "tool_calls")
    shape = f"(schema_of_variant(x) = 'VOID' OR schema_of_variant(x) LIKE 'OBJECT%') AND {texts}"
    items = f"coalesce({_folded('x', 'tool_calls', 'array<variant>')}, cast(array() AS array<variant>))"
    if tools:
        shape += f" AND (coalesce(schema_of_variant({calls}), 'VOID') = 'VOID' OR schema_of_variant({calls}) LIKE 'ARRAY%')"
        inner = f"(schema_of_variant(c) = 'VOID' OR schema_of_variant(c) LIKE 'OBJECT%') AND coalesce(schema_of_variant({_folded('c', 'id')}), 'VOID') IN ('VOID', 'STRING')"
        shape += f" AND forall({items}, c -> {inner})"
    fields = [f"coalesce({_folded('x', n, 'string')}, '') AS {n}" for n in names]
    fields += [f"transform({items}, c -> coalesce({_folded('c', 'id', 'string')}, '')) AS calls"] * tools
    return base.where(F.expr(f"forall(m, x -> {shape})")).select("path", "row", F.expr(f"transform(m, x -> struct({', '.join(fields)}))").alias("messages"))


def _first(condition: str) -> Column:
    """The least index i (from 0) of a message for which a condition over `messages`, `x` and `i` holds; else NULL."""
    return F.expr(f"array_min(filter(transform(messages, (x, i) -> CASE WHEN {condition} THEN i END), y -> y IS NOT NULL))")


def role_inversion(docs: DataFrame, settings: Settings) -> DataFrame:
    at = _first("i > 0 AND x.role = 'assistant' AND get(messages, i - 1).role = 'assistant'")
    hits = conversations(docs).select("path", "row", at.alias("i")).where("i IS NOT NULL")
    message = F.format_string(messages.ROLE_INVERSION, F.col("i"), F.col("i") - 1)
    return findings(hits, "role-inversion", ERROR, message, row=F.col("row"))


def system_mid_conversation(docs: DataFrame, settings: Settings) -> DataFrame:
    hits = conversations(docs).select("path", "row", _first("i > 0 AND x.role = 'system'").alias("i")).where("i IS NOT NULL")
    message = F.format_string(messages.SYSTEM_MID, F.col("i"))
    return findings(hits, "system-message-mid-conversation", ERROR, message, row=F.col("row"))


def unbalanced_tool_calls(docs: DataFrame, settings: Settings) -> DataFrame:
    """The first tool message whose id no earlier assistant message has declared.

    Declarations and references of a row meet by id, so a long conversation costs no more than its messages.
    """
    chats = conversations(docs, tools=True)
    said = chats.select("path", "row", F.posexplode("messages").alias("i", "m"))
    declared = said.where("m.role = 'assistant'").select("path", "row", "i", F.explode("m.calls").alias("id")).where("id <> ''").groupBy("path", "row", "id").agg(F.min("i").alias("since"))
    used = said.where("m.role = 'tool' AND m.tool_call_id <> ''").select("path", "row", "i", F.col("m.tool_call_id").alias("id"))
    loose = used.join(declared, ["path", "row", "id"], "left").where("since IS NULL OR since > i")
    hits = loose.groupBy("path", "row").agg(F.min("i").alias("i"), F.min_by("id", "i").alias("id"))
    message = F.format_string(messages.UNBALANCED_TOOL_CALL, F.col("i"), quoted(F.col("id")))
    return findings(hits, "unbalanced-tool-call-id", ERROR, message, row=F.col("row"))


def tool_results_without_calls(docs: DataFrame, settings: Settings) -> DataFrame:
    chats = conversations(docs, tools=True)
    hits = chats.select("path", "row", _first("x.role = 'tool'").alias("i"), _first("x.role = 'assistant' AND size(x.calls) > 0").alias("call")).where("i IS NOT NULL AND (call IS NULL OR call > i)")
    message = F.format_string(messages.TOOL_WITHOUT_CALL, F.col("i"))
    return findings(hits, "tool-result-without-tool-call", ERROR, message, row=F.col("row"))


def system_prompt_leaks(docs: DataFrame, settings: Settings) -> DataFrame:
    """The first system message that any phrasing matches, and the first phrasing in order that does."""
    patterns = [("", p) for p in EVAL_PHRASES] + [("", p) for raw in settings.texts("extra_patterns") if (p := usable(raw))]
    said = conversations(docs, content=True).select("path", "row", F.posexplode("messages").alias("i", "m")).where("m.role = 'system' AND m.content <> ''")
    hits = said.select("path", "row", "i", first_match(F.col("m.content"), patterns)["sample"].alias("sample")).where("sample IS NOT NULL")
    first = hits.groupBy("path", "row").agg(F.min("i").alias("i"), F.min_by("sample", "i").alias("sample"))
    message = F.format_string(messages.EVAL_INSTRUCTION, F.col("i"), quoted(F.col("sample")))
    return findings(first, "system-prompt-leaks-eval-instructions", WARNING, message, row=F.col("row"))
