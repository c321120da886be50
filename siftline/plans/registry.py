"""The rules by id, with what they apply to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..operators import chat_rules, code_rules, file_rules, leakage, schema_rules

KINDS = ("jsonl", "parquet", "python", "corpus")


@dataclass(frozen=True)
class Rule:
    """check: records, row groups or calls (or, for a corpus rule, its own inputs) and settings to findings.

    profiled: the check takes the records' profile of fields too, which is worked out once for all such rules.
    """

    id: str
    category: str
    severity: str
    confidence: str
    kind: str
    check: Callable
    fix: str = ""
    profiled: bool = False


_RULES: dict[str, Rule] = {}


def register(rule: Rule) -> Rule:
    """Adds a rule; an id that is empty or taken, or an unknown kind, is an error."""
    if not rule.id or rule.id in _RULES or rule.kind not in KINDS or not callable(rule.check):
        raise ValueError(f"rule cannot be registered: {rule.id!r}")
    _RULES[rule.id] = rule
    return rule


def rules() -> list[Rule]:
    """All rules in order of their ids."""
    return [_RULES[k] for k in sorted(_RULES)]


def by_id(rule_id: str) -> Rule | None:
    return _RULES.get(rule_id)


for _rule in (
    Rule("jsonl-malformed-line", "file", "error", "high", "jsonl", file_rules.malformed_lines),
    Rule("privacy-pii-detected", "file", "error", "medium", "jsonl", file_rules.personal_data),
    Rule("parquet-row-group-too-large-for-streaming", "file", "warning", "medium", "parquet", file_rules.large_row_groups),
    Rule("field-type-mixed-across-rows", "schema", "warning", "high", "jsonl", schema_rules.mixed_types, profiled=True),
    Rule("field-type-mismatch-with-schema", "schema", "warning", "high", "jsonl", schema_rules.mismatched_types),
    Rule("optional-field-required-by-downstream", "schema", "warning", "medium", "jsonl", schema_rules.optional_fields, profiled=True),
    Rule("enum-drift", "schema", "warning", "medium", "jsonl", schema_rules.enum_drift),
    Rule("role-inversion", "conversation", "error", "high", "jsonl", chat_rules.role_inversion),
    Rule("system-message-mid-conversation", "conversation", "error", "high", "jsonl", chat_rules.system_mid_conversation),
    Rule("unbalanced-tool-call-id", "conversation", "error", "high", "jsonl", chat_rules.unbalanced_tool_calls),
    Rule("tool-result-without-tool-call", "conversation", "error", "high", "jsonl", chat_rules.tool_results_without_calls),
    Rule("system-prompt-leaks-eval-instructions", "leakage", "warning", "medium", "jsonl", chat_rules.system_prompt_leaks),
    Rule("train-eval-overlap", "leakage", "error", "high", "corpus", leakage.train_eval_overlap),
    Rule("cross-dataset-overlap", "leakage", "error", "high", "corpus", leakage.cross_dataset_overlap),
    Rule("random-seed-not-set", "pipeline", "warning", "medium", "python", code_rules.random_seed_not_set, "idiomatic"),
    Rule("shuffle-after-split", "pipeline", "error", "medium", "python", code_rules.shuffle_after_split),
    Rule("dedup-key-misses-normalization", "pipeline", "warning", "low", "python", code_rules.dedup_without_normalization),
):
    register(_rule)
