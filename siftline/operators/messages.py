"""The texts of findings."""

# Users filter, count and allow findings by these texts, so they have to be literally what they were.
BLANK_LINE = "blank line in JSONL"
PERSONAL_DATA = "%s pattern matched in field %s (sample: %s); training data should not carry user PII"
LARGE_ROW_GROUP = "row group %d has %d rows (>%d); streaming readers will buffer the whole group before projecting columns"
MIXED_TYPES = "field %s has mixed types: %s dominant (%d rows); %s first seen here (%d rows)"
MISMATCHED_TYPE = "path %s declared as %s but observed as %s in %d value(s); first at row %d"
MISSING_REQUIRED = "schema declares %s as required but %d/%d rows are missing it"
MOSTLY_PRESENT = "field %s appears in %d/%d rows (%s%%); either mark it required or check the missing rows"
ENUM_DRIFT = "field %s gained value %s not seen in the first %d lock-in rows"
ROLE_INVERSION = "assistant message at index %d follows assistant at index %d with no user/tool between"
SYSTEM_MID = "system message at index %d (only index 0 is conventional); likely a misformatted prompt template"
UNBALANCED_TOOL_CALL = "tool message at index %d references tool_call_id %s with no preceding assistant tool_calls entry"
TOOL_WITHOUT_CALL = "tool message at index %d has no preceding assistant message with tool_calls"
EVAL_INSTRUCTION = "system message at index %d matches eval-instruction pattern %s"
EXACT_OVERLAP = "eval prompt also appears in train at %s row %d"
NEAR_OVERLAP = "eval prompt is a near-duplicate (similarity %s) of train at %s row %d"
EXACT_CROSS_OVERLAP = "prompt also appears in dataset %s at %s row %d (this row is in dataset %s)"
NEAR_CROSS_OVERLAP = "prompt is a near-duplicate (similarity %s) of dataset %s at %s row %d (this row is in dataset %s)"
SEED_NOT_SET = "%s called without random.seed/np.random.seed earlier in this file; pipeline output is non-reproducible"
SEED_FIX = "insert %s at line %d for reproducibility"
SHUFFLE_AFTER_SPLIT = "%s called after train/eval split; either shuffle before splitting or seed each split's RNG explicitly"
DEDUP_WITHOUT_NORMALIZATION = "%s called with no string normalization (lower/strip/casefold/unicodedata.normalize) elsewhere in this file; near-duplicates may slip through"
