"""The queries of this subpackage: QUERIES by name, and ORACLES, the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import FILTERS, audit, steps
from .bpe import round_trip
from .chat import format_chat, gather, loss_text, read_back
from .classifier import classify
from .common import cut_table, table
from .embeddings import near_dedup
from .fingerprints import fingerprint_all, with_near
from .jaccard import jaccard_join
from .mixing import mixture
from .quality_rules import quality_rules
from .secrets import BASE, RULES, digest, scan_secrets
from .sharding import measured, shuffle_into_shards
from .token_counts import edit_trees, keep_trees, three_edits
from .trie import prefix_trie


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(table(spark, sf_dir, "documents")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = measured(shuffle_into_shards(table(spark, sf_dir, "documents")), "shard", "slot")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_near(fingerprint_all(table(spark, sf_dir, "documents")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    added = [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    rows = rows.unionByName(spark.createDataFrame(added, rows.schema))
    done = format_chat(gather(rows)).withColumns({"turns": read_back(F.col("formatted")), "learnt": loss_text(F.col("formatted"), F.col("loss"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cut_table(keep_trees(table(spark, sf_dir, "documents")))
    edited = edit_trees(kept.withColumn("edits", three_edits()), texts=False)
    return edited.select("doc_id", F.col("tokens_before").alias("n_tokens"), F.col("n_chars").alias("edited_chars"), F.col("n_tokens").alias("edited_tokens"), F.col("pretokens_before").alias("n_pretokens"), "reencoded")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_sharding": op3_sharding,
    "op4_fingerprints": op4_fingerprints,
    "op5_chat_format": op5_chat_format,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_bpe": op9_bpe,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_filter_audit": op13_filter_audit,
}

OP7_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
rests AS (SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
  CAST(sum(weight) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS shares FROM per),
marked AS (SELECT *, weight * rest > 3 * source_size * shares AS capped FROM rests),
opened AS (SELECT arg_max(rest, shares) AS open_rest, max(shares) AS open_shares FROM marked WHERE NOT capped),
goals AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * open_rest AS DOUBLE) / CAST(open_shares AS DOUBLE) END AS target FROM marked LEFT JOIN opened ON true),
rates AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / CAST(source_size AS DOUBLE) END AS rate, CAST(CAST('0x' || substr(md5('7:' || coalesce('s' || source, 'n')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM goals),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) AS place FROM sized)
SELECT doc_id, size, source_size, target, CAST(size * (floor(CAST(place AS DOUBLE) * rate + u) - floor(CAST(place - 1 AS DOUBLE) * rate + u)) AS BIGINT) AS taken
FROM ranked JOIN rates ON ranked.source IS NOT DISTINCT FROM rates.source
"""

OP5_SQL = r"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
chats AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
  string_agg('### ' || role || ':' || chr(10) || regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g') || chr(10) || '</turn>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS formatted
  FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM said) GROUP BY conv_id, alone)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, length(formatted) AS formatted_chars FROM chats
"""


def _op1_sql() -> str:
    """The rules on every text, without an index. Letters that fold are spelt out, as DuckDB would fold more than ASCII."""

    def spelt(pattern: str) -> str:
        head, sep, tail = pattern.partition("(?i:")
        inside, _, rest = tail.partition(")")
        folded = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in inside)
        return (f"{head}(?:{folded}){rest}" if sep else pattern).replace("'", "''")

    found = " UNION ALL ".join(
        f"SELECT doc_id, row_id, {k} AS rank, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(text, '{spelt(r.pattern)}') AS gaps, "
        f"regexp_extract_all(text, '{spelt(r.pattern)}', 0) AS hits, regexp_extract_all(text, '{spelt(r.pattern)}', {r.group}) AS parts FROM texts"
        for k, r in enumerate(RULES)
    )
    base = len(BASE)
    return f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
placed AS (SELECT row_id, rank, kind, least, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, parts FROM found),
spans AS (SELECT row_id, rank, kind, length(parts[i]) AS size, least, list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(h) FOR h IN hits[1:i - 1]]), 0) AS start, length(hits[i]) AS n FROM placed),
good AS (SELECT row_id, rank, kind, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS span FROM spans WHERE size >= least),
per AS (SELECT row_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < {base}) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM good GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN per USING (row_id)
"""


OP11_SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS i, d, n FROM (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL)),
""" + "".join(f"bits{k + 1} AS (SELECT {'range AS byte, range AS crc FROM range(256)' if k == 0 else f'byte, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END AS crc FROM bits{k}'}),\n" for k in range(9)) + """crcs AS (SELECT map_from_entries(list((byte, crc))) AS m FROM bits9),
convs AS (SELECT c, c - c % 100 AS base, xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(c AS VARCHAR), '')], lambda crc, b: xor(crc >> 8, m[xor(crc, b) & 255])), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t), crcs),
turns AS (SELECT convs.c, t.i AS pos, d, n FROM convs JOIN t ON t.c = base AND t.i <= h UNION ALL SELECT convs.c, t.i, d, n FROM convs JOIN t ON t.c = convs.c AND t.i > h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS depth, d, n FROM turns),
visits AS (SELECT c, 0 AS depth, '' AS node, NULL AS parent, 0 AS n FROM convs UNION ALL
  SELECT c, depth, string_agg(d, '') OVER w, coalesce(string_agg(d, '') OVER (PARTITION BY c ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), n FROM placed WINDOW w AS (PARTITION BY c ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
most AS (SELECT c, max(depth) AS most FROM visits GROUP BY c),
nodes AS (SELECT node, any_value(parent) AS parent, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(n) AS n,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE depth = most), '')) AS ends FROM visits JOIN most USING (c) GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS k FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT v.node AS top, u.node FROM visits v JOIN visits u ON u.c = v.c AND u.depth >= v.depth),
sums AS (SELECT top AS node, count(*) FILTER (WHERE k IS NULL) AS leaves, sum((n_convs - 1) * n) AS saved FROM below JOIN nodes USING (node) LEFT JOIN kids USING (node) GROUP BY top)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
FROM nodes a JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes p ON p.node = a.parent
"""

#: Links of all pairs, then the least id that links reach.
OP12_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER () AS r, CASE WHEN len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding]) THEN [CAST(x AS DOUBLE) FOR x IN embedding] END AS e FROM embeddings),
u AS (SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL),
links AS MATERIALIZED (SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT r AS x, r AS y FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
least AS (SELECT x AS r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = y GROUP BY x), many AS (SELECT x AS r, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN least USING (r) LEFT JOIN many USING (r)
"""


def _op13_sql() -> str:
    orders = ", ".join(f"('{o}', {step}, {1 << k}, {before})" for o, step, k, before in steps())
    flags = {"A": "len(words) < 50", "B": "100 * len(list_distinct(words)) < 65 * len(words)", "C": "100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t)", "D": "regexp_matches(t, '[#$%&*|]')", "E": "coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)"}
    bits = " + ".join(f"CASE WHEN {flags[f]} THEN {1 << k} ELSE 0 END" for k, f in enumerate(FILTERS))
    removed = "bits & before = 0 AND bits & own > 0"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words FROM documents),
marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
rows AS (SELECT part, {bits} AS bits, coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS bad FROM d LEFT JOIN marks USING (doc_id)),
per AS (SELECT part, bits, good, bad, count(*) AS n FROM rows GROUP BY ALL),
orders AS (SELECT * FROM (VALUES {orders}) AS o(filter_order, step, own, before)),
found AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE bits & (before | own) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE {removed}), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE bits & before > 0 AND bits & own > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE bits = own), 0) AS unique_fails,
  coalesce(sum(n) FILTER (WHERE {removed} AND good), 0) AS good_lost, coalesce(sum(n) FILTER (WHERE {removed} AND bad), 0) AS toxic_lost FROM per, orders GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))}, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM found
"""


ORACLES: dict[str, str] = {"op1_secret_scan": _op1_sql(), "op5_chat_format": OP5_SQL, "op7_mixing": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op12_embedding_dedup": OP12_SQL, "op13_filter_audit": _op13_sql()}
