"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earlywarn.llm import decontaminate, hard_negatives, html_extract, line_dedup, lm_score, merkle, minhash, mixing, near_duplicates, quality, quotes, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, scorer)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured_verdicts(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_bad")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(_table(spark, sf_dir, "conversations"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    gone = line_dedup.later_lines(docs)
    lines = docs.select("doc_id", F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    joined = lines.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("id")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents")).drop("source")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_decontaminate": op2_decontaminate,
    "op3_toxicity": op3_toxicity,
    "op4_html_extract": op4_html_extract,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc": op6_warc,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_mix": op8_mix,
    "op9_quotation_linking": op9_quotation_linking,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_minhash_dedup": op13_minhash_dedup,
    "pipeline": pipeline,
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP2_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK_WORDS = r"[^\x20\x09-\x0D]+"



def _classes_sql(words: int, percent: int) -> str:
    """One row a document: shingles, and the smallest id that links of so many percent reach."""
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_BLANK_WORDS}') AS w FROM documents),
p AS (SELECT r, w, least({words}, len(w)) AS k, unnest(range(1, len(w) - least({words}, len(w)) + 2)) AS i FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i : i + k - 1], ' ') AS g FROM p),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n AS nx ON nx.r = x JOIN n AS ny ON ny.r = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT r AS a, r AS b FROM n UNION SELECT a, y FROM reach JOIN e ON b = x),
f AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN d ON d.r = b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n.r IS NULL THEN doc_id ELSE component_id END AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN f ON f.a = d.r"""


def _tree_sql(name: str, nodes: str, levels: int) -> str:
    """CTEs ``{name}0`` ... of a ternary tree's levels over nodes (t, p, h), and ``{name}w``: for each leaf what precedes and follows it on every level, and its root."""
    out = [f"{name}0 AS MATERIALIZED (SELECT t, p, h, count(*) OVER (PARTITION BY t) AS c FROM {nodes})"]
    for k in range(levels):
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT t, p // 3 AS p, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h, (any_value(c) + 2) // 3 AS c FROM {name}{k} GROUP BY t, p // 3)")
        around = "OVER (PARTITION BY t, p // 3 ORDER BY p ROWS BETWEEN"
        out.append(f"{name}w{k} AS MATERIALIZED (SELECT t, p, c > 1 AS up, coalesce(string_agg(h, '') {around} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, coalesce(string_agg(h, '') {around} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS suf FROM {name}{k})")
    columns = ", ".join(f"w{k}.up AS up{k}, w{k}.pre AS pre{k}, w{k}.suf AS suf{k}" for k in range(levels))
    joins = " ".join(f"JOIN {name}w{k} AS w{k} ON w{k}.t = l.t AND w{k}.p = l.p // {3**k}" for k in range(levels))
    siblings = " || ".join(f"pre{k} || suf{k}" for k in range(levels))
    out.append(f"{name}w AS MATERIALIZED (SELECT *, {siblings} AS others FROM (SELECT l.t, l.p, l.h, r.h AS root, {columns} FROM {name}0 AS l JOIN {name}{levels} AS r ON r.t = l.t {joins}))")
    return ",\n".join(out)


def _fold_sql(column: str, table: str, levels: int) -> str:
    for k in range(levels):
        column = f"(SELECT CASE WHEN {table}.up{k} THEN sha256({table}.pre{k} || x || {table}.suf{k}) ELSE x END FROM (SELECT {column} AS x))"
    return column


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_BITS = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda i: CAST((ascii(c) >> CAST(i AS INTEGER)) & 1 AS BIGINT))))"
_CRC32 = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {_BITS}), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
#: Levels of the trees of rows and of sources: up to 3**11 rows a source, 3**6 sources.
_ROWS, _SOURCES = 11, 6
_MERKLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT *, coalesce('=' || source, '') AS t, {_LEAF.format(text="text")} AS leaf,
CASE WHEN doc_id IS NOT NULL AND {_CRC32} % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text="text")} END AS given FROM documents),
x AS MATERIALIZED (SELECT t, doc_id, leaf, given, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS h FROM d),
{_tree_sql("a", "x", _ROWS)},
s AS (SELECT 'all' AS t, row_number() OVER (ORDER BY t) - 1 AS p, h, t AS name FROM a{_ROWS}),
{_tree_sql("b", "s", _SOURCES)},
o AS MATERIALIZED (SELECT s.name, bw.* FROM s JOIN bw USING (p)),
f AS MATERIALIZED (SELECT x.*, aw.root AS subroot, aw.others, {_fold_sql("x.given", "aw", _ROWS)} AS folded FROM x JOIN aw ON aw.t = x.t AND aw.p = x.p)
SELECT doc_id, leaf, subroot, o.root, sha256(f.others || o.others) AS proof_sha256, {_fold_sql("f.folded", "o", _SOURCES)} AS folded_root, {_fold_sql("f.folded", "o", _SOURCES)} = o.root AS verified
FROM f JOIN o ON o.name = f.t"""

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, {_OP2_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_OP2_WORDS} AS w FROM benchmark),
bw AS (SELECT item, least(10, len(w)) AS k, unnest(list_transform(range(len(w) - least(10, len(w)) + 1), lambda i: array_to_string(w[i + 1 : i + least(10, len(w))], ' '))) AS g FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(len(w) - k + 1)) AS i, w FROM d, ks WHERE len(w) >= k),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw ON bw.k = dw.k AND bw.g = array_to_string(dw.w[dw.i + 1 : dw.i + dw.k], ' ')),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), o AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS owner FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN strlen(h) >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN strlen(h) >= 1000 AND page_id <> owner THEN owner END AS refers_to FROM o""",
    "op5_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_BLANK_WORDS}') AS w FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
m AS (SELECT doc_id, source, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_BLANK_WORDS}')) AS l, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (r)),
c AS (SELECT *, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines FROM m),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines AS wide,
10 * n_symbols > n_words OR 5 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS narrow FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR wide OR narrow) AS k FROM f GROUP BY source),
s AS (SELECT sum(k) / sum(n) AS m, var_pop(k / n) AS v, avg(1 / n) AS o FROM h),
b AS (SELECT m, CASE WHEN v > m * (1 - m) * o THEN greatest(1, least(10000, m * (1 - m) / (v - m * (1 - m) * o) - 1)) ELSE 10000 END AS strength FROM s),
v AS (SELECT source, (k + m * strength) / (n + strength) >= 0.5 AS host_bad FROM h, b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT wide AND NOT (narrow AND host_bad) AS kept, host_bad
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source""",
    "op7_near_duplicates": _classes_sql(5, 75),
    "op11_merkle_manifest": _MERKLE_SQL,
    "op12_hard_negatives": """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v AS a, v AS b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op13_minhash_dedup": f"SELECT *, doc_id = component_id AS kept FROM ({_classes_sql(2, 80)})",
}
