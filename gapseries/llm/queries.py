"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapseries.llm import (chat, decontaminate, hard_negatives, langid, license_scan, mixing, prefix_trie, quality,
                           sharding, simhash, substring_dedup, token_store, topk)
from gapseries.llm.common import crc_of_id, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SHARDS = 40
WEIGHT_CYCLE = [5.0, 2.0, 1.0]
MAX_EPOCHS = 3
SEED = 42
QUALITY_FOLDS, LANGUAGE_FOLDS = 5, 4


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@register("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(crc_of_id("doc_id"), F.lit(LANGUAGE_FOLDS)) == 2
    langs, probs = langid.train(docs, ~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return langid.predict(rows, langs, probs, keep=["doc_id", "held_out"])


@register("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs, license_scan.LicenceModel(spark))


@register("op3_mix_sources", f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, ''))), 1, 13))::BIGINT AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (
  SELECT source, source_size, {MAX_EPOCHS} * source_size AS cap,
         CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
l AS (
  SELECT max(((SELECT sum(source_size) FROM w)
              - coalesce((SELECT sum(cap) FROM w b WHERE b.cap / b.weight < a.cap / a.weight), 0))::DOUBLE
             / (SELECT sum(weight) FROM w b WHERE b.cap / b.weight >= a.cap / a.weight)) AS level FROM w a),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * level) AS target FROM w, l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS extra,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN before + size / 2.0 <= extra THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix_sources(docs, lambda s: mixing.cyclic_weights(s, WEIGHT_CYCLE),
                               max_epochs=MAX_EPOCHS, seed=SEED, keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@register("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, keep=["doc_id"], seed=SEED)


@register("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(crc_of_id("doc_id"), F.lit(QUALITY_FOLDS)) == 0
    forest = quality.train(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return quality.score(rows, forest, keep=["doc_id", "held_out"])


def _key_sql(*parts: str) -> str:
    text = ", ".join([f"'{SEED}'", "coalesce(doc_id::VARCHAR, '')", *parts])
    return f"('0x' || substr(md5(concat_ws('|', {text})), 1, 13))::BIGINT"


def _shard_sql(shards: int) -> str:
    """The shard of least hash, as SQL over a list of shard numbers."""
    h = _key_sql("s::VARCHAR")
    return f"(list_min(list_transform(range({shards}), lambda s: {{'h': {h}, 's': s}}))).s::INTEGER"


# CRC-32 byte by byte; its table from the polynomial.
_CRC_TABLE_SQL = """list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n))"""
_CRC_SQL = """xor(4294967295, list_reduce(
  list_transform(regexp_extract_all(hex(t), '..'), lambda x: ('0x' || x)::BIGINT),
  lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"""


@register("op6_shard", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_CRC_TABLE_SQL} AS crc_table FROM documents),
r AS (SELECT strlen(t)::BIGINT + 16 AS size, CASE WHEN t = '' THEN 0 ELSE {_CRC_SQL} END AS text_crc32,
             {_shard_sql(SHARDS)} AS shard, {_shard_sql(SHARDS + 1)} AS grown_shard, {_key_sql()} AS h, doc_id
      FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY h, text_crc32, size) - 1 AS slot, grown_shard FROM r
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = {s: 1.0 for s in range(SHARDS)}
    return sharding.assign_shards(docs, weights, grown=weights | {SHARDS: 1.0}, seed=SEED, keep=["doc_id"])


@register("op7_decontaminate")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, read_table(spark, sf_dir, "benchmark"))


@register("op8_token_store")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_store.read_tokens(token_store.write_tokens(docs, tokenizer_path(), end_id=END_ID))


@register("op9_exact_top_k", """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


BUDGET, HISTORY = 2048, 512
SAID = r"\### Assistant: </turn> ok"
_ESCAPE_SQL = r"replace(replace(replace({x}, '\', '\\'), '</turn>', '\e'), '###', '\h')"


@register("op10_chat_windows", f"""
WITH RECURSIVE c AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations UNION ALL VALUES (-7, 0, 'user', '{SAID}'), (-7, 1, 'assistant', '{SAID}')),
t AS (
  SELECT conv_id, role, text,
         len(regexp_extract_all(text, '{chat.TOKEN_PATTERN}')) + {chat.TEMPLATE_TOKENS} AS tok,
         {len(chat.OPEN) + len(chat.SEP) + len(chat.CLOSE)} + length({_ESCAPE_SQL.format(x='text')})
           + length(replace({_ESCAPE_SQL.format(x='role')}, ':', '\\c')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM c),
b AS (
  SELECT *, sum(tok) OVER w - tok AS before,
         CASE WHEN first_value(role) OVER w = 'system' THEN 1 ELSE 0 END AS sys,
         greatest({BUDGET} - {HISTORY}
                  - CASE WHEN first_value(role) OVER w = 'system' THEN first_value(tok) OVER w ELSE 0 END, 1) AS room
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
p AS (
  SELECT conv_id, i, 0 AS win, tok AS used FROM b WHERE i = 0
  UNION ALL
  SELECT b.conv_id, b.i, CASE WHEN p.used + b.tok <= b.room THEN p.win ELSE p.win + 1 END,
         CASE WHEN p.used + b.tok <= b.room THEN p.used + b.tok ELSE b.tok END
  FROM p JOIN b ON p.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = p.i + 1),
s AS (
  SELECT p.conv_id, p.win, min(p.i) AS at, min(b.before) AS at_before
  FROM p JOIN b ON p.conv_id IS NOT DISTINCT FROM b.conv_id AND p.i = b.i GROUP BY ALL),
again AS (
  SELECT b.conv_id, sum(b.chars) AS chars FROM s JOIN b ON s.conv_id IS NOT DISTINCT FROM b.conv_id
  AND b.i < s.at AND (b.i < b.sys OR s.at_before - b.before <= {HISTORY}) GROUP BY b.conv_id),
said AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM b GROUP BY conv_id)
SELECT said.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       (said.chars + coalesce(again.chars, 0))::BIGINT AS formatted_chars
FROM said LEFT JOIN again ON said.conv_id IS NOT DISTINCT FROM again.conv_id
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit(SAID).alias("text"))
    windows = chat.format_windows(rows.unionByName(own), budget=BUDGET, history=HISTORY)
    return chat.read_back(windows)


@register("op11_hard_negatives", """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
         list_inner_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.v) = len(c.v)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER w AS place FROM s WHERE same
  WINDOW w AS (PARTITION BY anchor_id ORDER BY score DESC, vec_id)),
n AS (
  SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score,
         score AS negative_score
  FROM p JOIN s USING (anchor_id)
  WHERE place <= 5 AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
  WINDOW w AS (PARTITION BY anchor_id, place ORDER BY score DESC, vec_id))
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 5
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0, label=label)


@register("op12_substring_dedup", f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
k AS (
  SELECT doc_id, i, array_to_string(w[i:i + {substring_dedup.WINDOW - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substring_dedup.WINDOW - 2})) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS least FROM k GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {substring_dedup.WINDOW})) AS i
  FROM k JOIN f USING (s) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
left_over AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (doc_id)
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = substring_dedup.remove_repeats(docs, keep=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    return cleaned.select("doc_id", "n_words", removed.alias("n_removed"),
                          F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OPENINGS, OPENING_TURNS = 100, 6
_BYTES_SQL = _CRC_SQL.replace("hex(t)", "hex(id::VARCHAR)")


@register("op13_prefix_trie", f"""
WITH t AS (
  SELECT conv_id, role || chr(0) || text AS said, length(text) AS len,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        WHERE conv_id IS NOT NULL)),
c AS (
  SELECT id, id - id % {OPENINGS} AS base, {_BYTES_SQL} % {OPENING_TURNS} AS h
  FROM (SELECT DISTINCT conv_id AS id, {_CRC_TABLE_SQL} AS crc_table FROM t)),
r AS (
  SELECT id, pos AS place, said, len FROM c JOIN t ON conv_id = base AND pos <= h
  UNION ALL SELECT id, 100 + pos AS place, said, len FROM c JOIN t ON conv_id = id AND pos > h),
p AS (
  SELECT id, row_number() OVER w AS d, list(md5(said)) OVER w AS path, len FROM r
  WINDOW w AS (PARTITION BY id ORDER BY place)
  UNION ALL SELECT id, 0, [], 0 FROM c),
n AS (SELECT path, d, min(id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(len) AS own
      FROM p GROUP BY path, d),
e AS (SELECT path, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids
      FROM (SELECT id, max(d) AS d FROM p GROUP BY id) JOIN p USING (id, d) GROUP BY path),
k AS (SELECT path[:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT a.path, sum((x.n_children = 0)::INT) AS n_leaves, sum(x.own) AS saved
      FROM f a JOIN f x ON x.d >= a.d AND x.path[:a.d] = a.path GROUP BY a.path)
SELECT f.conv_id, f.d::BIGINT AS depth, o.conv_id AS parent_conv_id, f.n_convs, f.n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM f JOIN u USING (path) LEFT JOIN e USING (path) LEFT JOIN f o ON o.d = f.d - 1 AND o.path = f.path[:f.d - 1]
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv = F.col("conv")
    ids, turns = prefix_trie.with_shared_prefix(
        prefix_trie.turn_rows(rows), conv - conv % OPENINGS,
        F.crc32(conv.cast("string").cast("binary")) % OPENING_TURNS)
    return prefix_trie.prefix_trie(ids, turns)


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
