"""The registered queries: each operator over its whole table, with the DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import chat, classifier, decontaminate, line_dedup, mixing, negatives, quality, sharding, simhash, substring_dedup, suffix_dedup, tokens, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(given.unionByName(planted))
    made = made.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("segments")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return classifier.score(docs, classifier.fit(docs, _table(spark, sf_dir, "labels")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "source", "lang", "topic", "tokens", "weight", "probability", "sampled")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.groups(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select(F.col("row.vec_id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.place(_table(spark, sf_dir, "documents"), SHARDS, carry=("doc_id",))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


SHARDS = 40

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_compression_bands,
        op2_token_counts,
        op3_line_dedup,
        op4_chat_format,
        op5_quality_classifier,
        op6_substring_dedup,
        op7_mixing,
        op8_simhash,
        op9_suffix_dedup,
        op10_decontaminate,
        op11_whitening,
        op12_hard_negatives,
        op13_sharding,
    )
}

_ESCAPED = "replace(replace(replace(replace({}, '\\', '\\e'), '<', '\\l'), '[', '\\b'), ']', '\\r')"


def _shard_twin(shards: int = SHARDS) -> str:
    """The permutation with the same keys, one subquery per half round; the walk is a recursive table."""
    p = sharding.PRIME
    start = "(CASE WHEN p < 0 THEN num ELSE p END)"
    once = f"SELECT num, n, a, b, {start} % a AS x, {start} // a AS y FROM walk WHERE p < 0 OR p >= n"
    mixed = lambda v, k: f"(((({v} + {k}) % {p}) * (({v} + {k}) % {p}) + {k}) % {p})"
    square = lambda t: f"({t} * {t} % {p})"
    for k, m in sharding.Feistel(1).keys:
        once = f"SELECT num, n, a, b, (x + {square(mixed('y', k))}) % a AS x, y FROM ({once})"
        once = f"SELECT num, n, a, b, x, (y + {square(mixed('x', m))}) % b AS y FROM ({once})"
    return f"""
WITH RECURSIVE poly AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i)),
crc AS (SELECT list(v ORDER BY i) AS vs FROM poly),
d AS (SELECT doc_id, text, (coalesce(strlen(text), 0) + {sharding.OVERHEAD})::BIGINT AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
    lambda h: ((instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1)::BIGINT) AS bs FROM documents),
e AS (SELECT doc_id, size, text, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, x: xor(c >> 8, vs[xor(c, x) % 256 + 1])), 4294967295) AS text_crc32 FROM d, crc),
f AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(text) NULLS FIRST) - 1 AS num, count(*) OVER () AS n FROM e),
walk AS (SELECT num, n, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b, -1::BIGINT AS p FROM f
  UNION ALL SELECT num, n, a, b, y * a + x AS p FROM ({once}))
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {shards})::INTEGER AS shard, (p // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM f JOIN (SELECT num, p FROM walk WHERE p >= 0 AND p < n) w USING (num)"""


ORACLES: dict[str, str] = {
    "op12_hard_negatives": """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op13_sharding": _shard_twin(),
    "op3_line_dedup": """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
f AS (SELECT doc_id, ls, generate_subscripts(ls, 1) AS i FROM l),
r AS (SELECT doc_id, i, ls[i] AS x, lead(ls[i], 1) OVER w AS y, lead(ls[i], 2) OVER w AS z FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, i) AS k FROM r WHERE y IS NOT NULL AND z IS NOT NULL),
d AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM n WHERE k > 1)
SELECT l.doc_id, len(ls)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed_lines,
  sha256(CASE WHEN g.n IS NULL THEN array_to_string(ls, chr(10)) ELSE coalesce(g.kept, '') END) AS kept_sha256
FROM l LEFT JOIN (
  SELECT f.doc_id, count(d.i) AS n, string_agg(ls[f.i], chr(10) ORDER BY f.i) FILTER (WHERE d.i IS NULL) AS kept
  FROM f LEFT JOIN d ON d.doc_id = f.doc_id AND d.i = f.i WHERE f.doc_id IN (SELECT doc_id FROM d) GROUP BY f.doc_id
) g ON g.doc_id = l.doc_id""",
    "op4_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(8 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})))::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' ELSE false END) AND bool_or(back = 1 AND role IN ('assistant', 'user')) AS valid
FROM r GROUP BY conv_id""",
    "op6_substring_dedup": """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) > 34)),
r AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY h) > 1),
c AS (SELECT DISTINCT doc_id, i + unnest(range(35)) AS p FROM r),
a AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE doc_id IN (SELECT doc_id FROM r)),
g AS (SELECT a.doc_id, count(c.p) AS n, string_agg(ws[a.p], ' ' ORDER BY a.p) FILTER (WHERE c.p IS NULL) AS kept
  FROM a LEFT JOIN c ON c.doc_id = a.doc_id AND c.p = a.p GROUP BY a.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN g.n IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(g.kept, '') END) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id""",
    "op9_suffix_dedup": """
WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
b AS (SELECT doc_id, k, substr(hx, k * 2000 + 1, 2098) AS part FROM (SELECT doc_id, hx, unnest(range(0, (len(hx) + 1999) // 2000)) AS k FROM w)),
s AS (SELECT doc_id, k * 1000 + j + 1 AS i, md5(substr(part, 2 * j + 1, 100)) AS h
  FROM (SELECT doc_id, k, part, unnest(range(0, least(1000, len(part) // 2 - 49))) AS j FROM b WHERE len(part) >= 100)),
r AS (SELECT doc_id, i FROM s QUALIFY doc_id > min(doc_id) OVER (PARTITION BY h)),
c AS (SELECT DISTINCT doc_id, i + unnest(range(50)) AS p FROM r),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (before IS NULL OR before < p - 1) AS spans
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM c) GROUP BY doc_id),
a AS (SELECT doc_id, k * 1000 + j + 1 AS p, substr(part, 2 * j + 1, 2) AS byte
  FROM (SELECT doc_id, k, part, unnest(range(0, least(1000, len(part) // 2))) AS j FROM b WHERE doc_id IN (SELECT doc_id FROM t))),
k AS (SELECT a.doc_id, string_agg(byte, '' ORDER BY a.p) AS kept FROM a ANTI JOIN c ON c.doc_id = a.doc_id AND c.p = a.p GROUP BY a.doc_id)
SELECT w.doc_id, (len(hx) // 2)::BIGINT AS n_bytes, coalesce(t.n, 0)::BIGINT AS n_removed, coalesce(t.spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN t.n IS NULL THEN hx ELSE coalesce(k.kept, '') END)) AS kept_sha256
FROM w LEFT JOIN t ON t.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id""",
    "op10_decontaminate": """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + 9], ' ') AS x
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
s AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS x
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM g) WHERE len(ws) >= k)),
h AS (SELECT s.doc_id, s.i, g.k, g.item_id FROM s JOIN g ON g.x = s.x AND g.k = s.k),
p AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS i FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, p.n IS NOT NULL AS contaminated
FROM w LEFT JOIN p ON p.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id""",
}
