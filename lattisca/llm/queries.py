"""The registered queries of the operators, each over its whole table, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattisca.llm.common import table


def op1_toxicity(spark, sf_dir):
    from lattisca.llm.toxicity import held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tagged = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return tagged.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("spans").cast("bigint").alias("n_toxic_tokens"), "spans")


def op2_sharding(spark, sf_dir):
    from lattisca.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    from lattisca.llm.linededup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"), "text")


def op3_decontamination(spark, sf_dir):
    from lattisca.llm.decontam import find_phrases, report

    return report(find_phrases(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))).drop("spans")


def op4_chat_formatting(spark, sf_dir):
    from lattisca.llm.chat import format_chats

    hard = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    return format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op7_sentencepiece(spark, sf_dir):
    from lattisca.llm.pieces import encode_table

    out = encode_table(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", "scores", F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"), "ids_sha256", "ids", "others")


def op8_nearest_neighbours(spark, sf_dir):
    from lattisca.llm.ann import search_table

    return search_table(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark, sf_dir):
    from lattisca.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_language_model(spark, sf_dir):
    from lattisca.llm.ngram import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    from lattisca.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sharding, op3_decontamination, op4_chat_formatting, op5_simhash, op6_line_dedup, op7_sentencepiece, op8_nearest_neighbours, op9_language_model, op10_substring_dedup)}

ORACLES = {
    "op2_sharding": """
WITH RECURSIVE crc AS (SELECT [list_reduce(list_prepend(i, [k::BIGINT for k in range(8)]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) for i in range(256)] AS t),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 8192)::INTEGER AS vs FROM documents),
s AS (SELECT doc_id, vs, octet_length(raw)::BIGINT + 1 AS size,
             xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(raw), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32 FROM d, crc),
w AS (SELECT slot::INTEGER AS slot, greatest(coalesce(sum(size), 0), 1)::BIGINT AS b, count(size)::BIGINT AS k FROM range(8192) r(slot) LEFT JOIN s ON vs = slot GROUP BY slot),
o AS (SELECT slot, b, row_number() OVER (ORDER BY b DESC, slot) AS n FROM w),
deal(n, loads, slot, shard) AS (
  SELECT 0::BIGINT, [0::BIGINT for i in range(16)], NULL::INTEGER, NULL::INTEGER
  UNION ALL
  SELECT o.n, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + o.b ELSE x END), o.slot, (list_position(loads, list_min(loads)) - 1)::INTEGER
  FROM deal JOIN o ON o.n = deal.n + 1),
m AS (SELECT w.slot, shard, coalesce(sum(k) OVER (PARTITION BY shard ORDER BY w.slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM w JOIN deal USING (slot))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (first + row_number() OVER (PARTITION BY vs ORDER BY doc_id, text_crc32, size) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard, vs AS virtual_slot, 1 AS map_version
FROM s JOIN m ON vs = m.slot
""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, p, array_to_string(ws[p:p + 49], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d WHERE len(ws) >= 50)),
m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM w JOIN m USING (s) WHERE low < doc_id),
l AS (SELECT doc_id, list(q) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE [ws[i] for i in range(1, len(ws) + 1) if NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
""",
    "op8_nearest_neighbours": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op4_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
p AS (SELECT *, 15 + length(regexp_replace(role, '([\\#<:\n])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, hex(role), sha256(text))) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, hex(role), sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
""",
    "op3_decontamination": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
ph AS (SELECT DISTINCT item, least(len(ws), 13) AS n, array_to_string(ws[p:p + least(len(ws), 13) - 1], ' ') AS s
       FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS p FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS s
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM ph) WHERE len(ws) >= n)),
h AS (SELECT doc_id, p, n, item FROM dw JOIN ph USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
""",
    "op6_line_dedup": """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ls) - 1)) AS p, ls FROM l WHERE len(ls) >= 3),
k AS (SELECT doc_id, p, ls[p] || chr(10) || ls[p + 1] || chr(10) || ls[p + 2] AS w FROM w),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS n FROM k),
gone AS (SELECT doc_id, list(DISTINCT q) AS g FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r WHERE n > 1) GROUP BY doc_id)
SELECT l.doc_id, len(ls)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(t) AS text_sha256, t AS text FROM (
  SELECT l.doc_id, ls, g, CASE WHEN g IS NULL THEN text ELSE array_to_string([ls[i] for i in range(1, len(ls) + 1) if NOT list_contains(g, i)], chr(10)) END AS t
  FROM l LEFT JOIN gone USING (doc_id)) l
""",
}
