"""The queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bpe, chat, fingerprints, html_extract, mixing, quality, sharding, simhash, spelling, toxicity, warc
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    return chat.read_back(turns.unionByName(own), public_tokenizers.path("byte_bpe_50k.json"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(table(spark, sf_dir, "pages"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


#: The other operators are beyond SQL (XXH64, trained models, tree search, HTML and BPE rules); tests hold them against plain versions.
_OP4_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(text) + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE[=\]]'))
        + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 4 ELSE 21 END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

_OP10_SQL = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix ' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
w AS (SELECT *, CAST(CASE (no - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, CAST(2 AS DOUBLE) * source_size AS cap FROM r),
f AS (SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, no, source_size, CASE WHEN level * weight >= cap THEN cap ELSE max(CASE WHEN level * weight < cap THEN level END) OVER () * weight END AS target FROM f),
c AS (SELECT doc_id, size, no, source_size, target, CAST(sum(size) OVER (PARTITION BY no ORDER BY h, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT no, size, upto, (upto + lap * source_size) / target AS finish FROM c, (VALUES (0), (1)) l(lap) WHERE size > 0 AND target > 0),
a AS (SELECT finish, sum(size) OVER (ORDER BY finish, no, upto ROWS UNBOUNDED PRECEDING) AS every FROM q),
z AS (SELECT coalesce(max(finish), -1) AS last FROM a WHERE every <= (SELECT sum(target) FROM t) + 0.5)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
    CAST(CASE WHEN size > 0 AND target > 0 THEN size * (CAST(upto / target <= last AS INT) + CAST((upto + source_size) / target <= last AS INT)) ELSE 0 END AS BIGINT) AS taken
FROM c, z
"""

_OP11_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS latest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN latest IS NOT NULL AND page_id IS DISTINCT FROM latest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM latest THEN latest END AS refers_to
FROM r
"""

_OP12_SQL = r"""
WITH RECURSIVE nibbles AS (  -- the sixteen steps of CRC-32
    SELECT list(list_reduce(range(4), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS step FROM (SELECT unnest(range(16)) AS i)),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents) GROUP BY ALL),
digits AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs),
crc AS (SELECT run, n, xor(list_reduce(
        list_transform(range(len(h)), lambda k: CAST(strpos('0123456789ABCDEF', substr(h, k + 1 + CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END, 1)) - 1 AS BIGINT)),
        lambda c, x: xor(step[(xor(c, x) & 15) + 1], c >> 4), 4294967295), 4294967295) AS h FROM digits, nibbles),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM crc)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS MATERIALIZED (SELECT word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM w)),
i AS (SELECT DISTINCT d.word AS a, d.n AS a_n, w.word AS b, w.n AS b_n FROM d JOIN w ON d.rest = w.word),
near AS (SELECT x.word, y.word AS other, y.n AS other_n FROM d x JOIN d y ON x.rest = y.rest AND x.place = y.place AND x.word <> y.word
    UNION ALL SELECT a, b, b_n FROM i UNION ALL SELECT b, a, a_n FROM i),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
f AS MATERIALIZED (SELECT word, CASE WHEN other_n >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
    FROM w LEFT JOIN best USING (word)),
r AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.next = f.word)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON f.word = r.word AND r.next IS NULL
"""

_OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
        CAST(len(words) < 50 AS INT)
        + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT)
        + 4 * CAST(100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) AS INT)
        + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
        + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INT) AS mask
    FROM t LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM d GROUP BY part, mask),
f AS (SELECT substr('ABCDE', bit + 1, 1) AS name, 1 << bit AS b FROM (SELECT CAST(unnest(range(5)) AS INT) AS bit)),
o AS (SELECT v.name || w.name || x.name || y.name || z.name AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
    FROM f v, f w, f x, f y, f z WHERE v.b + w.b + x.b + y.b + z.b = 31 AND len(list_distinct([v.b, w.b, x.b, y.b, z.b])) = 5),
s AS (SELECT filter_order, step, bits[step] AS b, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
a AS (SELECT part, filter_order, step, b,
        sum(n) FILTER (mask & (before + b) = 0) AS kept,
        sum(n) FILTER (mask & b > 0 AND mask & before = 0) AS removed,
        sum(n) FILTER (mask & b > 0 AND mask & before > 0) AS redundant,
        sum(n) FILTER (mask = b) AS unique_fails,
        sum(good) FILTER (mask & b > 0 AND mask & before = 0) AS good_lost,
        sum(bad) FILTER (mask & b > 0 AND mask & before = 0) AS toxic_lost
    FROM c, s GROUP BY part, filter_order, step, b)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
    CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
    CAST(coalesce(sum(removed) OVER (PARTITION BY part, b), 0) AS BIGINT) AS shapley
FROM a
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": _OP4_SQL, "op10_source_mixing": _OP10_SQL, "op11_warc_archives": _OP11_SQL, "op12_spelling_variants": _OP12_SQL, "op13_filter_audit": _OP13_SQL}
