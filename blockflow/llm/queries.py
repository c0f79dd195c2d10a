"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontam, divergence, html_extract, packing, quality_cnn, quality_rules, secrets, shard, simhash, toxicity, warc
from .common import new_folder, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _held_out(divisor: int, rest: int):
    """A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor == rest


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.scores(docs, _table(spark, sf_dir, "labels"), ~_held_out(3, 1))
    return rows.select("doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *secrets.digest(F.col("spans")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    # Parsed once: responses and revisits are both read from the narrow rows.
    rows = written(warc.reassembled(warc.read_records(spark, path)).drop("payload", "target"), "warc-records")
    whole = F.when(F.col("complete"), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a record is incomplete")).cast("long"))
    return warc.resolved(rows).select("page_id", whole.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM g
"""


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM n),
ks AS (SELECT DISTINCT k FROM n),
dw AS (SELECT doc_id, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i, unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, ks WHERE len(w) >= k),
h AS (SELECT doc_id, item_id, dw.k AS k, i FROM dw JOIN iw ON dw.s = iw.s AND dw.k = iw.k),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_extract.extracted(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality_cnn.scores(docs, _table(spark, sf_dir, "labels"), ~_held_out(5, 0))
    return rows.select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard.shards(_table(spark, sf_dir, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> list[int]:
    """The 256 steps of CRC-32 by its polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


OP8_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, octet_length(encode(t)) + 1 AS size, list_transform(range(0, CAST(octet_length(encode(t)) AS BIGINT)), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)) AS bytes FROM t),
s AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(bytes, lambda a, y: xor(a >> 8, {_crc_table()}[(xor(a, y) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM b),
o AS (SELECT *, CAST(sum(size) OVER w AS BIGINT) AS run, row_number() OVER w AS nth, CAST(sum(size) OVER () AS BIGINT) AS total FROM s WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, CAST((2 * run - size) * 16 // (2 * total) AS INT) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, nth - min(nth) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""


def op9_bpe(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, digest=True).drop("text")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies are applied to the stored ledger."""
    rows = quality_rules.stored(_table(spark, sf_dir, "documents"))
    versions = [(~quality_rules.failed(v)).alias(f"kept_{v}") for v in ("v1", "v3")]
    return quality_rules.apply_policy(rows, "v2").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.failed("base").alias("base_failed"), "kept", *versions, "fail_bits")


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v2 adds, from the stored ledger."""
    return quality_rules.ablation(quality_rules.stored(_table(spark, sf_dir, "documents")), "v2")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, CAST(len(w) - 1 AS BIGINT))) AS i, unnest(list_transform(range(1, CAST(len(w) - 1 AS BIGINT)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM d WHERE len(w) > 2),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words, length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) AS n_upper
  FROM d JOIN l USING (doc_id) LEFT JOIN rw USING (doc_id)),
f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_upper > 40 * word_chars THEN 8 ELSE 0 END)
  + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)
  + (CASE WHEN word_chars > 14 * n_words THEN 64 ELSE 0 END) + (CASE WHEN n_words >= 50 AND 100 * n_repeat_words > 50 * n_words THEN 128 ELSE 0 END) + (CASE WHEN n_words = 0 THEN 256 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits & 127 = 0 AS kept, fail_bits & 23 = 0 AS kept_v1, fail_bits & 492 = 0 AS kept_v3, fail_bits FROM f
"""
ABLATION_SQL = f"""SELECT r.rule, n_rows, any_bits, count(*) FILTER (WHERE fail_bits & 127 & b <> 0) AS n_failed, count(*) FILTER (WHERE fail_bits & 127 = b) AS n_only
FROM ({OP10_SQL}) o, (SELECT count(*) AS n_rows, bit_or(fail_bits & 127) AS any_bits FROM ({OP10_SQL})), (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('upper_case', 8), ('repeated_lines', 16), ('short_words', 32), ('long_words', 64)) r(rule, b) GROUP BY ALL"""



def op11_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(_table(spark, sf_dir, "documents"), path, end_id=2)
    length = (F.octet_length("ids") / 4).cast("long")
    return rows.select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT i, lang, source, unnest(w) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY ALL),
z AS (SELECT g.lang, g.source, v.term, coalesce(n, 0) AS n FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
p AS MATERIALIZED (SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS BIGINT) AS p FROM z WINDOW w AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS BIGINT) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) WINDOW w AS (PARTITION BY lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 50
"""


def op13_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centres = centroids.clusters(_table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(found, centres).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _lloyd_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The definition: every round scans all centroids. centres are one row with a list of lists."""
    square = lambda c: f"list_sum(list_transform(list_zip(v, {c}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"""e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT list(v ORDER BY h, v) AS cs FROM (SELECT v, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM e ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, list_position(d, list_min(d)) AS j, list_min(d) AS m FROM (SELECT vec_id, v, list_transform(cs, lambda c: {square('c')}) AS d FROM e, c{r}))")
        if r < rounds:
            parts.append(f"u{r} AS (SELECT j, i, (s - ((s % n) + n) % n) // n AS x FROM (SELECT j, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY j, i))")
            parts.append(f"n{r} AS (SELECT j, list(x ORDER BY i) AS c FROM u{r} GROUP BY j)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT list(coalesce(n{r}.c, o.c) ORDER BY o.j) AS cs FROM (SELECT unnest(cs) AS c, generate_subscripts(cs, 1) AS j FROM c{r}) o LEFT JOIN n{r} USING (j))")
    last = f"a{rounds}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(j - 1 AS INT) AS cluster, CAST(m AS BIGINT) AS distance, CAST(sum(m) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(m) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(cs[j], ',')) AS centroid_sha256 FROM {last}, c{rounds}"""


OP13_SQL = _lloyd_sql()

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_secrets": op3_secrets,
    "op4_warc": op4_warc,
    "op5_winnowing": op5_winnowing,
    "op6_html": op6_html,
    "op7_quality_cnn": op7_quality_cnn,
    "op8_sharding": op8_sharding,
    "op9_bpe": op9_bpe,
    "op10_quality_rules": op10_quality_rules,
    "op11_packing": op11_packing,
    "op12_divergence": op12_divergence,
    "op13_exponion": op13_exponion,
    "rules_ablation": rules_ablation,
}
ORACLE_SQL = {"op4_warc": OP4_SQL, "op5_winnowing": OP5_SQL, "op8_sharding": OP8_SQL, "op10_quality_rules": OP10_SQL, "op12_divergence": OP12_SQL, "op13_exponion": OP13_SQL, "rules_ablation": ABLATION_SQL}
