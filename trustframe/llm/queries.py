"""The registered queries of this subpackage, over whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.llm import bitplanes, class_lm, impact_search, language, mixing, near_join, order_minhash, packing, repair, secrets, simhash, warc, whitening
from trustframe.llm.common import tokenizer_path
from trustframe.operators.storage import settle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as the text null."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), F.lit(n))


def archive(pages: DataFrame) -> DataFrame:
    """Captures of the pages: each page's full response, and a later not-modified revisit of its URL in another spelling.

    Pages have no times or headers, so both follow from page_id: every fifth revisit has another entity tag, every seventh
    none, every seventh response no date.
    """
    p = F.col("page_id")
    tag, date = F.substring(F.md5("html"), 1, 16), F.concat(F.lit("day "), F.col("page_id") % 11)
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    pack = lambda *e: F.map_from_entries(F.filter(F.array(*e), lambda x: x["value"].isNotNull()))
    full = pack(
        entry("ETag", tag), entry("Last-Modified", F.when(p % 7 != 3, date)), entry("Content-Type", F.lit("text/html")),
        entry("Content-Length", F.length("html").cast("string")), entry("Cache-Control", F.lit("max-age=60")),
    )
    again = pack(
        entry("etag", F.when(p % 7 == 2, None).when(p % 5 == 4, F.lit("changed")).otherwise(F.concat(F.lit("W/"), tag))),
        entry("last-modified", F.when(p % 3 != 1, date)), entry("content-length", F.lit("0")),
        entry("cache-control", F.concat(F.lit("max-age="), p % 100)), entry("date", F.concat(F.lit("t"), p)),
    )
    first = pages.select(
        (p * 2).alias("record_id"), "url", (p * 7919 % 1009).alias("ts"), F.lit(200).alias("status"), full.alias("headers"), F.md5("html").alias("digest"),
    )
    later = pages.select(
        (p * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^https?:", "HTTP:"), F.lit("#r")).alias("url"), (p * 104729 % 1009 + 200).alias("ts"),
        F.lit(304).alias("status"), again.alias("headers"), F.lit(None).cast("string").alias("digest"),
    )
    return first.unionByName(later)


OP1 = r"""
WITH p AS (SELECT page_id AS p, url, html, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages),
u AS (SELECT *, '^(?i:https?)://([^/?]*)([^?]*)(?:\?(.*))?$' AS pat FROM p),
c AS (SELECT *, CASE WHEN regexp_matches(bare, pat) THEN
    regexp_replace(lower(regexp_extract(bare, pat, 1)), CASE WHEN regexp_matches(bare, '^(?i:https):') THEN ':443$' ELSE ':80$' END, '') || regexp_replace(regexp_extract(bare, pat, 2), '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_filter(list_sort(string_split(regexp_extract(bare, pat, 3), '&')),
       lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid)(=|$)')), '&'), ''), '') ELSE bare END AS canonical_url FROM u),
full_ AS (SELECT canonical_url, p * 2 AS id, p * 7919 % 1009 AS ts, substr(md5(html), 1, 16) AS tag, CASE WHEN p % 7 <> 3 THEN 'day ' || (p % 11) END AS day,
  length(html) AS size, md5(html) AS digest FROM c),
again AS (SELECT canonical_url, p * 2 + 1 AS id, p * 104729 % 1009 + 200 AS ts, p,
  CASE WHEN p % 7 = 2 THEN NULL WHEN p % 5 = 4 THEN 'changed' ELSE substr(md5(html), 1, 16) END AS tag,
  CASE WHEN p % 3 <> 1 THEN 'day ' || (p % 11) END AS day FROM c),
j AS (SELECT a.*, max({'ts': f.ts, 'id': f.id}) AS hit FROM again a LEFT JOIN full_ f ON f.canonical_url = a.canonical_url AND (f.ts, f.id) < (a.ts, a.id)
  GROUP BY ALL),
k AS (SELECT j.*, f.id AS fid, f.digest, f.size, f.tag AS ftag, f.day AS fday,
  CASE WHEN j.tag IS NOT NULL AND f.tag IS NOT NULL THEN j.tag = f.tag ELSE j.day = f.day END AS same
  FROM j LEFT JOIN full_ f ON f.id = j.hit.id),
o AS (SELECT *, CASE WHEN fid IS NULL THEN 'no_response' WHEN same IS NULL THEN 'unverified' WHEN same THEN 'resolved' ELSE 'mismatch' END AS outcome FROM k)
SELECT id AS record_id, canonical_url, outcome, CASE WHEN outcome = 'resolved' THEN fid END AS response_id,
  CASE WHEN outcome = 'resolved' THEN digest END AS response_digest,
  CASE WHEN outcome = 'resolved' THEN array_to_string(list_filter([
    'cache-control=max-age=' || (p % 100), 'content-length=' || size, 'content-type=text/html', 'date=t' || p, 'etag=' || ftag,
    'last-modified=' || coalesce(day, fday)], lambda x: x IS NOT NULL), ';') END AS headers FROM o
"""


@query(OP1)
def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of all pages, resolved; the merged headers written name=value by name."""
    found = warc.resolve_revisits(archive(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.withColumn("headers", F.array_join(lines, ";"))


OP2 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{0080}-\x{10FFFF}]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
z AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM z a JOIN z b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
e AS MATERIALIZED (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS low FROM r GROUP BY x),
l AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT d.doc_id, least(d.doc_id, coalesce(m.low, d.doc_id)) AS class_id, coalesce(l.n, 0) AS n_links
FROM documents d LEFT JOIN m ON m.x = d.doc_id LEFT JOIN l ON l.x = d.doc_id
"""


@query(OP2)
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


@query()
def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query()
def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder(7) == 2)
    return class_lm.class_scores(docs.where(~F.col("held_out")), docs, ["doc_id", "held_out"])


OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query(OP5)
def op5_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", impact_search.quantised(F.col("embedding")).alias("vector"))
    return impact_search.top_products(vectors, vectors.where("vec_id % 50 = 0"), 5)


@query()
def op6_byte_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder(4) == 2)
    tagger = language.fit_tagger(docs.where(~F.col("held_out")))
    return language.identify(docs, tagger, ["doc_id", "held_out"]).select("row.*", "lang_pred", "score")


@query()
def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_documents(table(spark, sf_dir, "documents"))


@query()
def op8_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = bitplanes.write_planes(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return bitplanes.read_planes(files)


@query()
def op9_novel_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


OP10 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(most, coalesce(max(level) FILTER (WHERE level * weight < most) OVER () * weight, most)) AS target FROM l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  CAST('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS unit
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
  (size * (floor(rate) + CASE WHEN unit < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM j
"""


@query(OP10)
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = (F.col("size") * F.col("copies")).cast("long")
    return mixing.mix_counts(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return whitening.whiten(rows.select("vec_id", whitening.scaled(F.col("embedding")).alias("x")))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with the faults of the contract: rows dropped, emptied, cut, repeated, given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    bare = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), bare.alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


@query()
def op12_checkpointed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    faults, edits = repair.repair(damaged(rows))
    found = repair.joined(repair.joined(rows.select("conv_id").distinct(), settle(faults, "faults")), settle(repair.digests(edits), "digests"))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query()
def op13_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))
