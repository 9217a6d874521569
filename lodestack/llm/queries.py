"""The registered queries of the training-data operators: thin digests over the operators' own outputs."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import jaccard, langid, licenses, linededup, mixing, mtree, nndescent, orc_store, packing, resample, runs, sharding, urlfilter
from lodestack.llm.common import scratch
from lodestack.runtime import ship, table

SQL: dict[str, str] = {}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(ship(spark), sf_dir, "embeddings")
    return mtree.top_k(rows, is_query=F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


SQL["op2_mtree_topk"] = """
WITH parts AS (
  SELECT vec_id, u.i, floor(1024 * embedding[u.i]::DOUBLE)::BIGINT AS x
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return jaccard.jaccard_classes(docs, words=5, threshold=0.75)


def op4_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    path = scratch(spark, "tokens")
    orc_store.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return orc_store.digest_tokens(orc_store.read_tokens(spark, path))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linededup.line_dedup(docs, min_sites=5).select("doc_id", "text", "n_lines", "n_removed")


SQL["op5_line_dedup"] = """
WITH lines AS (
  SELECT d.doc_id, '=' || d.source AS site, u.pos, string_split(d.text, chr(10))[u.pos] AS line
  FROM documents d, unnest(range(1, len(string_split(d.text, chr(10))) + 1)) AS u(pos)
), keyed AS (
  SELECT doc_id, coalesce(site, '') AS site, pos, line, trim(line, ' ') AS key FROM lines
), boilerplate AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= 5
), marked AS (
  SELECT k.*, b.key IS NOT NULL AS goes FROM keyed k LEFT JOIN boilerplate b USING (key)
), cleaned AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes) AS text, count(*)::INT AS n_lines,
         (count(*) FILTER (goes))::INT AS n_removed
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(c.text, '') END AS text,
       coalesce(c.n_lines, 0)::INT AS n_lines, coalesce(c.n_removed, 0)::INT AS n_removed
FROM documents d LEFT JOIN cleaned c USING (doc_id)
"""

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, RULES, default="allow").select("page_id", "host", "path", "rule", "verdict")


SQL["op6_url_filter"] = """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT parts.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch(spark, "shards")
    sharding.write_shards(docs, path)
    rows = sharding.read_shards(spark, path, 8)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return rows.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "file"
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, temperature=0.5, epochs=1.0, seed="mix")


SQL["op8_mixing"] = """
WITH RECURSIVE sizes AS (
  SELECT source, sum(coalesce(strlen(text), 0))::DOUBLE AS size FROM documents GROUP BY source
), means AS (
  SELECT source, CASE WHEN size = 0 THEN 1.0::DOUBLE
                      ELSE sum(size) OVER () * (pow(size, 0.5) / sum(pow(size, 0.5)) OVER ()) / size END AS mean FROM sizes
), parts AS (
  SELECT source, ceil(mean / 16.0)::INT AS draws, mean / ceil(mean / 16.0) AS mean FROM means WHERE mean > 0
), steps AS (
  SELECT source, draws, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM parts
  UNION ALL
  SELECT source, draws, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM steps
  WHERE k < ceil(mean + 12 * sqrt(mean)) + 30
), drawn AS (
  SELECT d.doc_id, d.source,
         ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || u.j), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents d JOIN parts ON d.source IS NOT DISTINCT FROM parts.source, unnest(range(1, draws + 1)) AS u(j)
), counts AS (
  SELECT doc_id, count(*) AS n FROM drawn JOIN steps ON drawn.source IS NOT DISTINCT FROM steps.source AND c <= u GROUP BY doc_id
)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy,
       md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || copy || ':order') AS shuffle_key
FROM (SELECT d.*, unnest(range(1, n + 1)) AS copy FROM documents d JOIN counts USING (doc_id))
"""


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(ship(spark), sf_dir, "embeddings")
    return nndescent.near_duplicates(rows, threshold=0.93)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out()))
    rows = langid.predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "clicks")
    points = resample.latest_points(clicks, key_column="client_id", time_column="ts", value_column="value", order_column="click_id")
    rows = resample.resample(points, bucket=21600, max_gap=300, signal="step")
    return rows.withColumnsRenamed({"key": "client_id", "avg": "avg_cents"})


SQL["op11_resample"] = """
WITH points AS (
  SELECT client_id, epoch_us(ts) // 1000000 AS t, floor(100 * value + 0.5)::BIGINT AS v FROM clicks
  WHERE client_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY client_id, epoch_us(ts) // 1000000 ORDER BY click_id DESC NULLS LAST, value DESC) = 1
), segments AS (
  SELECT client_id, t, v, least(coalesce(lead(t) OVER (PARTITION BY client_id ORDER BY t) - t, 300), 300) AS cover FROM points
), parts AS (
  SELECT client_id, b * 21600 AS bucket_start, (b = t // 21600)::BIGINT AS n, least((b + 1) * 21600, t + cover) - greatest(b * 21600, t) AS s, v
  FROM segments, unnest(range(t // 21600, (t + cover - 1) // 21600 + 1)) AS u(b)
), sums AS (
  SELECT client_id, bucket_start, sum(n)::BIGINT AS n_points, sum(s)::BIGINT AS covered_seconds, sum(2 * v * s)::HUGEINT AS area2 FROM parts GROUP BY ALL
)
SELECT client_id, bucket_start, n_points, covered_seconds, area2::BIGINT AS area2,
       ((area2 - ((area2 % (2 * covered_seconds)) + 2 * covered_seconds) % (2 * covered_seconds)) // (2 * covered_seconds))::BIGINT AS avg_cents
FROM sums
"""


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by a hash of the id, end in copies of a piece of themselves; one without an id stays."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    rows = runs.periodic_runs(docs, min_length=12, min_repeats=2, rewrite=repeated_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = rows.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.p")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"), F.call_function("div", 1000 * length, period).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.template_table(spark, licenses.TEMPLATES), threshold=0.8)


def quoted(rows: list[tuple[str, str]]) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


SQL["op13_licenses"] = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.WORD}') AS ws FROM documents
), phrases AS (
  SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {quoted(licenses.PHRASES)}) AS v(phrase, label)
), places AS (
  SELECT r, label, u.i - 1 AS spot FROM texts, unnest(range(1, len(ws) + 1)) AS u(i), phrases
  WHERE ws[u.i] = p[1] AND list_slice(ws, u.i, u.i + len(p) - 1) = p
), base AS (
  SELECT r, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY r
), parts AS (
  SELECT label, list_distinct(regexp_extract_all(translate(text, '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.WORD}')) AS tokens
  FROM (VALUES {quoted(licenses.TEMPLATES)}) AS v(label, text)
), blocks AS (
  SELECT r, list_distinct(list_slice(ws, b * 32 + 1, b * 32 + 64)) AS held FROM texts, unnest(range(greatest(((len(ws) + 31) // 32 - 1)::BIGINT, 1))) AS u(b)
), met AS (
  SELECT r, label, len(list_intersect(held, tokens)) / len(tokens) AS score FROM blocks, parts
  WHERE len(list_intersect(held, tokens)) >= ceil(len(tokens) * 0.8 - 1e-9)
), more AS (
  SELECT r, list(DISTINCT label) AS labels, max(score) AS best FROM met GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       (CASE WHEN n_base > 0 THEN 1 ELSE coalesce(best, 0) END)::DOUBLE AS score
FROM texts LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_mtree_topk": op2_mtree_topk,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_orc_tokens": op4_orc_tokens,
    "op5_line_dedup": op5_line_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_hilbert_sharding": op7_hilbert_sharding,
    "op8_mixing": op8_mixing,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_language_id": op10_language_id,
    "op11_resample": op11_resample,
    "op12_runs": op12_runs,
    "op13_licenses": op13_licenses,
}
