"""Queries of hybrid search and of the stored index, over documents as chunks (four to a note, a vault for each language)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import edges, fulltext, generations, hybrid, postings
from lodestack.operators.hybrid import Condition
from lodestack.plans.registry import EDGES, WORDS, bm25_sql, foreign_edges, query
from lodestack.runtime import scratch, ship, state_of, table
from lodestack.streaming import timers

ASKED = ["the", "and"]
NOW = "TIMESTAMP '2024-01-01 00:00:00'"
_BUILT: dict[tuple[str, ...], postings.Index] = {}


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks. The vectors are those of the same number: a made-up pairing, the tables have no key for it."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", F.coalesce("lang", F.lit("none")).alias("vault"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    number = F.col("doc_id")
    return docs.join(vectors, "doc_id", "left").select(
        "vault", F.floor(number / 4).alias("note"), number.alias("chunk"), "text", "vector",
        F.to_json(F.struct("source", (number % 6 == 0).alias("authoritative"))).alias("props"), F.when(number % 9 == 0, "superseded").alias("status"),
        F.when(number % 10 == 3, F.expr("timestamp'2030-01-01'")).alias("valid_from"), F.when(number % 14 == 5, F.expr("timestamp'2020-01-01'")).alias("valid_to"),
        (F.expr("timestamp'2024-01-01'") - F.make_dt_interval(days=(number % 100).cast("int"))).alias("mtime"),
    )


def index_of(spark: SparkSession, sf: str, kind: str = "plain") -> postings.Index:
    """The stored index of the documents, built once in a session for the files as they are: of the whole table, or with a vault for each language."""
    key = (spark.sparkContext.applicationId, sf, kind, state_of(spark, f"{sf}/documents.parquet"))
    if key not in _BUILT:
        if kind == "plain":
            _BUILT[key] = postings.build(table(spark, sf, "documents"), scratch(spark, "index"), "doc_id", "text")
        else:
            named = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk"), "text", F.coalesce("lang", F.lit("none")).alias("vault"))  # as `chunks`, without the vectors
            _BUILT[key] = postings.build(named, scratch(spark, "index"), "chunk", "text", "vault")
    return _BUILT[key]


def now():
    return F.expr("timestamp'2024-01-01'")


POINT = [((i * 37) % 64 - 32) / 256 for i in range(64)]
CHUNKS = """c AS (SELECT coalesce(lang, 'none') AS vault, doc_id // 4 AS note, doc_id AS chunk, text, source, embedding AS vector, doc_id % 100 AS age, doc_id % 6 = 0 AS auth,
  doc_id % 9 <> 0 AND doc_id % 10 <> 3 AND doc_id % 14 <> 5 AS shown FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""


@query(bm25_sql("true"))
def bm25_topk(spark, sf):
    return index_of(spark, sf).bm25(WORDS, 10).select(F.col("key").alias("doc_id"), "score")


@query(bm25_sql("lang = 'en'"))
def bm25_filtered_topk(spark, sf):
    english = table(spark, sf, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("key"))
    return index_of(spark, sf).bm25(WORDS, 10, keep=english).select(F.col("key").alias("doc_id"), "score")


def fused_sql(n: int, vector: bool = True) -> str:
    """CTEs up to h: the n best chunks of each vault (vault, chunk, score, best_rank, text_rank, near_rank)."""
    near = """nl AS (SELECT vault, chunk, 'near' AS list, row_number() OVER (PARTITION BY vault ORDER BY d, chunk) AS r FROM (SELECT vault, chunk,
  round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(vector[i]::DOUBLE - (((((i - 1) * 37) % 64) - 32) / 256.0)::DOUBLE, 2)))), 6) AS d FROM c WHERE shown AND len(vector) = 64) QUALIFY r <= {m}),"""
    return f"""{CHUNKS}, w AS (SELECT chunk, vault, shown, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM c),
l AS (SELECT vault, chunk, shown, coalesce(len(ws), 0) AS len FROM w), s AS (SELECT vault, count(*) AS n, avg(len) AS av FROM l GROUP BY vault),
tf AS (SELECT vault, chunk, u.w, count(*) AS f FROM w, unnest(ws) AS u(w) WHERE u.w IN ('the', 'and') GROUP BY ALL), df AS (SELECT vault, w, count(*) AS df FROM tf GROUP BY ALL),
t AS (SELECT vault, chunk, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / av))), 6) AS score, count(*) AS found
  FROM tf JOIN df USING (vault, w) JOIN l USING (vault, chunk) JOIN s USING (vault) WHERE shown GROUP BY ALL HAVING found = 2),
tl AS (SELECT vault, chunk, 'text' AS list, row_number() OVER (PARTITION BY vault ORDER BY score DESC, chunk) AS r FROM t QUALIFY r <= {3 * n}),
{near.format(m=3 * n) if vector else "nl AS (SELECT vault, chunk, 'near' AS list, 1::BIGINT AS r FROM c WHERE false),"}
f AS (SELECT vault, chunk, round(sum(1.0 / (60 + r)), 9)::DOUBLE AS score, min(r)::INT AS best_rank, min(r) FILTER (list = 'text')::INT AS text_rank, min(r) FILTER (list = 'near')::INT AS near_rank FROM (FROM tl UNION ALL FROM nl) GROUP BY ALL),
h AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY vault ORDER BY score DESC, best_rank, chunk) <= {n})"""


def found(spark, sf, **options) -> DataFrame:
    rows = chunks(ship(spark), sf)
    return hybrid.search(rows, index_of(spark, sf, "vaults"), ASKED, options.pop("vector", POINT), now(), **options)


@query(f"WITH {fused_sql(10)} SELECT vault, chunk, score, best_rank, text_rank, near_rank FROM h ORDER BY score DESC, best_rank, vault, chunk LIMIT 10")
def hybrid_topk(spark, sf):
    return found(spark, sf).select("vault", "chunk", "score", "best_rank", "text_rank", "near_rank")


@query(f"WITH {fused_sql(10, False)} SELECT vault, chunk, score, text_rank FROM h ORDER BY score DESC, best_rank, vault, chunk LIMIT 10")
def hybrid_bm25_only(spark, sf):
    return found(spark, sf, vector=None).select("vault", "chunk", "score", "text_rank")


@query(f"WITH {fused_sql(10)} SELECT vault, chunk, score FROM h WHERE vault IN ('en', 'de') ORDER BY score DESC, best_rank, vault, chunk LIMIT 10")
def hybrid_vaults(spark, sf):
    """Some vaults only: each ranks for itself, so the others don't change what these find."""
    return found(spark, sf, vaults=["en", "de"]).select("vault", "chunk", "score")


@query(f"""WITH {fused_sql(10)} SELECT h.vault, chunk, round(score + 0.02 * exp(-age / 30.0) + CASE WHEN auth THEN 0.01 ELSE 0 END, 9) AS score FROM h JOIN c USING (chunk)
ORDER BY 3 DESC, best_rank, h.vault, chunk LIMIT 10""")
def hybrid_rescored(spark, sf):
    return found(spark, sf, recency=0.02, authority=0.01).select("vault", "chunk", "score")


@query(f"""WITH {fused_sql(30)} SELECT h.vault, chunk, source, round(score + CASE WHEN source = 'src3' THEN 0.01 ELSE 0.0 END, 9)::DOUBLE AS score FROM h JOIN c USING (chunk) WHERE auth
ORDER BY score DESC, best_rank, h.vault, chunk LIMIT 10""")
def hybrid_boosted(spark, sf):
    """Property filter and boost, before the cut, over three times as many candidates."""
    rows = found(spark, sf, boosts=[Condition("source", "src3", 0.01)], only=[Condition("authoritative", "true")])
    return rows.select("vault", "chunk", F.get_json_object("props", "$.source").alias("source"), "score")


@query("""SELECT doc_id, source, round(CASE WHEN source = 'src3' THEN 0.5 ELSE 0 END + CASE WHEN doc_id % 6 = 0 THEN 0.25 ELSE 0 END + 1.0 / (1 + doc_id % 7), 9)::DOUBLE AS score
FROM documents WHERE source IS NOT NULL AND doc_id % 2 = 0""")
def boost_and_filter(spark, sf):
    """Boosts and filters on property text: a boolean and an array match like their words."""
    number = F.col("doc_id")
    props = F.to_json(F.struct("source", (number % 6 == 0).alias("sure"), F.array(F.when(number % 2 == 0, F.lit("even")).otherwise(F.lit("odd"))).alias("tags")))
    rows = table(spark, sf, "documents").select("doc_id", "source", props.alias("props"), (1.0 / (1 + number % 7)).alias("score")).filter("source is not null")
    return hybrid.boosted(rows, [Condition("source", "src3", 0.5), Condition("sure", "true", 0.25)], [Condition("tags", "even")]).select("doc_id", "source", "score")


@query(f"""WITH {fused_sql(40)}, b AS (SELECT h.vault, note, chunk, score, best_rank FROM h JOIN c USING (chunk) QUALIFY row_number() OVER (PARTITION BY h.vault, note ORDER BY score DESC, best_rank, chunk) = 1)
SELECT vault, note, chunk, score FROM b ORDER BY score DESC, best_rank, vault, chunk LIMIT 10""")
def hybrid_notes(spark, sf):
    """The best chunk of each note, from four times as many candidates."""
    return found(spark, sf, notes=True).select("vault", "note", "chunk", "score")


def near_1500(asked: str, texts: list[str]) -> list[float]:
    """A reranker for the check: texts of about 1500 characters first."""
    return [-abs(len(t) - 1500.0) for t in texts]


@query(f"""WITH {fused_sql(50)}, p AS (SELECT h.vault, chunk, score, text FROM h JOIN c USING (chunk) ORDER BY score DESC, h.vault, chunk LIMIT 50)
SELECT vault, chunk, score, -abs(length(text) - 1500.0)::DOUBLE AS rerank FROM p WHERE length(trim(text, ' ')) >= 20 ORDER BY rerank DESC, score DESC, vault, chunk LIMIT 10""")
def hybrid_rerank(spark, sf):
    return found(spark, sf, scorer=near_1500).select("vault", "chunk", "score", "rerank")


@query(f"""WITH {fused_sql(10)}, k AS (SELECT h.vault, note, chunk, score FROM h JOIN c USING (chunk) ORDER BY score DESC, best_rank, h.vault, chunk LIMIT 10),
m AS (SELECT vault, note, min(chunk) AS chunk FROM c WHERE shown AND note = 7 GROUP BY ALL ORDER BY vault LIMIT 1),
o AS (SELECT k.* FROM k JOIN m ON k.vault = m.vault AND k.note = m.note ORDER BY score DESC, k.chunk LIMIT 1),
a AS (SELECT vault, note, chunk, score, 0 AS turn FROM o UNION ALL SELECT vault, note, chunk, 1.0, 0 FROM m WHERE NOT EXISTS (FROM o) UNION ALL SELECT vault, note, chunk, score, 1 FROM k WHERE chunk NOT IN (SELECT chunk FROM o))
SELECT vault, note, chunk, score::DOUBLE AS score, row_number() OVER (ORDER BY turn, score DESC, vault, chunk)::INT AS place FROM a ORDER BY place LIMIT 10""")
def hybrid_alias(spark, sf):
    """The whole query is an alias of a note: it comes first."""
    rows = chunks(spark, sf)
    aliases = rows.select("vault", "note").distinct().withColumn("alias", F.concat(F.lit("Note no. "), "note"))
    return hybrid.inject_alias(found(spark, sf), "  note NO. 7 ", aliases, rows, now(), 10)


@query(f"""WITH {fused_sql(10)}, k AS (SELECT h.vault, chunk, score FROM h ORDER BY score DESC, best_rank, h.vault, chunk LIMIT 10),
e AS (SELECT c_custkey AS src, CASE WHEN c_custkey % 17 = 0 THEN -99 ELSE -1 - c_nationkey END::BIGINT AS dst FROM customer)
SELECT k.vault, k.chunk, k.score, coalesce(list(e.dst) FILTER (e.dst IS NOT NULL), []) AS neighbours FROM k LEFT JOIN e ON e.src = k.chunk GROUP BY ALL""")
def hybrid_expanded(spark, sf):
    """Each hit with its neighbours by lives_in edges (of the customer of the same number); the ranking stays."""
    hits = found(spark, sf).select("vault", "chunk", "score")
    lives = foreign_edges(spark, sf).filter("type = 'lives_in'").join(hits.select(F.col("chunk").alias("src")), "src", "left_semi")
    reached = lives.select(F.col("src").alias("seed"), F.col("dst").alias("node"), F.lit(1).alias("hop"), "type")
    out = hybrid.with_neighbours(hits, reached, "chunk")
    return out.select("vault", "chunk", "score", F.transform("neighbours", lambda n: n["node"]).alias("neighbours"))


@query(f"""WITH {fused_sql(10)}, k AS (SELECT h.vault, note, chunk, score, text, age FROM h JOIN c USING (chunk) ORDER BY score DESC, best_rank, h.vault, chunk LIMIT 10)
SELECT 'store://' || vault || '/' || note || '.md' AS doc_id, 'store://' || vault AS source, 'Note ' || note AS title, note || '.md' AS path, sha256(text) AS hash,
 TIMESTAMP '2024-01-01' - to_days(age::INT) AS mtime, score, left(text, 200) AS snippet, NULL::VARCHAR AS status, NULL::VARCHAR AS superseded_by, CASE WHEN chunk % 4 < 2 THEN 'first' ELSE 'second' END AS heading FROM k""")
def hybrid_hydrated(spark, sf):
    """Hits with their note, the heading of their section, and the packet that they are cited by."""
    hits = found(spark, sf)
    rows = chunks(spark, sf)
    notes = rows.select("vault", "note").distinct().select("vault", "note", F.concat("note", F.lit(".md")).alias("path"), F.concat(F.lit("Note "), "note").alias("title"), F.lit(None).cast("string").alias("superseded_by"))
    whole = notes.select("note").distinct()
    band = lambda low, high, name: whole.select("note", (F.col("note") * 4 + low).alias("low"), (F.col("note") * 4 + high).alias("high"), F.lit(name).alias("heading"))
    sections = band(0, 3, "all").unionByName(band(0, 1, "first")).unionByName(band(2, 3, "second"))
    full = hybrid.hydrate(hits, notes, sections)
    packet = hybrid.citation(full.withColumn("status", F.when(F.col("status") == "superseded", F.col("status"))))
    return packet.join(full.select(F.concat(F.lit("store://"), "vault", F.lit("/"), "path").alias("doc_id"), F.sha2("text", 256).alias("hash"), "heading"), ["doc_id", "hash"])


def words_sql(counts: str, where: str) -> str:
    """BM25 of leaves that SQL counts as columns f1, f2, ... of `tf` (doc_id, len and them)."""
    n = counts.count(" AS f")
    part = "CASE WHEN f{0} > 0 THEN greatest(ln((n - df{0} + 0.5) / (df{0} + 0.5)), 1e-6) * f{0} * 2.2 / (f{0} + 1.2 * (0.25 + 0.75 * len / av)) ELSE 0 END"
    return f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM documents),
tf AS (SELECT doc_id, coalesce(len(ws), 0) AS len, {counts} FROM w), s AS (SELECT count(*) AS n, avg(len) AS av, {", ".join(f"count(*) FILTER (f{i} > 0) AS df{i}" for i in range(1, n + 1))} FROM tf)
SELECT doc_id, round({" + ".join(part.format(i) for i in range(1, n + 1))}, 6)::DOUBLE AS score FROM tf, s WHERE {where} ORDER BY score DESC, doc_id LIMIT 10"""


def phrase_count(*words: str) -> str:
    return f"len(list_filter(range(1, len(ws) + 1), lambda i: {' AND '.join(f"coalesce(ws[i + {k}], '') = '{w}'" for k, w in enumerate(words))}))"


def asked(spark, sf, text: str) -> DataFrame:
    return fulltext.indexed(index_of(spark, sf), text, 10).select(F.col("key").alias("doc_id"), "score")


@query(words_sql(f"coalesce({phrase_count('under', 'the')}, 0) AS f1, coalesce({phrase_count('version', '2', '0')}, 0) AS f2", "f1 > 0 OR f2 > 0"))
def phrase_topk(spark, sf):
    """Tokens with marks inside are phrases; positions are met in the index."""
    return asked(spark, sf, "under-the OR version/2.0")


@query(words_sql("""coalesce(len(list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'license' AND len(list_filter(range(greatest(i - 4, 1), i + 5), lambda j: coalesce(ws[j], '') = 'under')) > 0)), 0) AS f1""", "f1 > 0"))
def near_topk(spark, sf):
    return asked(spark, sf, "NEAR(license under, 3)")


@query(words_sql("coalesce(len(list_filter(ws, lambda x: starts_with(x, 'lic'))), 0) AS f1, coalesce(len(list_filter(ws, lambda x: x = 'the')), 0) AS f2", "f1 > 0 AND f2 > 0 AND doc_id NOT IN (SELECT doc_id FROM w WHERE list_contains(ws, 'mit'))"))
def prefix_topk(spark, sf):
    """A prefix and a word, but not another word: files of the dictionary and the postings are chosen by their ranges of terms."""
    return asked(spark, sf, "(lic* AND the) NOT mit")


@query("""WITH h AS (SELECT doc_id AS node FROM ("""+bm25_sql("true")+f""")), {EDGES}, s AS (SELECT node AS id FROM h WHERE node IN (SELECT src FROM edges WHERE type = 'lives_in'))
SELECT id AS node FROM s UNION SELECT dst FROM edges WHERE src IN (FROM s) UNION SELECT src FROM edges WHERE dst IN (FROM s)""")
def cluster_for_query(spark, sf):
    """The graph around what a search finds, which is then clustered: hits stand for the customers of the same number."""
    links = foreign_edges(spark, sf)
    search = lambda vault, text, top: index_of(spark, sf).bm25(text.split(), top).join(links.filter("type = 'lives_in'").select(F.col("src").alias("key")), "key", "left_semi").select(F.col("key").alias("node"))
    seeds = edges.seeds_of(asked=" ".join(WORDS), search=search, vaults=["all"])
    return edges.cluster(links, seeds, force=True).select("node")


REPLACED = """documents AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'the license and the version' ELSE text END AS text, lang FROM main.documents WHERE doc_id % 7 <> 0)"""


@query(bm25_sql("true").replace("WITH w AS", f"WITH {REPLACED}, w AS"))
def index_replaced(spark, sf):
    """Search after an added segment: a fifth of the documents changed, a seventh removed."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    index = postings.build(docs, scratch(spark, "index"), "doc_id", "text")
    changed = docs.filter("doc_id % 5 = 0 and doc_id % 7 <> 0").withColumn("text", F.lit("the license and the version"))
    index.replace(changed, docs.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("key")), "doc_id", "text")
    return index.bm25(WORDS, 10).select(F.col("key").alias("doc_id"), "score")


@query("""WITH w AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM documents)
SELECT u.w AS term, count(*) AS df FROM w, unnest(list_distinct(ws)) AS u(w) GROUP BY 1""")
def index_terms(spark, sf):
    """The stored document frequencies of all words."""
    return index_of(spark, sf).read("terms").groupBy("term").agg(F.sum("df").alias("df"))


@query("""SELECT 'm' || (label % 3) AS model, count(*) AS chunks, count(*) FILTER (vec_id % 13 <> 0) AS embedded, count(*) FILTER (vec_id % 13 = 0) = 0 AS complete FROM embeddings GROUP BY 1""")
def model_inventory(spark, sf):
    """Embedded chunks of each model, and whether it may become the active one."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("m"), F.col("label") % 3).alias("model"))
    have = rows.filter("vec_id % 13 <> 0").select("vec_id", "model", F.lit(True).alias("there"))
    out = rows.join(have, ["vec_id", "model"], "left").groupBy("model").agg(F.count("*").alias("chunks"), F.count("there").alias("embedded"))
    return out.withColumn("complete", F.col("chunks") == F.col("embedded"))


@query("""WITH RECURSIVE e AS (SELECT CASE event_type WHEN 'click' THEN 'create' WHEN 'view' THEN 'delete' ELSE 'update' END AS kind, 'n' || (event_id % 5) AS id, user_id AS s, epoch_us(ts) // 1000 AS ms FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ms, kind <> 'delete', kind, id) AS k FROM e),
w AS (SELECT s, k, kind, id, ms, NULL::VARCHAR AS old_id, NULL::BIGINT AS old_k, CASE WHEN kind = 'delete' THEN [{ms: ms, id: id, k: k}] ELSE [] END AS open FROM r WHERE k = 1
UNION ALL SELECT s, k, kind, id, ms, m.id, m.k, CASE WHEN kind = 'delete' THEN list_append(o, {ms: ms, id: id, k: k}) WHEN m IS NOT NULL THEN list_filter(o, lambda x: x.k <> m.k) ELSE o END
 FROM (SELECT *, CASE WHEN kind = 'create' THEN list_filter(o, lambda x: x.id <> id)[1] END AS m FROM (SELECT r.*, list_filter(w.open, lambda x: x.ms + 86400000 >= r.ms) AS o FROM w JOIN r ON r.s = w.s AND r.k = w.k + 1))),
x AS (SELECT s, old_k AS k FROM w WHERE old_k IS NOT NULL)
SELECT kind, id, old_id, count(*) AS n, sum(ms)::HUGEINT::DOUBLE AS moments FROM (SELECT CASE WHEN old_id IS NULL THEN kind ELSE 'rename' END AS kind, id, old_id, ms FROM w WHERE kind <> 'delete'
UNION ALL SELECT kind, id, NULL, ms FROM w ANTI JOIN x USING (s, k) WHERE kind = 'delete') GROUP BY ALL""")
def stream_renames(spark, sf):
    """The events as a stream of changes, a user's notes having one content: renames, and deletions that a day's time didn't explain."""
    rows = table(ship(spark), sf, "events").filter("ts is not null and user_id is not null")
    kind = F.when(F.col("event_type") == "click", "create").when(F.col("event_type") == "view", "delete").otherwise("update")
    fed = rows.select(kind.alias("kind"), F.concat(F.lit("n"), F.col("event_id") % 5).alias("id"), F.col("ts").cast("timestamp").alias("at"), F.array(F.col("user_id").cast("string")).alias("hashes"))
    told = timers.replay(spark, fed, scratch(spark, "replay"), lambda stream: timers.renamed(stream, 86_400_000))
    return told.groupBy("kind", "id", "old_id").agg(F.count("*").alias("n"), F.sum(F.unix_millis("at")).cast("double").alias("moments"))


@query("""SELECT 'first' AS model, 64 AS dim, false AS active, count(*) AS chunks, count(vec_id) AS embedded, (SELECT count(*) FROM embeddings ANTI JOIN documents ON doc_id = vec_id) AS orphans, count(*) = count(vec_id) AS complete FROM documents LEFT JOIN embeddings ON vec_id = doc_id
UNION ALL SELECT 'second', 2, true, count(*), count(*), 0, true FROM documents""")
def generation_switch(spark, sf):
    """A generation that misses chunks can't be put to use; one that is filled in beside it can. Vectors go by the documents' numbers."""
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk"), "text")
    store = generations.Generations(spark, scratch(spark, "generations"))
    store.register("first", 64)
    store.register("second", 2)
    store.fill(table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk"), "embedding"), "first", lambda rows: rows.select("chunk", F.col("embedding").alias("vector")))
    store.switch(chunks, "first")
    store.fill(chunks, "second", lambda rows: rows.select("chunk", F.array(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).alias("vector")), parts=2)
    store.switch(chunks, "second")
    return store.inventory(chunks)
