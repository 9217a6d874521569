"""All registered queries of the engine over the driver's tables, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import hashing, text
from lodestack.operators import assembly, communities, graph, memory, predicates, retrieval
from lodestack.runtime import ship, table

FLAGSHIP = "hybrid_topk"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WORDS = ["the", "and", "license", "version"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def bm25_sql(keep: str) -> str:
    return f"""
WITH w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, u.w FROM w, unnest(ws) AS u(w)),
l AS (SELECT doc_id, lang, len(ws) AS len FROM w), s AS (SELECT count(*) AS n, avg(len) AS av FROM l),
tf AS (SELECT doc_id, w, count(*) AS f FROM t WHERE w IN ('the', 'and', 'license', 'version') GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w)
SELECT doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / av))), 6) AS score
FROM tf JOIN df USING (w) JOIN l USING (doc_id), s WHERE {keep} GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10"""


POINT = [round(((i * 37) % 64 - 32) / 256, 6) for i in range(64)]
KNN = """SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(embedding[i]::DOUBLE - (((((i - 1) * 37) % 64) - 32) / 256.0)::DOUBLE, 2)))), 6) AS distance
FROM embeddings {where} ORDER BY distance, vec_id LIMIT 10"""


@query(KNN.format(where=""))
def knn_l2_topk(spark, sf):
    return retrieval.knn(table(spark, sf, "embeddings"), [((i * 37) % 64 - 32) / 256 for i in range(64)], "vec_id", "embedding", 10)


@query(KNN.format(where="WHERE label IN (1, 3)"))
def knn_filtered(spark, sf):
    return retrieval.knn(table(spark, sf, "embeddings"), [((i * 37) % 64 - 32) / 256 for i in range(64)], "vec_id", "embedding", 10, F.col("label").isin(1, 3))


@query("""WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 100),
b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders QUALIFY r <= 100),
f AS (SELECT o_orderkey, round(sum(1.0 / (60 + r)), 9) AS rrf, min(r)::INT AS best_rank FROM (FROM a UNION ALL FROM b) GROUP BY o_orderkey)
SELECT * FROM f ORDER BY rrf DESC, best_rank, o_orderkey LIMIT 20""")
def rrf_two_rankings(spark, sf):
    orders = table(spark, sf, "orders")
    lists = [retrieval.ranked(orders.orderBy(F.desc(c), "o_orderkey").limit(100).select("o_orderkey", c), F.desc(c), F.col("o_orderkey")) for c in ("o_totalprice", "o_orderdate")]
    return retrieval.rrf(lists, "o_orderkey").orderBy(F.desc("rrf"), "best_rank", "o_orderkey").limit(20)


@query("""SELECT o_orderkey, round(o_totalprice / 1000000 + 0.5 * exp(-greatest(date_diff('day', o_orderdate::DATE, DATE '1998-09-01'), 0) / 30.0)
 + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.25 ELSE 0 END, 6) AS score FROM orders ORDER BY score DESC, o_orderkey LIMIT 20""")
def rescore_recency_authority(spark, sf):
    age = F.datediff(F.lit("1998-09-01").cast("date"), F.col("o_orderdate").cast("date")).cast("double")
    score = retrieval.rescore(F.col("o_totalprice") / 1000000, age, F.col("o_orderpriority") == "1-URGENT", 0.5, 0.25, 30.0)
    return table(spark, sf, "orders").select("o_orderkey", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "o_orderkey").limit(20)


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) = 1""")
def best_hit_per_group(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return retrieval.best_per(rows, ["l_orderkey"], F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")).drop("l_partkey")


@query("""SELECT l_orderkey, max(l_extendedprice) AS score, min(l_linenumber) AS first_line, count(*) AS n FROM lineitem GROUP BY 1""")
def max_score_promotion(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("score"), F.min("l_linenumber").alias("first_line"), F.count("*").alias("n"))


@query("""SELECT event_type AS verb, count(*) AS n, max(ts) AS last FROM events GROUP BY 1""")
def verb_usage(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("verb")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))


@query("""SELECT k AS key, count(*) AS n FROM events, unnest(json_keys(props)) AS u(k) GROUP BY 1 ORDER BY n DESC, key LIMIT 10""")
def top_keys(spark, sf):
    keys = table(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(10)


@query("""SELECT event_id, ts FROM events WHERE value > 50 ORDER BY ts DESC, event_id LIMIT 50""")
def recent_n(spark, sf):
    return table(spark, sf, "events").filter("value > 50").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(50)


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1996-06-01'""")
def valid_at(spark, sf):
    rows = table(spark, sf, "orders").withColumn("until", F.expr("o_orderdate + interval 90 days"))
    return rows.filter(predicates.valid_at("o_orderdate", "until", F.expr("timestamp'1996-06-01'"))).select("o_orderkey")


def foreign_edges(spark, sf) -> DataFrame:
    """customer -> nation and order -> customer edges, with disjoint node numbers; every 17th customer points nowhere."""
    customer = table(spark, sf, "customer")
    nation = F.when(F.col("c_custkey") % 17 == 0, F.lit(-99)).otherwise(-1 - F.col("c_nationkey"))
    lives = customer.select(F.col("c_custkey").alias("src"), nation.cast("long").alias("dst"), F.lit("lives_in").alias("type"))
    placed = table(spark, sf, "orders").select((F.col("o_orderkey") + 1_000_000_000).alias("src"), F.col("o_custkey").alias("dst"), F.lit("placed").alias("type"))
    return lives.unionByName(placed)


EDGES = """edges AS (SELECT c_custkey::BIGINT AS src, CASE WHEN c_custkey % 17 = 0 THEN -99 ELSE -1 - c_nationkey END::BIGINT AS dst, 'lives_in' AS type FROM customer
UNION ALL SELECT o_orderkey + 1000000000, o_custkey, 'placed' FROM orders)"""


@query(f"WITH {EDGES} SELECT src, type FROM edges WHERE dst = -1")
def backlinks(spark, sf):
    return graph.backlinks(foreign_edges(spark, sf), -1).select("src", "type")


@query(f"WITH {EDGES} SELECT dst, type, dst IN (SELECT -1 - n_nationkey FROM nation) AS resolved FROM edges WHERE type = 'lives_in'")
def forward_links(spark, sf):
    nations = table(spark, sf, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("dst"), F.lit(True).alias("there"))
    own = foreign_edges(spark, sf).filter("type = 'lives_in'")
    return own.join(nations, "dst", "left").select("dst", "type", F.col("there").isNotNull().alias("resolved"))


@query(f"WITH {EDGES} SELECT src, dst, type FROM edges WHERE type = 'lives_in' AND dst NOT IN (SELECT -1 - n_nationkey FROM nation)")
def broken_links(spark, sf):
    nations = table(spark, sf, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("id"))
    return graph.broken(foreign_edges(spark, sf).filter("type = 'lives_in'"), nations).select("src", "dst", "type")


@query(f"""WITH {EDGES}, f1 AS (SELECT DISTINCT dst AS node, 1 AS hop, src AS seed, type, 0 AS turn FROM edges WHERE src IN (1, 2, 3)),
f2 AS (SELECT DISTINCT e.dst AS node, 2 AS hop, f1.seed, e.type, 0 AS turn FROM f1 JOIN edges e ON e.src = f1.node),
b1 AS (SELECT DISTINCT src AS node, 1 AS hop, dst AS seed, type, 1 AS turn FROM edges WHERE dst IN (1, 2, 3)),
b2 AS (SELECT DISTINCT e.src AS node, 2 AS hop, b1.seed, e.type, 1 AS turn FROM b1 JOIN edges e ON e.dst = b1.node)
SELECT node, hop, seed, type FROM (FROM f1 UNION ALL FROM f2 UNION ALL FROM b1 UNION ALL FROM b2) WHERE node NOT IN (1, 2, 3)
QUALIFY row_number() OVER (PARTITION BY node ORDER BY hop, seed, type, turn) = 1""")
def expand_2hop(spark, sf):
    seeds = spark.range(1, 4).select(F.col("id").alias("seed"))
    return graph.expand(foreign_edges(spark, sf), seeds, 2, "both").drop("rel")


@query(f"""WITH {EDGES}, n AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT -1 - n_nationkey FROM nation)
SELECT count(*) AS n_edges, round(count(*) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1) / 2.0), 9) AS density
FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def induced_density(spark, sf):
    nodes = table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id")).unionByName(table(spark, sf, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("id")))
    n = nodes.agg(F.count("*").alias("n"))
    counted = graph.induced(foreign_edges(spark, sf), nodes).agg(F.count("*").alias("n_edges"))
    return counted.join(F.broadcast(n)).select("n_edges", F.round(F.col("n_edges") / (F.col("n") * (F.col("n") - 1) / 2.0), 9).alias("density"))


@query("""SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def missing_rows(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""WITH o AS (SELECT o_orderkey, md5(o_orderstatus) AS body, md5(o_orderpriority) AS props FROM orders WHERE o_orderkey % 10 <> 0),
n AS (SELECT o_orderkey, md5(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END) AS body, md5(CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderpriority END) AS props FROM orders WHERE o_orderkey % 13 <> 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.body IS NULL THEN 'new' WHEN n.body IS NULL THEN 'deleted' WHEN o.body <> n.body THEN 'body' WHEN o.props <> n.props THEN 'properties' ELSE 'unchanged' END AS change
FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def change_classify(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    old = orders.filter("o_orderkey % 10 <> 0").select("o_orderkey", F.md5("o_orderstatus").alias("body"), F.md5("o_orderpriority").alias("props"))
    new = orders.filter("o_orderkey % 13 <> 0").select("o_orderkey", F.expr("md5(if(o_orderkey % 7 = 0, 'X', o_orderstatus))").alias("body"), F.expr("md5(if(o_orderkey % 11 = 0, 'X', o_orderpriority))").alias("props"))
    return assembly.classify_changes(old, new, "o_orderkey", "body", "props")


@query("""WITH b AS (SELECT l_orderkey AS k, l_linenumber AS name, l_linenumber * 10 AS low, l_linenumber * 10 + l_suppkey % 40 AS high FROM lineitem),
p AS (SELECT o_orderkey AS k, (o_custkey % 70)::INT AS point FROM orders)
SELECT k, point, name FROM p JOIN b USING (k) WHERE point BETWEEN low AND high QUALIFY row_number() OVER (PARTITION BY k, point ORDER BY high - low, name) = 1""")
def section_band_join(spark, sf):
    bands = table(spark, sf, "lineitem").selectExpr("l_orderkey as k", "l_linenumber as name", "l_linenumber * 10 as low", "l_linenumber * 10 + l_suppkey % 40 as high")
    points = table(spark, sf, "orders").selectExpr("o_orderkey as k", "cast(o_custkey % 70 as int) as point")
    return assembly.enclosing(points, bands, "k", "point", "low", "high", "name").select("k", "point", "name")


@query("""WITH r AS (SELECT doc_id, source, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents)
SELECT doc_id, least(n, greatest(0, 6000 - b))::BIGINT AS taken, 6000 - b > 0 AS included FROM r""")
def budget_projection(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", "text")
    return assembly.budget(rows, ["source"], [F.col("doc_id")], "text", 6000).select("doc_id", "taken", "included")


@query("""SELECT doc_id // 10 AS brief, doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 9 = 0 OR doc_id % 14 = 0""")
def staleness_join(spark, sf):
    docs = table(spark, sf, "documents")
    recorded = docs.select(F.expr("doc_id div 10").alias("brief"), "doc_id", F.sha2("text", 256).alias("hash"))
    current = docs.filter("doc_id % 9 <> 0").select("doc_id", F.when(F.col("doc_id") % 14 == 0, F.lit("changed")).otherwise(F.sha2("text", 256)).alias("hash"))
    return assembly.stale_sources(recorded, current, "doc_id").select("brief", "doc_id", "hash")


@query("""SELECT source, coalesce(CASE WHEN doc_id % 5 <> 0 THEN lang END, 'unknown') AS lang, count(*) AS n FROM documents GROUP BY ALL""")
def dossier_rollup(spark, sf):
    return assembly.histogram(table(spark, sf, "documents").select("source", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang")), ["source"], "lang")


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn, role, text) AS markdown FROM conversations GROUP BY conv_id""")
def conversation_render(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n\n").alias("markdown"))


@query("""SELECT page_id, u.h AS href FROM pages, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS u(h)""")
def href_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


@query("""WITH p AS (SELECT p_brand AS grp, k.key AS key, k.val AS val FROM (SELECT p_brand, unnest([{key: 'type', val: p_type}, {key: 'size', val: p_size::VARCHAR}]) AS k FROM part)),
c AS (SELECT grp, key, val, count(*) AS n FROM p GROUP BY ALL), m AS (SELECT p_brand AS grp, count(*) AS members FROM part GROUP BY 1),
t AS (SELECT grp, key, sum(n)::BIGINT AS present, max(n) AS top, arg_max(val, {n: n, v: val}) AS v FROM c GROUP BY ALL)
SELECT grp, key, present, round(present / members, 6) AS prevalence, CASE WHEN top / present > 0.5 THEN v END AS dominant FROM t JOIN m USING (grp)""")
def key_prevalence_dominant(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_brand").alias("grp"), "p_type", F.col("p_size").cast("string").alias("p_size"))
    properties = part.select("grp", F.explode(F.create_map(F.lit("type"), "p_type", F.lit("size"), "p_size")).alias("key", "val"))
    return assembly.prevalence(properties, "grp", "key", "val", part.groupBy("grp").agg(F.count("*").alias("members")))


@query("""SELECT list_sort(list(doc_id)) AS ids FROM documents GROUP BY sha256(text) HAVING count(*) > 1""")
def rename_hashset_match(spark, sf):
    groups = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return groups.filter(F.size("ids") > 1).select("ids")


@query("""WITH RECURSIVE s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey + 1 END AS next FROM orders),
c AS (SELECT id AS start, id, next, 0 AS hops FROM s UNION ALL SELECT c.start, s.id, s.next, hops + 1 FROM c JOIN s ON s.id = c.next WHERE hops < 100)
SELECT start, arg_max(id, hops) AS final, max(hops) AS hops FROM c GROUP BY start""")
def supersede_chain(spark, sf):
    pointers = table(spark, sf, "orders").selectExpr("o_orderkey as id", "if(o_orderkey % 4 <> 0, o_orderkey + 1, null) as next")
    return memory.follow(pointers, most=100)


@query("""SELECT event_id, ts FROM events WHERE value >= 20 ORDER BY (event_type = 'click')::INT DESC, ts DESC, event_id LIMIT 20""")
def recall_order(spark, sf):
    rows = table(spark, sf, "events").filter("value >= 20")
    return rows.orderBy(F.desc((F.col("event_type") == "click").cast("int")), F.desc("ts"), "event_id").limit(20).select("event_id", "ts")


@query("""SELECT conv_id, sha256('["driver","' || conv_id || '"]') AS identity, count(*) AS messages FROM conversations GROUP BY conv_id""")
def import_preview(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"))
    return rows.select("conv_id", hashing.import_identity(F.lit("driver"), F.col("conv_id").cast("string")).alias("identity"), "messages")


@query("""WITH b AS (SELECT l_orderkey AS k, l_linenumber AS name, 10 * l_linenumber AS low, CASE WHEN l_linenumber % 2 = 1 THEN 10 * l_linenumber + 5 ELSE 200 - l_linenumber END AS high FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS k, (l_partkey % 190) AS point FROM lineitem)
SELECT k, point, (SELECT arg_min(name, {w: high - low, n: name}) FROM b WHERE b.k = p.k AND low <= point AND point <= high) AS name FROM p""")
def section_stab(spark, sf):
    """The innermost of nested bands, by a sweep: lines of even number go far, those of odd number stay short."""
    lines, n = table(spark, sf, "lineitem"), F.col("l_linenumber")
    bands = lines.select(F.col("l_orderkey").alias("k"), n.alias("name"), (10 * n).alias("low"), F.when(n % 2 == 1, 10 * n + 5).otherwise(200 - n).alias("high"))
    return assembly.innermost(lines.select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 190).alias("point")).distinct(), bands, "k", "point", "low", "high", "name")


@query()
def chunk_bounds(spark, sf):
    docs = table(ship(spark), sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(text.chunks_udf("text")).alias("ord", "c")).select("doc_id", "ord", "c.*")


def shipped(spark, sf) -> DataFrame:
    """Edges between suppliers and the parts that they ship, a graph for each kind of return."""
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_suppkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst"))


@query()
def louvain_partition(spark, sf):
    """Clusters of suppliers and parts."""
    return communities.louvain(shipped(spark, sf), "grp")


@query("""WITH e AS (SELECT DISTINCT l_returnflag AS grp, l_suppkey AS s, l_partkey AS p FROM lineitem), c AS (SELECT grp, p, min(s) AS c, count(*) AS k FROM e GROUP BY ALL), m AS (SELECT grp, count(*) AS edges, count(DISTINCT s) + count(DISTINCT p) AS nodes FROM e GROUP BY 1),
t AS (SELECT grp, c, sum(k) AS tot FROM (SELECT grp, s AS c, count(*) AS k FROM e GROUP BY ALL UNION ALL SELECT grp, c, k FROM c) GROUP BY ALL), i AS (SELECT grp, c, count(*) AS n FROM c GROUP BY ALL)
SELECT grp, edges, nodes, round(sum(coalesce(n, 0) / edges - pow(tot / (2 * edges), 2)), 6)::DOUBLE AS stars, true AS better FROM t LEFT JOIN i USING (grp, c) JOIN m USING (grp) GROUP BY ALL""")
def louvain_told(spark, sf):
    """Modularity of a plain partition (each part with its first supplier), and that Louvain's places every node and is better."""
    rows = shipped(spark, sf)
    first = rows.groupBy("grp", F.col("dst").alias("node")).agg(F.min("src").alias("cluster"))
    level = communities.leveled(rows, "grp")
    stars = communities.modularity(rows, first.unionByName(rows.select("grp", F.col("src").alias("node"), F.col("src").alias("cluster")).distinct()), "grp", level=level)
    found = communities.modularity(rows, communities.louvain(rows, "grp", level=level), "grp", level=level).select("g", F.col("nodes").alias("placed"), F.col("modularity").alias("reached"))
    both = stars.join(found, "g")
    return both.select(F.col("g").alias("grp"), "edges", "nodes", F.col("modularity").alias("stars"), ((F.col("reached") > F.col("modularity")) & (F.col("placed") == F.col("nodes"))).alias("better"))
