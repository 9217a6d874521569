"""More queries of the engine: property filters, full-text syntax, link resolution, upkeep and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators import briefs, fulltext, graph, links, predicates
from lodestack.plans.registry import EDGES, bm25_sql, foreign_edges, query
from lodestack.runtime import ship, table
from lodestack.sources import markdown


def part_notes(spark, sf) -> DataFrame:
    """Parts as notes with JSON properties: size (of odd ones only) and tags."""
    size = F.when(F.col("p_size") % 2 == 1, F.col("p_size"))
    props = F.to_json(F.struct(size.alias("size"), F.col("p_brand").alias("brand"), F.split("p_type", " ").alias("tags")))
    return table(spark, sf, "part").select("p_partkey", props.alias("props"))


def with_props(spark, sf, where) -> DataFrame:
    return part_notes(spark, sf).filter(predicates.match_props("props", where)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size = 7")
def prop_eq(spark, sf):
    return with_props(spark, sf, {"size": 7})


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0")
def prop_null(spark, sf):
    return with_props(spark, sf, {"size": None})


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 3, 11)")
def prop_in(spark, sf):
    return with_props(spark, sf, {"size": {"$in": [1, 3, 4, 11]}})


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 1")
def prop_exists(spark, sf):
    return with_props(spark, sf, {"size": {"$exists": True}})


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'STANDARD') AND p_size % 2 = 1")
def prop_contains(spark, sf):
    return with_props(spark, sf, {"tags": {"$contains": "STANDARD"}, "size": {"$exists": True}, "brand": {"$exists": True}})


@query("SELECT p_partkey FROM part WHERE p_size = 7 AND p_partkey % 2 = 0")
def prop_typed(spark, sf):
    """A number never equals its text: of the sizes, those of odd parts are texts."""
    size = F.col("p_size")
    as_number, as_text = F.to_json(F.struct(size.alias("size"))), F.to_json(F.struct(size.cast("string").alias("size")))
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, as_number).otherwise(as_text).alias("props"))
    return rows.filter(predicates.match_props("props", {"size": 7}) & predicates.strictly("props", {"size": 7})).select("p_partkey")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_size IN (1, 3) ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def prop_query(spark, sf):
    """Conditions, newest first (here: dearest), a limit that is clamped."""
    rows = part_notes(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_partkey")
    return predicates.query_props(rows, "props", {"size": {"$in": [1, 3]}}, "p_retailprice", "p_partkey", 25).select("p_partkey", "p_retailprice")


@query("SELECT u.t AS tag, count(*) AS n FROM part, unnest(string_split(p_type, ' ')) AS u(t) GROUP BY 1 ORDER BY n DESC, tag LIMIT 10")
def top_tags(spark, sf):
    tags = part_notes(spark, sf).select(F.explode(F.from_json(predicates.prop("props", "tags"), "array<string>")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)


@query(bm25_sql("true"))
def fulltext_or_topk(spark, sf):
    return fulltext.search(table(spark, sf, "documents"), "the OR and OR license OR version", "doc_id", "text", 10)


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id FROM w WHERE (list_contains(ws, 'the') OR len(list_filter(ws, lambda x: starts_with(x, 'lic'))) > 0) AND NOT list_contains(ws, 'version')""")
def fulltext_boolean(spark, sf):
    return fulltext.matching(table(spark, sf, "documents"), "(the OR lic*) NOT version", "doc_id", "text").select("doc_id")


@query("""WITH n AS (SELECT c_custkey AS id, c_custkey % 5 AS folder, c_name FROM customer),
t AS (SELECT o_orderkey, o_custkey, o_orderkey % 4 AS how FROM orders)
SELECT o_orderkey, CASE WHEN how < 3 THEN o_custkey END AS resolved FROM t JOIN n ON n.id = t.o_custkey""")
def resolve_cascade(spark, sf):
    customer = table(spark, sf, "customer")
    path = F.concat((F.col("c_custkey") % 5).cast("string"), F.lit("/"), F.col("c_name"), F.lit(".md"))
    notes = customer.select(F.col("c_custkey").alias("id"), path.alias("path"), "c_name")
    aliases = notes.select("id", F.concat(F.lit("Customer no. "), F.col("id")).alias("alias"))
    how = F.col("o_orderkey") % 4
    target = F.when(how == 0, F.col("path")).when(how == 1, F.col("c_name")).when(how == 2, F.concat(F.lit(" customer NO. "), F.col("o_custkey"))).otherwise(F.lit("nowhere/at all"))
    links = table(spark, sf, "orders").join(notes, F.col("o_custkey") == F.col("id")).select("o_orderkey", target.alias("target"))
    return markdown.resolve(links, notes.drop("c_name"), aliases).select("o_orderkey", "resolved")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 7 = 0")
def missing_vectors(spark, sf):
    chunks = table(spark, sf, "embeddings").select("vec_id")
    return chunks.join(chunks.filter("vec_id % 7 <> 0"), "vec_id", "left_anti")


@query("SELECT label, count(*) AS kept, count(*) FILTER (vec_id % 11 = 0) AS removed FROM embeddings GROUP BY 1")
def vacuum_report(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "label")
    chunks = vectors.filter("vec_id % 11 <> 0").select("vec_id", F.lit(True).alias("there"))
    return vectors.join(chunks, "vec_id", "left").groupBy("label").agg(F.count("*").alias("kept"), F.count_if(F.col("there").isNull()).alias("removed"))


@query(f"""WITH {EDGES} SELECT dst AS node, 1 AS hop, min(src) AS seed, 'lives_in' AS type FROM edges WHERE src IN (1, 2, 3) GROUP BY dst""")
def expand_1hop(spark, sf):
    return graph.expand(foreign_edges(spark, sf), spark.range(1, 4).select(F.col("id").alias("seed")), 1, "forward").drop("rel")


@query("""WITH r AS (SELECT l_orderkey, l_linestatus, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rank FROM lineitem),
f AS (SELECT l_orderkey, min(rank) FILTER (l_returnflag = 'R' AND rank <= 3) AS first FROM r GROUP BY 1)
SELECT l_orderkey % 5 AS category, count(*) AS n, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM f GROUP BY 1""")
def mrr_at_k(spark, sf):
    from lodestack.operators.retrieval import ranked

    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice", "l_linenumber", "l_partkey")
    hits = ranked(rows, F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), partition=["l_orderkey"])
    first = hits.groupBy("l_orderkey").agg(F.min(F.when((F.col("l_returnflag") == "R") & (F.col("rank") <= 3), F.col("rank"))).alias("first"))
    return first.groupBy((F.col("l_orderkey") % 5).alias("category")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@query("SELECT event_type, list_sort(list(DISTINCT user_id % 10)) AS members, count(*) AS n FROM events GROUP BY 1")
def verb_members(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.array_sort(F.collect_set(F.col("user_id") % 10)).alias("members"), F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS notes, sum(n_chars)::BIGINT AS chars, max(doc_id) AS newest FROM documents GROUP BY ALL")
def collection_stats(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("notes"), F.sum("n_chars").alias("chars"), F.max("doc_id").alias("newest"))


@query(r"""WITH l AS (SELECT doc_id, string_split(lower(text), chr(10)) AS ls FROM documents), t AS (SELECT doc_id, u.i AS line, regexp_extract_all(ls[u.i], '[\p{L}\p{N}_-]+[^\p{L}\p{N}_-]*') AS ps FROM l, unnest(range(1, len(ls) + 1)) AS u(i)),
w AS (SELECT doc_id, line, ps[u.i] AS part, CASE WHEN u.i > 1 THEN ps[u.i - 1] END AS before FROM t, unnest(range(1, len(ps) + 1)) AS u(i)),
k AS (SELECT doc_id, line, before, regexp_replace(part, '[^\p{L}\p{N}_-]+$', '') AS word FROM w)
SELECT DISTINCT doc_id, line::INT AS line, CASE WHEN word = 'version' THEN 2 WHEN before = 'the ' THEN 3 ELSE 1 END::BIGINT AS target FROM k WHERE word IN ('license', 'version')""")
def mentions(spark, sf):
    """An edge for each line and target, outside code, headings and links."""
    names = spark.createDataFrame([(1, "License"), (2, "version"), (3, "the license"), (4, "and")], "target long, name string")
    rows = table(ship(spark), sf, "documents").select("doc_id", links.prose("text").alias("text"))
    return links.mention_edges(rows, names, "doc_id", "text")


@query(r"""WITH l AS (SELECT page_id, string_split('See [the page](' || url || '), or ' || url || '.' || chr(10) || html, chr(10)) AS ls FROM pages), t AS (SELECT page_id, u.i AS line, ls[u.i] AS t FROM l, unnest(range(1, len(ls) + 1)) AS u(i)),
f AS (SELECT page_id, line, list_concat(regexp_extract_all(t, '!?\[[^\]]*\]\((https?://[^\s)]+)\)', 1), regexp_extract_all(t, '(?:^|[^(\[a-zA-Z0-9])(https?://[^\s)\]]+)', 1)) AS urls FROM t)
SELECT page_id, line::INT AS line, v.url AS url FROM f, unnest(list_distinct(list_transform(urls, lambda x: rtrim(x, '.,;:!?')))) AS v(url)""")
def hyperlinks(spark, sf):
    text = F.concat(F.lit("See [the page]("), "url", F.lit("), or "), "url", F.lit(".\n"), "html")
    rows = table(ship(spark), sf, "pages").select("page_id", text.alias("text"))
    return links.hyperlinks(rows.select("page_id", links.prose("text").alias("text")), "page_id", "text")


@query("""SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'stale' WHEN o_orderdate < TIMESTAMP '1998-06-01' - INTERVAL 400 DAY THEN 'too_old' ELSE 'ok' END AS state
FROM orders WHERE o_orderstatus <> 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def brief_state(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("compiled_at"), (F.col("o_orderstatus") == "F").alias("superseded"), (F.col("o_orderpriority") == "1-URGENT").alias("stale"))
    return briefs.latest_briefs(rows, "o_custkey", "o_orderkey", F.expr("timestamp'1998-06-01'"), 400)


@query("""WITH b AS (SELECT l_orderkey AS k, l_linenumber AS name, l_linenumber * 10 AS low, l_linenumber * 10 + l_suppkey % 40 AS high FROM lineitem),
p AS (SELECT o_orderkey AS k, (o_custkey % 70)::INT AS point, o_totalprice AS score FROM orders),
e AS (SELECT k, point, score, name FROM p JOIN b USING (k) WHERE point BETWEEN low AND high QUALIFY row_number() OVER (PARTITION BY k, point ORDER BY high - low, name) = 1)
SELECT k, name, max(score) AS score, arg_max(point, score) AS point FROM e GROUP BY ALL ORDER BY score DESC, k, name LIMIT 20""")
def section_search(spark, sf):
    bands = table(spark, sf, "lineitem").selectExpr("l_orderkey as k", "l_linenumber as name", "l_linenumber * 10 as low", "l_linenumber * 10 + l_suppkey % 40 as high")
    hits = table(spark, sf, "orders").selectExpr("o_orderkey as k", "cast(o_custkey % 70 as int) as point", "o_totalprice as score")
    return briefs.section_hits(hits, bands, "k", "point", "low", "high", "name", 20)


@query("""WITH c AS (SELECT p_partkey AS note, 'brand' AS key, p_brand AS value, CASE WHEN p_size % 3 = 0 THEN 'neighbor' ELSE 'folder' END AS origin, p_size / 50.0 AS confidence FROM part
UNION ALL SELECT p_partkey, 'brand', 'other', 'content', 0.5 FROM part WHERE p_partkey % 6 = 0),
t AS (SELECT note, key, value, max(CASE WHEN origin = 'neighbor' THEN confidence * 0.6 ELSE confidence END) AS s FROM c GROUP BY ALL HAVING s >= 0.2)
SELECT note, key, value, round(s, 6)::DOUBLE AS confidence, CASE WHEN note % 4 = 0 AND value = 'other' THEN 'existing' WHEN note % 4 = 0 OR count(*) OVER (PARTITION BY note, key) > 1 THEN 'conflict' ELSE 'suggestion' END AS verdict FROM t""")
def property_suggestions(spark, sf):
    part = table(spark, sf, "part")
    origin = F.when(F.col("p_size") % 3 == 0, "neighbor").otherwise("folder")
    own = part.select(F.col("p_partkey").alias("note"), F.lit("brand").alias("key"), F.col("p_brand").alias("value"), origin.alias("origin"), (F.col("p_size") / 50.0).alias("confidence"))
    told = own.unionByName(part.filter("p_partkey % 6 = 0").selectExpr("p_partkey as note", "'brand' as key", "'other' as value", "'content' as origin", "0.5D as confidence"))
    present = part.filter("p_partkey % 4 = 0").selectExpr("p_partkey as note", "'brand' as key", "'other' as value")
    return briefs.suggest(told, present).withColumn("confidence", F.round("confidence", 6))
