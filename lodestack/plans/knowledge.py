"""Queries of edges, outlines, dossiers, profiles, records and edits over the driver's tables."""



import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as md
from lodestack.operators import assembly, edges, frontmatter, graph, memory, outline, predicates, profiles, records
from lodestack.plans.registry import EDGES, foreign_edges, query
from lodestack.runtime import ship, table


def typed_edges(spark, sf) -> DataFrame:
    """Edges of four kinds, some of them twice: orders as wikilinks, lines as mentions, priorities as roles, addresses as hyperlinks."""
    none = lambda kind: F.lit(None).cast(kind)
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    wiki = orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 50).alias("dst"), none("string").alias("target"), F.lit("wikilink").alias("type"), none("string").alias("rel"), F.lit(1).alias("line"))
    said = lines.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), none("string").alias("target"), F.lit("mention").alias("type"), none("string").alias("rel"), F.col("l_linenumber").alias("line"))
    refs = orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 5).alias("dst"), none("string").alias("target"), F.lit("frontmatter-ref").alias("type"), F.col("o_orderpriority").alias("rel"), none("int").alias("line"))
    web = table(spark, sf, "pages").select(F.col("page_id").alias("src"), none("bigint").alias("dst"), F.col("url").alias("target"), F.lit("hyperlink").alias("type"), none("string").alias("rel"), F.lit(1).alias("line"))
    return edges.union(wiki, said, refs, web, wiki)


TYPED = """t AS (SELECT DISTINCT * FROM (SELECT o_custkey AS src, o_orderkey % 50 AS dst, NULL::VARCHAR AS target, 'wikilink' AS type, NULL::VARCHAR AS rel, 1::INT AS line FROM orders
UNION ALL SELECT l_orderkey, l_partkey, NULL, 'mention', NULL, l_linenumber FROM lineitem UNION ALL SELECT o_custkey, o_orderkey % 5, NULL, 'frontmatter-ref', o_orderpriority, NULL FROM orders
UNION ALL SELECT page_id, NULL, url, 'hyperlink', NULL, 1 FROM pages))"""


@query(f"WITH {TYPED} SELECT type, count(*) AS n, count(DISTINCT src) AS sources, count(dst) AS resolved FROM t GROUP BY 1")
def edge_union(spark, sf):
    return typed_edges(spark, sf).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count("dst").alias("resolved"))


@query(f"WITH {TYPED} SELECT src, dst, type, rel, line FROM t WHERE type IN ('frontmatter-ref', 'hyperlink') AND rel IN ('1-URGENT', '5-LOW') ORDER BY src NULLS FIRST, dst NULLS FIRST, type, rel NULLS FIRST, line NULLS FIRST LIMIT 100")
def edges_by_role(spark, sf):
    rows = edges.chosen(typed_edges(spark, sf), ["frontmatter-ref", "hyperlink"], ["1-URGENT", "5-LOW"])
    return edges.in_order(rows, 100).select("src", "dst", "type", "rel", "line")


@query(f"WITH {TYPED} SELECT src, dst, type, rel, rel IS NOT NULL AND (src % 7 = 0 OR src % 11 = 0) AS stale FROM t")
def stale_relations(spark, sf):
    """Edges with a role count only while their declaring note is as it was indexed: here some changed and some went."""
    notes = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.md5("c_name").alias("hash"))
    current = notes.filter("id % 11 <> 0").withColumn("hash", F.when(F.col("id") % 7 == 0, F.lit("other")).otherwise(F.col("hash")))
    return edges.fresh(typed_edges(spark, sf), notes, current).select("src", "dst", "type", "rel", "stale")


@query(f"""WITH {EDGES}, f AS (SELECT DISTINCT src AS node, dst AS seed, type, 1 AS hop, dst AS via FROM edges WHERE dst IN (-1, -2)),
g AS (SELECT DISTINCT e.src AS node, f.seed, e.type, 2 AS hop, f.node AS via FROM f JOIN edges e ON e.dst = f.node), a AS (FROM f UNION ALL FROM g)
SELECT node, hop, seed, type FROM a WHERE NOT (via > 0 AND via % 2 = 0 AND node % 4 = 0) QUALIFY row_number() OVER (PARTITION BY node ORDER BY hop, seed, type) = 1""")
def expand_opaque(spark, sf):
    """Hidden nodes (here: every second customer, and every fourth order) count only where another node leads to them."""
    hidden = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")).unionByName(table(spark, sf, "orders").filter("(o_orderkey + 1000000000) % 4 = 0").select((F.col("o_orderkey") + 1_000_000_000).alias("id")))
    seeds = spark.createDataFrame([(-1,), (-2,)], "seed long")
    return graph.expand(foreign_edges(spark, sf), seeds, 2, "backward", hidden).select("node", "hop", "seed", "type")


@query(f"""WITH {EDGES}, n AS (SELECT id FROM (SELECT unnest([1, 2, 3, -1]) AS id UNION SELECT dst FROM edges WHERE src IN (1, 2, 3, -1) UNION SELECT src FROM edges WHERE dst IN (1, 2, 3, -1))),
p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))
SELECT id, (SELECT count(*) FROM p WHERE a = id OR b = id) AS degree FROM n""")
def cluster_input(spark, sf):
    """The nodes around some seeds, each with its links among them."""
    seeds = spark.createDataFrame([(1,), (2,), (3,), (-1,)], "seed long")
    rows = foreign_edges(spark, sf)
    nodes = edges.around(rows, seeds)
    degree = edges.simple(graph.induced(rows, nodes)).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


@query()
def cluster_around_seeds(spark, sf):
    """Clusters of suppliers and the parts that they ship, around the first suppliers."""
    ships = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst")).distinct()
    seeds = table(spark, sf, "supplier").orderBy("s_suppkey").limit(5).select(F.col("s_suppkey").alias("seed"))
    return edges.cluster(ships, seeds, force=True)


@query("""WITH e AS (SELECT c_custkey AS src, (c_custkey * 7 + 3) % 1000 AS dst FROM customer UNION ALL SELECT c_custkey, (c_custkey * 3 + 1) % 1000 FROM customer), c AS (SELECT c_custkey AS node, c_custkey % 23 AS cluster, c_name, c_mktsegment FROM customer),
p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst), i AS (SELECT a, b, x.cluster FROM p JOIN c x ON x.node = a JOIN c y ON y.node = b WHERE x.cluster = y.cluster),
d AS (SELECT cluster, node, count(i.a) AS degree, any_value(c_name) AS title FROM c LEFT JOIN (SELECT a, b, a AS n FROM i UNION ALL SELECT a, b, b FROM i) i ON i.n = node GROUP BY ALL),
t AS (SELECT * FROM (SELECT cluster, c_mktsegment AS k, count(*) AS n FROM c GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, k) <= 5),
h AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY degree DESC, node) <= 3), z AS (SELECT cluster, count(*) AS size FROM c GROUP BY 1)
SELECT cluster, size, round((SELECT count(*) FROM i WHERE i.cluster = z.cluster) / (size * (size - 1) / 2.0), 9) AS density,
 (SELECT string_agg(k || ':' || n, ',' ORDER BY n DESC, k) FROM t WHERE t.cluster = z.cluster) AS types, (SELECT string_agg(title || ':' || degree, ',' ORDER BY degree DESC, node) FROM h WHERE h.cluster = z.cluster) AS titles FROM z""")
def cluster_summary(spark, sf):
    customer = table(spark, sf, "customer")
    key = F.col("c_custkey")
    links = customer.select(key.alias("src"), ((key * 7 + 3) % 1000).alias("dst")).unionByName(customer.select(key.alias("src"), ((key * 3 + 1) % 1000).alias("dst")))
    members = customer.select(key.alias("node"), (key % 23).alias("cluster"))
    told = edges.summaries(members, links, customer.select(key.alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("type")))
    flat = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit(":"), x[b].cast("string"))), ",").alias(c)
    return told.select("cluster", "size", "density", flat("types", "kind", "n"), flat("titles", "title", "degree"))


SECTIONS = """s AS (SELECT l_orderkey AS note, l_linenumber::BIGINT AS id, CASE WHEN l_linenumber > 1 THEN l_linenumber // 2 END::BIGINT AS parent, l_linenumber * 10 AS pos, l_linenumber * 4 AS low, l_linenumber * 4 + l_suppkey % 9 AS high FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey))"""


def sections(spark, sf) -> DataFrame:
    """Lines of an order as sections of a note: a heap-shaped tree, with ranges that overlap."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by("l_suppkey", F.struct("l_partkey", "l_suppkey")).alias("l_suppkey"))
    return lines.selectExpr("l_orderkey as note", "cast(l_linenumber as bigint) as id", "cast(if(l_linenumber > 1, l_linenumber div 2, null) as bigint) as parent", "l_linenumber * 10 as pos", "l_linenumber * 4 as low", "l_linenumber * 4 + l_suppkey % 9 as high")


@query(f"""WITH {SECTIONS}, c AS (SELECT o_orderkey AS note, u.i * 5 + o_custkey % 5 AS chunk FROM orders, unnest(range(0, 6)) AS u(i))
SELECT note, id, parent, row_number() OVER (PARTITION BY note, parent ORDER BY pos, id)::INT - 1 AS ord, coalesce((SELECT string_agg(chunk, ',' ORDER BY chunk) FROM c WHERE c.note = s.note AND chunk BETWEEN low AND high), '') AS chunks FROM s""")
def outline_tree(spark, sf):
    chunks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("note"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: i * 5 + F.col("o_custkey") % 5)).alias("chunk"))
    rows = outline.outline(sections(spark, sf), chunks)
    return rows.select("note", "id", "parent", "ord", F.array_join(F.transform("chunks", lambda c: c.cast("string")), ",").alias("chunks"))


@query(f"""WITH {SECTIONS}, p AS (SELECT o_orderkey AS note, o_custkey % 40 AS point FROM orders)
SELECT note, point, (SELECT max(id) FROM s WHERE s.note = p.note AND point BETWEEN low AND high) AS section FROM p""")
def chunk_section(spark, sf):
    """The deepest section, the last by its place, that holds the start of a chunk."""
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("note"), (F.col("o_custkey") % 40).alias("point"))
    return outline.deepest(points, sections(spark, sf), "point", F.col("pos")).select("note", "point", "section")


@query(f"""WITH {SECTIONS}, p AS (SELECT o_orderkey AS note, o_custkey % 40 AS line FROM orders)
SELECT note, line, (SELECT arg_max(id, id * 1000 + pos) FROM s WHERE s.note = p.note AND line BETWEEN low AND high) AS section FROM p""")
def statement_heading(spark, sf):
    """The heading with the longest path over a statement's line."""
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("note"), (F.col("o_custkey") % 40).alias("line"))
    return outline.deepest(points, sections(spark, sf), "line", F.col("id")).select("note", "line", "section")


@query(f"""WITH {EDGES}, n AS (SELECT c_custkey AS id, c_name AS title FROM customer UNION ALL SELECT -1 - n_nationkey, n_name FROM nation UNION ALL SELECT o_orderkey + 1000000000, 'Order ' || o_orderkey FROM orders)
SELECT DISTINCT 'back' AS part, src AS other, title, type FROM edges JOIN n ON n.id = src WHERE dst = 7 UNION ALL SELECT DISTINCT 'forward', dst, title, type FROM edges LEFT JOIN n ON n.id = dst WHERE src = 7
UNION ALL SELECT 'edit', * FROM (SELECT event_id, event_type, NULL::VARCHAR FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 10) UNION ALL SELECT 'anchor', 7, (SELECT c_name FROM customer WHERE c_custkey = 7), (SELECT left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 200) FROM documents WHERE doc_id = 7)""")
def document_bundle(spark, sf):
    """All that belongs to one note: anchor with a snippet, links in both directions, its latest edits."""
    customer, docs = table(spark, sf, "customer"), table(spark, sf, "documents")
    named = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")).join(docs.select(F.col("doc_id").alias("id"), "text"), "id", "left")
    others = table(spark, sf, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("id"), F.col("n_name").alias("title"), F.lit("").alias("text"))
    orders = table(spark, sf, "orders").select((F.col("o_orderkey") + 1_000_000_000).alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.lit("").alias("text"))
    audit = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("note"), F.col("event_type").alias("op"), F.col("ts").alias("at"))
    chunks = docs.select(F.col("doc_id").alias("note"), F.lit(0).alias("chunk"))
    parts = outline.bundle(7, named.unionByName(others).unionByName(orders), sections(spark, sf), chunks, foreign_edges(spark, sf).withColumn("target", F.lit(None).cast("string")), audit)
    row = lambda name, other, title, kind: parts[name].select(F.lit({"backlinks": "back", "forward": "forward", "edits": "edit", "anchor": "anchor"}[name]).alias("part"), F.col(other).alias("other"), F.col(title).alias("title"), kind.alias("type"))
    return row("backlinks", "src", "title", F.col("type")).unionByName(row("forward", "dst", "title", F.col("type"))).unionByName(row("edits", "id", "op", F.lit(None).cast("string"))).unionByName(row("anchor", "id", "title", F.col("snippet")))


@query(f"""WITH {EDGES}, n AS (SELECT c_custkey AS id, c_mktsegment AS type, 'Name ' || (c_custkey % 400) AS title, 'alias ' || (c_custkey % 300) AS alias FROM customer), q AS (SELECT DISTINCT c_mktsegment AS type, unnest(['Name 3', 'alias 250', 'nobody']) AS key FROM customer),
m AS (SELECT type, key, id, title FROM q JOIN n USING (type) WHERE title = key OR alias = key QUALIFY row_number() OVER (PARTITION BY type, key ORDER BY title, id) = 1),
k AS (SELECT id, o_orderstatus AS t, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'superseded' END, 'unknown') AS s FROM (SELECT DISTINCT src, dst AS id FROM edges WHERE type = 'placed') JOIN orders ON o_orderkey + 1000000000 = src)
SELECT q.type, q.key, m.id, CASE WHEN m.id IS NULL THEN 'no_anchor' END AS error, (SELECT count(*) FROM k WHERE k.id = m.id) AS linked,
 (SELECT string_agg(t || ':' || n, ',' ORDER BY t) FROM (SELECT t, count(*) AS n FROM k WHERE k.id = m.id GROUP BY t)) AS types, (SELECT string_agg(s || ':' || n, ',' ORDER BY s) FROM (SELECT s, count(*) AS n FROM k WHERE k.id = m.id GROUP BY s)) AS statuses
FROM q LEFT JOIN m USING (type, key)""")
def dossier(spark, sf):
    """Subjects by exact type and name or alias, with all that links to them, superseded ones included."""
    customer, number = table(spark, sf, "customer"), F.col("c_custkey")
    notes = customer.select(number.alias("id"), F.col("c_mktsegment").alias("type"), F.concat(F.lit("Name "), number % 400).alias("title"), F.array(F.concat(F.lit("alias "), number % 300)).alias("aliases"))
    asked = customer.select(F.col("c_mktsegment").alias("type")).distinct().withColumn("key", F.explode(F.array(*[F.lit(k) for k in ("Name 3", "alias 250", "nobody")])))
    orders = table(spark, sf, "orders").select((F.col("o_orderkey") + 1_000_000_000).alias("id"), F.col("o_orderstatus").alias("type"), F.when(F.col("o_orderkey") % 3 == 0, "superseded").alias("status"))
    out = outline.dossier(outline.anchors(notes, asked), foreign_edges(spark, sf).filter("type = 'placed'"), orders)
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["value"], F.lit(":"), x["n"].cast("string"))), ",").alias(c)
    return out.select("type", "key", "id", "error", "linked", flat("types"), flat("statuss").alias("statuses"))


def mixed_notes(spark, sf) -> DataFrame:
    """Parts as notes whose properties have several types: size as a number, a text or null, tags as a list or missing."""
    n, size = F.col("p_partkey"), F.col("p_size")
    shape = F.when(n % 3 == 0, F.concat(F.lit('{"size":'), size, F.lit(',"brand":"'), "p_brand", F.lit('"}')))
    shape = shape.when(n % 3 == 1, F.concat(F.lit('{"size":"'), size, F.lit('","brand":"'), "p_brand", F.lit('","tags":["'), "p_type", F.lit('"]}')))
    shape = shape.when(n % 5 == 0, F.lit("not json")).otherwise(F.concat(F.lit('{"size":null,"ok":'), (n % 2 == 0).cast("string"), F.lit("}")))
    return table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", shape.alias("props"))


MIXED = """n AS (SELECT p_partkey, p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN '{"size":' || p_size || ',"brand":"' || p_brand || '"}' WHEN p_partkey % 3 = 1 THEN '{"size":"' || p_size || '","brand":"' || p_brand || '","tags":["' || p_type || '"]}'
 WHEN p_partkey % 5 = 0 THEN 'not json' ELSE '{"size":null,"ok":' || (p_partkey % 2 = 0) || '}' END AS props FROM part),
f AS (SELECT p_partkey, u.k AS field, lower(json_type(props, '$.' || u.k)) AS kind FROM n, unnest(json_keys(CASE WHEN json_valid(props) THEN props ELSE '{}' END)) AS u(k)),
g AS (SELECT p_partkey, field, CASE WHEN kind IN ('ubigint', 'bigint', 'double') THEN 'number' WHEN kind = 'varchar' THEN 'string' ELSE kind END AS kind FROM f)"""


@query(f"""WITH {MIXED} SELECT field, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types, count(DISTINCT p_partkey) AS present, (SELECT count(*) FROM part) AS total FROM g GROUP BY 1""")
def field_profile(spark, sf):
    return profiles.fields(mixed_notes(spark, sf), "p_partkey", "props").select("field", F.array_join("types", ",").alias("types"), "present", "total")


@query("""SELECT u.t AS value, count(DISTINCT p_partkey) AS present, (SELECT count(*) FROM part) AS total FROM part, unnest(string_split(p_name, ' ')) AS u(t) GROUP BY 1""")
def value_profile(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    total = table(spark, sf, "part").agg(F.count("*").alias("total"))
    return profiles.values(part, "p_partkey", "word", 0).drop("total").join(F.broadcast(total))  # one row


@query(f"""WITH {MIXED}, e(field, types, required) AS (VALUES ('size', ['number'], true), ('brand', ['string'], true), ('tags', ['array'], false))
SELECT n.p_partkey, e.field, 'missing_required' AS code, 'error' AS level FROM n, e WHERE required AND NOT EXISTS (SELECT 1 FROM g WHERE g.p_partkey = n.p_partkey AND g.field = e.field)
UNION ALL SELECT p_partkey, g.field, 'invalid_type', 'error' FROM g JOIN e USING (field) WHERE NOT list_contains(types, kind) UNION ALL SELECT p_partkey, field, 'unexpected_field', 'warning' FROM g WHERE field NOT IN ('size', 'brand', 'tags')""")
def schema_inspect(spark, sf):
    return profiles.inspect(mixed_notes(spark, sf), "p_partkey", "props", [("size", ["number"], True), ("brand", ["string"], True), ("tags", ["array"], False)])


@query(f"""WITH {MIXED}, a AS (SELECT field, string_agg(DISTINCT kind, ',' ORDER BY kind) AS want FROM g WHERE p_partkey % 3 = 0 GROUP BY 1), b AS (SELECT field, string_agg(DISTINCT kind, ',' ORDER BY kind) AS have FROM g WHERE p_partkey % 3 = 1 AND field <> 'brand' GROUP BY 1)
SELECT coalesce(a.field, b.field) AS field, CASE WHEN have IS NULL THEN 'missing' WHEN want IS NULL THEN 'unexpected' ELSE 'type_changed' END AS issue FROM a FULL JOIN b ON a.field = b.field WHERE want IS DISTINCT FROM have""")
def schema_drift(spark, sf):
    """What the fields of some notes are, against those of others."""
    notes = mixed_notes(spark, sf)
    shape = lambda rows: profiles.fields(rows, "p_partkey", "props").select("field", F.array_join("types", ",").alias("kind"))
    return assembly.drift(shape(notes.filter("p_partkey % 3 = 0")), shape(notes.filter("p_partkey % 3 = 1")).filter("field <> 'brand'"))


@query("""WITH e AS (SELECT c_custkey AS src, (c_custkey * 7 + 3) % 1000 AS dst FROM customer), o AS (SELECT dst AS note, src AS other FROM e UNION SELECT src, dst FROM e), x AS (SELECT DISTINCT note, other FROM o WHERE note <> other AND note % 2 = 0 AND note IN (SELECT c_custkey FROM customer)),
p AS (SELECT c_custkey AS other, 'segment' AS key, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR FROM customer WHERE c_custkey % 3 <> 0),
c AS (SELECT note, key, value, count(*) AS n FROM x JOIN p USING (other) GROUP BY ALL), t AS (SELECT note, key, sum(n)::BIGINT AS present, max(n) AS top, arg_max(value, {n: n, v: value}) AS v FROM c GROUP BY ALL)
SELECT note, key, present, round(present / (SELECT count(*) FROM x WHERE x.note = t.note), 6) AS prevalence, CASE WHEN top / present > 0.5 THEN v END AS dominant FROM t""")
def neighbour_inference(spark, sf):
    customer, key = table(spark, sf, "customer"), F.col("c_custkey")
    links = customer.select(key.alias("src"), ((key * 7 + 3) % 1000).alias("dst"))
    props = customer.select(key.alias("note"), F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value")).unionByName(customer.filter("c_custkey % 3 <> 0").select(key.alias("note"), F.lit("nation").alias("key"), F.col("c_nationkey").cast("string").alias("value")))
    return profiles.from_neighbours(customer.filter("c_custkey % 2 = 0").select(key.alias("note")), links, props)


@query(r"""WITH n AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'Re: offer' WHEN 1 THEN '2024-03-0' || (c_custkey % 9 + 1) || ' Team Meeting' WHEN 2 THEN 'Anna Meyer' WHEN 3 THEN 'Plan' ELSE c_name END AS title,
 CASE c_custkey % 4 WHEN 0 THEN 'Attendees: a, b' || chr(10) || repeat('long text ', 30) WHEN 1 THEN 'Write to a.b@example.org.' WHEN 2 THEN 'source: https://example.org/x' || chr(10) || chr(10) || 'text' ELSE repeat('words and words ', 20) END AS body FROM customer)
SELECT id AS note, 'class' AS key, '"Email"' AS value, 0.85::DOUBLE AS confidence, 'email' AS rule FROM n WHERE title LIKE 'Re: %' UNION ALL SELECT id, 'type', '"email"', 0.85, 'email' FROM n WHERE title LIKE 'Re: %'
UNION ALL SELECT id, unnest(['class', 'type']), unnest(['"Meeting"', '"meeting"']), CASE WHEN body LIKE 'Attendees:%' THEN 0.85 ELSE 0.7 END, 'meeting' FROM n WHERE title LIKE '%Meeting'
UNION ALL SELECT id, unnest(['class', 'type', 'participation']), unnest(['"Person"', '"person"', '[]']), unnest([0.85, 0.85, 0.5]), 'person' FROM n WHERE title IN ('Anna Meyer', 'Plan') AND body LIKE '%@%'
UNION ALL SELECT id, unnest(['class', 'tags']), unnest(['"Clipping"', '["clippings"]']), 0.7, 'clipping' FROM n WHERE body LIKE 'source:%' UNION ALL SELECT id, 'class', '"Fact"', 0.5, 'fact' FROM n WHERE body LIKE 'Write to%'
UNION ALL SELECT id, 'created', '"' || left(title, 10) || '"', 0.85, 'date' FROM n WHERE title LIKE '2024-%'""")
def content_heuristics(spark, sf):
    key = F.col("c_custkey")
    title = F.when(key % 6 == 0, "Re: offer").when(key % 6 == 1, F.concat(F.lit("2024-03-0"), key % 9 + 1, F.lit(" Team Meeting"))).when(key % 6 == 2, "Anna Meyer").when(key % 6 == 3, "Plan").otherwise(F.col("c_name"))
    body = F.when(key % 4 == 0, F.concat(F.lit("Attendees: a, b\n"), F.repeat(F.lit("long text "), F.lit(30)))).when(key % 4 == 1, "Write to a.b@example.org.").when(key % 4 == 2, "source: https://example.org/x\n\ntext").otherwise(F.repeat(F.lit("words and words "), F.lit(20)))
    return profiles.from_content(table(spark, sf, "customer").select("c_custkey", title.alias("title"), body.alias("body")), "c_custkey", "title", "body")


@query("""SELECT p_brand AS note, p_name AS key, p_size::VARCHAR AS value, p_size / 50.0::DOUBLE AS confidence, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, lower(p_name), p_name, p_size::VARCHAR)::INT AS place FROM (SELECT DISTINCT p_brand, p_name, p_size FROM part)""")
def suggestion_order(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("note"), F.col("p_name").alias("key"), F.col("p_size").cast("string").alias("value"), (F.col("p_size") / 50.0).alias("confidence")).distinct()
    return profiles.ranked(rows)


CONVERSATION = "m AS (SELECT CASE WHEN conv_id % 10 = 9 THEN '' ELSE 'driver' END AS provider, conv_id::VARCHAR AS external_id, CASE WHEN conv_id % 8 = 3 THEN (turn // 2)::VARCHAR ELSE turn::VARCHAR END AS id, turn AS pos, CASE WHEN conv_id % 7 = 5 AND turn = 1 THEN 'robot' ELSE role END AS role, text, CASE WHEN conv_id % 6 = 1 THEN '2024-02-30T10:00:00Z' WHEN conv_id % 6 = 2 THEN '2024-02-28T10:00:00Z' END AS told FROM conversations)"


def messages(spark, sf) -> DataFrame:
    """Conversations as an import, some of them broken: no provider, a message twice, an unknown role, a day that doesn't exist."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf, "conversations").select(
        F.when(conv % 10 == 9, "").otherwise("driver").alias("provider"), conv.cast("string").alias("external_id"), F.when(conv % 8 == 3, F.floor(turn / 2)).otherwise(turn).cast("string").alias("id"), turn.alias("pos"),
        F.when((conv % 7 == 5) & (turn == 1), "robot").otherwise(F.col("role")).alias("role"), "text", F.when(conv % 6 == 1, "2024-02-30T10:00:00Z").when(conv % 6 == 2, "2024-02-28T10:00:00Z").alias("at"),
    )


@query(f"""WITH {CONVERSATION}, p AS (SELECT provider, external_id, min(CASE WHEN provider = '' THEN 'identity' WHEN role = 'robot' THEN 'role' WHEN told LIKE '2024-02-30%' THEN 'time' END) AS own, count(*) AS n, count(DISTINCT id) AS ids FROM m GROUP BY ALL)
SELECT external_id, n AS messages, coalesce(own, CASE WHEN n > ids THEN 'duplicate_message' END) AS error FROM p""")
def import_check(spark, sf):
    return records.checked_messages(messages(spark, sf)).groupBy("external_id").agg(F.count("*").alias("messages"), F.first("error").alias("error"))


@query(f"""WITH {CONVERSATION} SELECT provider, external_id, '# Conversation ' || external_id || chr(10) || string_agg(chr(10) || '## ' || id || ' · ' || role || chr(10) || chr(10) || CASE WHEN told IS NULL THEN '' ELSE 'Time: ' || told || chr(10) || chr(10) END || text || chr(10), '' ORDER BY pos) AS markdown FROM m GROUP BY provider, external_id""")
def import_render(spark, sf):
    return records.rendered(messages(spark, sf))


@query(f"""WITH {CONVERSATION}, r AS (SELECT provider, external_id, '# Conversation ' || external_id || chr(10) || string_agg(chr(10) || '## ' || id || ' · ' || role || chr(10) || chr(10) || CASE WHEN told IS NULL THEN '' ELSE 'Time: ' || told || chr(10) || chr(10) END || text || chr(10), '' ORDER BY pos) AS markdown FROM m GROUP BY provider, external_id),
i AS (SELECT *, sha256('["' || provider || '","' || external_id || '"]') AS identity FROM r)
SELECT provider, external_id, 'conversation:' || identity AS source_id, 'sha256:' || sha256(markdown) AS hash, 'store://main/chats/conversation-' || identity || '.md' AS target FROM i""")
def import_preview_full(spark, sf):
    """What an import would write: identity, content hash and target path."""
    return records.previews(messages(spark, sf), "store://main/chats/").drop("markdown")


@query("""WITH s AS (SELECT DISTINCT conv_id FROM conversations), x AS (SELECT conv_id, CASE WHEN conv_id % 9 = 0 THEN '_memory/' || conv_id ELSE 'imports/' || conv_id END AS path, conv_id % 2 = 0 AS there, conv_id % 4 = 0 AS same, conv_id % 5 = 0 AS other, conv_id % 3 = 0 AS wrong FROM s)
SELECT path, CASE WHEN conv_id % 9 = 0 THEN 'refused: non_agent_write_inside_sink' WHEN NOT there AND wrong THEN 'refused: not_found' WHEN NOT there THEN 'written' WHEN other THEN 'refused: import_identity_mismatch' WHEN same THEN 'reused' WHEN wrong THEN 'refused: hash_mismatch' ELSE 'replaced' END AS action FROM x""")
def import_commit(spark, sf):
    conv = F.col("conv_id")
    path = F.when(conv % 9 == 0, F.concat(F.lit("_memory/"), conv)).otherwise(F.concat(F.lit("imports/"), conv))
    every = table(spark, sf, "conversations").select("conv_id", path.alias("path")).distinct()
    expected = F.when(conv % 2 == 0, F.when(conv % 3 == 0, F.lit("stale")).otherwise(F.lit("now"))).otherwise(F.when(conv % 3 == 0, F.lit("now")))
    staged = every.select("path", conv.cast("string").alias("identity"), F.lit("h1").alias("hash"), expected.alias("expected"))
    existing = every.filter("conv_id % 2 = 0").select("path", F.when(conv % 5 == 0, "else").otherwise(conv.cast("string")).alias("identity"), F.when(conv % 4 == 0, "h1").otherwise("h0").alias("import_hash"), F.lit("now").alias("hash"), F.lit(True).alias("intact"))
    return records.import_actions(staged, existing, ["_memory/"])


@query("""WITH c AS (SELECT conv_id, max(text) FILTER (turn = 0) || chr(10) || chr(10) || max(text) FILTER (turn = 1) AS said, count(*) FILTER (turn IN (0, 1)) AS n FROM conversations GROUP BY 1)
SELECT conv_id AS promotion, CASE WHEN e IS NULL THEN CASE WHEN conv_id % 2 = 0 THEN 'direct' ELSE 'inferred' END END AS confidence, CASE WHEN e IS NULL THEN conv_id || '#0,' || conv_id || '#1' END AS evidence, e AS error
FROM (SELECT *, CASE WHEN conv_id % 7 = 0 THEN 'hash_mismatch' WHEN n < 2 THEN 'message_not_found' WHEN conv_id % 2 = 0 AND conv_id % 3 = 0 THEN 'quote_mismatch' END AS e FROM c)""")
def conversation_promotion(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").cast("string").alias("id"), "text", F.when(F.col("conv_id") % 7 == 0, "new").otherwise("old").alias("hash"))
    conv = F.col("conv")
    pick = lambda t: F.max(F.when(F.col("id") == t, F.col("text")))
    said = rows.groupBy("conv").agg(F.concat(pick("0"), F.lit("\n\n"), pick("1")).alias("said"))
    claim = F.when(conv % 3 == 0, "something else").otherwise(F.coalesce("said", F.lit("x")))
    asked = said.select(conv.alias("promotion"), "conv", F.lit("old").alias("hash"), F.when(conv % 2 == 0, "quote").otherwise("inference").alias("mode"), claim.alias("claim"), F.array(F.lit("0"), F.lit("1")).alias("ids"))
    return records.promote(asked, rows).select("promotion", "confidence", F.array_join("evidence", ",").alias("evidence"), "error")


@query("""WITH c AS (SELECT c_custkey, c_name, DATE '2024-01-01' + (c_custkey % 30)::INT AS day FROM customer), t AS (SELECT c_custkey, c_name, day, u.a AS a, '_memory/' || strftime(day, '%Y-%m-%d') || '-' || replace(lower(c_name), '#', '-') || '-' || left(sha256(c_name || chr(10) || strftime(day, '%Y-%m-%d %H:%M:%S') || chr(10) || u.a), 6) || '.md' AS path FROM c, unnest([0, 1, 2]) AS u(a))
SELECT c_name AS claim, arg_min(path, a) FILTER (NOT (c_custkey % 4 = 0 AND a = 0)) AS path FROM t GROUP BY ALL""")
def observation_paths(spark, sf):
    """Paths of new observations: the first attempt that isn't taken."""
    claims = table(ship(spark), sf, "customer").select("c_custkey", F.col("c_name").alias("claim"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 30).cast("int")).cast("timestamp").alias("observed_at"))
    taken = records.record_paths(claims.filter("c_custkey % 4 = 0").select("claim", "observed_at"), claims.limit(0).select(F.col("claim").alias("path")), "_memory/")
    return records.record_paths(claims.select("claim", "observed_at"), taken, "_memory/").select("claim", "path")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'superseded' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey + 1 END AS superseded_by, CASE WHEN o_orderkey % 6 = 0 THEN 'newer' END AS superseded_reason FROM orders""")
def supersede(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey as id", "o_orderstatus as status", "cast(null as bigint) as superseded_by", "cast(null as string) as superseded_reason")
    return records.supersede(rows, rows.filter("id % 6 = 0").selectExpr("id", "id + 1 as by", "'newer' as reason"))


@query("""WITH s AS (SELECT o_custkey AS brief, o_orderkey AS id, 'Order ' || o_orderkey AS title FROM orders), m AS (SELECT * FROM s WHERE id % 3 <> 0 AND id % 5 <> 0)
SELECT brief, chr(10) || chr(10) || '## Sources' || chr(10) || string_agg('- [[' || title || ']]', chr(10) ORDER BY id) || chr(10) AS footer FROM m GROUP BY 1""")
def brief_citations(spark, sf):
    """What a brief's body has to list yet: sources that it cites neither by title nor by id."""
    sources = table(spark, sf, "orders").selectExpr("o_custkey as brief", "o_orderkey as id")
    titles = sources.select("id", F.concat(F.lit("Order "), "id").alias("title"))
    cited = sources.filter("id % 3 = 0").select("brief", F.concat(F.lit(" Order "), "id").alias("target")).unionByName(sources.filter("id % 5 = 0").select("brief", F.col("id").cast("string").alias("target")))
    return records.footer(records.missing_citations(sources, cited, titles))


@query("""WITH a AS (SELECT DISTINCT o_custkey % 300 AS brief, o_custkey AS id FROM orders UNION SELECT 999, c_custkey FROM customer WHERE c_custkey < 60 UNION SELECT 998, -1), n AS (SELECT c_custkey AS id, c_custkey % 300 // 100 AS vault, md5(c_name) AS hash FROM customer),
p AS (SELECT brief, count(*) AS c, count(hash) AS h, count(DISTINCT vault) AS v FROM a LEFT JOIN n USING (id) GROUP BY 1) SELECT brief, CASE WHEN c > 50 THEN 'too_many_sources' WHEN h < c THEN 'source_not_found' WHEN v > 1 THEN 'sources_of_several_vaults' END AS error,
 CASE WHEN c <= 50 AND h = c AND v <= 1 THEN (SELECT string_agg(id || '=' || hash, ',' ORDER BY id) FROM a JOIN n USING (id) WHERE a.brief = p.brief) END AS hashes FROM p""")
def brief_compile(spark, sf):
    orders = table(spark, sf, "orders").selectExpr("o_custkey % 300 as brief", "o_custkey as id")
    customer = table(spark, sf, "customer")
    asked = orders.unionByName(customer.filter("c_custkey < 60").selectExpr("999L as brief", "c_custkey as id")).unionByName(spark.createDataFrame([(998, -1)], "brief long, id long"))
    out = records.compile_briefs(asked, customer.selectExpr("c_custkey as id", "c_custkey % 300 div 100 as vault", "md5(c_name) as hash"))
    pairs = F.transform(F.array_sort(F.map_entries("hashes")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return out.select("brief", "error", F.when(F.col("error").isNull(), F.array_join(pairs, ",")).alias("hashes"))


@query("""SELECT o_orderkey AS brief, o_orderstatus AS status, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS sources, floor(date_diff('second', o_orderdate, TIMESTAMP '2000-01-01 06:00:00') / 86400)::BIGINT AS age_days FROM orders""")
def brief_list(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("brief"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("compiled_at"))
    sources = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("brief"), F.col("l_partkey").alias("id"))
    return records.brief_list(orders, sources, F.expr("timestamp'2000-01-01 06:00:00'"))


@query("SELECT DISTINCT l_orderkey AS brief FROM lineitem")
def brief_ids(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("brief")).distinct()


@query("""SELECT event_id, CASE WHEN event_id % 6 = 1 THEN 'invalid' WHEN event_id % 4 = 0 AND event_id % 3 = 0 THEN 'mismatch' WHEN event_id % 4 = 0 THEN 'reused' ELSE 'recorded' END AS verdict FROM events""")
def session_checkpoints(spark, sf):
    """Checkpoints by session and event: repeated ones are reused, changed ones refused."""
    number = F.col("event_id")
    shape = lambda summary: table(spark, sf, "events").select("event_id", F.concat(F.lit("s"), "user_id").alias("session"), number.cast("string").alias("event"), summary.alias("summary"), F.array(F.col("event_type")).alias("evidence"), F.lit("2024-01-01T00:00:00Z").alias("observed_at"))
    kept = records.checkpoints(spark.createDataFrame([], "key string, payload string"), shape(F.lit("done")).filter("event_id % 4 = 0")).select("key", "payload")
    now = shape(F.when(number % 6 == 1, " ").when((number % 4 == 0) & (number % 3 == 0), "changed").otherwise("done"))
    return records.checkpoints(kept, now).select(F.col("event").cast("long").alias("event_id"), "verdict")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 14 = 0 THEN 'changed' ELSE 'current' END AS state FROM documents""")
def session_sources(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    return records.verified_sources(docs, docs.filter("id % 9 <> 0").withColumn("hash", F.when(F.col("id") % 14 == 0, "x").otherwise(F.col("hash"))))


def log(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("n"), "user_id").alias("note"), F.col("event_type").alias("op"), F.col("ts").alias("at"), (F.col("value") > 50).alias("sink"))


@query("""SELECT event_id AS id, 'n' || user_id AS note, event_type AS op FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-02' AND value > 50 ORDER BY event_id DESC LIMIT 50""")
def audit_filter(spark, sf):
    return records.audit(log(spark, sf), op="click", since=F.expr("timestamp'2024-01-02'"), in_sink=True).select("id", "note", "op")


@query("""SELECT 's' || (user_id % 4) AS sink, max(ts) AS last_write FROM events WHERE user_id % 4 < 3 GROUP BY 1""")
def memory_last_write(spark, sf):
    rows = table(spark, sf, "events").select(F.concat(F.lit("_memory/s"), F.col("user_id") % 4, F.lit("/"), "event_id").alias("path"), F.col("ts").alias("at"))
    sinks = spark.createDataFrame([(f"s{i}", f"_memory/s{i}/") for i in range(3)], "sink string, prefix string")
    notes = rows.select("path", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("status"))
    return records.memory_stats(notes, rows, sinks).select("sink", "last_write")


@query("""WITH r AS (SELECT 's' || (user_id % 4) AS sink, event_type AS t, CASE WHEN value > 50 THEN 'active' END AS s, ts FROM events WHERE user_id % 4 < 3)
SELECT z.sink, (SELECT count(*) FROM r WHERE r.sink = z.sink) AS records, (SELECT string_agg(t || ':' || n, ',' ORDER BY t) FROM (SELECT t, count(*) AS n FROM r WHERE r.sink = z.sink GROUP BY 1)) AS types, (SELECT string_agg(s || ':' || n, ',' ORDER BY s) FROM (SELECT s, count(*) AS n FROM r WHERE r.sink = z.sink AND s IS NOT NULL GROUP BY 1)) AS statuses FROM (SELECT unnest(['s0', 's1', 's2', 'none']) AS sink) z""")
def memory_stats(spark, sf):
    rows = table(spark, sf, "events").select(F.concat(F.lit("_memory/s"), F.col("user_id") % 4, F.lit("/"), "event_id").alias("path"), F.col("event_type").alias("type"), F.when(F.col("value") > 50, "active").alias("status"), F.col("ts").alias("at"))
    sinks = spark.createDataFrame([(f"s{i}", f"_memory/s{i}/") for i in range(3)] + [("none", "_memory/none/")], "sink string, prefix string")
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["value"], F.lit(":"), x["n"].cast("string"))), ",").alias(c)
    return records.memory_stats(rows.drop("at"), rows.select("path", "at"), sinks).select("sink", "records", flat("types"), flat("statuses"))


@query("""SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN 'old/' || user_id ELSE 'new/' || user_id END AS path FROM events""")
def migration_heal(spark, sf):
    """The paths of a log after notes moved; a note that is gone keeps the last that is known."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("note"), F.concat(F.lit("old/"), "user_id").alias("path"))
    notes = rows.select("note").distinct().filter("note % 3 <> 0").select(F.col("note").alias("id"), F.concat(F.lit("new/"), "note").alias("path"))
    return records.healed(rows, notes).select("id", "path")


@query("""SELECT p_partkey, '{"brand":"X","new":{"a":1},"tags":["' || replace(p_type, ' ', '","') || '","more"]}' AS props, 'brand:set,size:unset,tags:push,new:set' AS diff FROM part""")
def properties_edited(spark, sf):
    props = F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.split("p_type", " ").alias("tags")))
    merge = {"brand": "X", "size": {"$unset": True}, "tags": {"$push": "more"}, "none": {"$unset": True}, "new": {"a": 1}, "gone": {"$pull": 1}}
    out = table(ship(spark), sf, "part").select("p_partkey", frontmatter.edited(props, merge).alias("e"))
    return out.select("p_partkey", "e.props", F.array_join(F.transform("e.diff", lambda d: F.concat(d["key"], F.lit(":"), d["op"])), ",").alias("diff"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '# A' || chr(10) || '## B' || chr(10) || 'new' || chr(10) || '## C' || chr(10) || o_clerk ELSE body END AS body, CASE o_orderkey % 3 WHEN 1 THEN 'ambiguous_target' WHEN 2 THEN 'target_not_found' END AS error
FROM (SELECT o_orderkey, o_orderstatus AS o_clerk, CASE o_orderkey % 3 WHEN 0 THEN '# A' || chr(10) || '## B' || chr(10) || 'old ' || o_orderkey || chr(10) || '### deep' || chr(10) || 'x' || chr(10) || '## C' || chr(10) || o_orderstatus WHEN 1 THEN '# A' || chr(10) || '## B' || chr(10) || '## B' || chr(10) ELSE 'no heading' END AS body FROM orders)""")
def section_patched(spark, sf):
    key = F.col("o_orderkey")
    body = F.when(key % 3 == 0, F.concat(F.lit("# A\n## B\nold "), key, F.lit("\n### deep\nx\n## C\n"), "o_orderstatus")).when(key % 3 == 1, "# A\n## B\n## B\n").otherwise("no heading")
    return table(ship(spark), sf, "orders").select("o_orderkey", frontmatter.patched(body, ["A", "B"], "new").alias("p")).select("o_orderkey", "p.*")


@query("""SELECT event_id, event_type AS vault, ts FROM (SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-01 12:00:00' QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 15) ORDER BY ts DESC, event_id LIMIT 15""")
def recent_per_vault(spark, sf):
    """The newest of each vault, cut there, then of all."""
    from lodestack.operators.retrieval import ranked

    rows = table(spark, sf, "events").filter("ts > timestamp'2024-01-01 12:00:00'").select("event_id", F.col("event_type").alias("vault"), "ts")
    first = ranked(rows, F.desc("ts"), F.col("event_id"), partition=["vault"]).filter("rank <= 15").drop("rank")
    return first.orderBy(F.desc("ts"), "event_id").limit(15)


@query("""SELECT lang AS vault, count(*) AS notes, sum(len(list_filter(string_split_regex(trim(text, ' ' || chr(10) || chr(9)), '\\s+'), lambda w: w <> '')))::BIGINT AS words, (SELECT 'm' || max(label) FROM embeddings) AS model, (SELECT max(ts) FROM events WHERE event_type = 'signup') AS last_run FROM documents GROUP BY 1""")
def vault_stats(spark, sf):
    """Notes and words of each vault, the active model and the last run."""
    docs = table(spark, sf, "documents").select(F.col("lang").alias("vault"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words"))
    model = table(spark, sf, "embeddings").agg(F.concat(F.lit("m"), F.max("label")).alias("model"))
    run = table(spark, sf, "events").filter("event_type = 'signup'").agg(F.max("ts").alias("last_run"))
    return docs.groupBy("vault").agg(F.count("*").alias("notes"), F.sum("words").alias("words")).join(F.broadcast(model)).join(F.broadcast(run))  # one row each


def recall_rows(spark, sf) -> DataFrame:
    number = F.col("event_id")
    return table(spark, sf, "events").select(
        F.concat(F.when(F.col("user_id") % 5 == 0, "notes/").otherwise("_memory/"), F.col("user_id")).alias("path"), F.col("value").alias("score"), F.when(number % 9 == 0, "superseded").alias("status"), F.col("ts").alias("observed_at"),
        number.alias("mtime"), F.col("event_type").alias("type"), F.when(number % 3 == 0, "direct").when(number % 3 == 1, "inferred").otherwise("uncertain").alias("confidence"), F.lit(None).cast("timestamp").alias("valid_from"), F.when(number % 10 == 0, F.expr("timestamp'2020-01-01'")).alias("valid_to"),
    )


@query("""WITH r AS (SELECT '_memory/' || user_id AS path, value AS score, ts, event_id FROM events WHERE user_id % 5 <> 0 AND event_id % 9 <> 0 AND event_id % 10 <> 0 AND event_id % 3 < 2 AND event_type IN ('click', 'view') AND date_diff('second', ts, TIMESTAMP '2024-02-01') <= 40 * 86400),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, ts DESC, event_id DESC) = 1) SELECT path, score, event_id AS mtime FROM b ORDER BY ts DESC, event_id DESC, path LIMIT 20""")
def memory_recall(spark, sf):
    """The best record of each path below the sink: current, valid, sure and young enough, the newest observation first."""
    rows = recall_rows(spark, sf).select("path", "score", "observed_at", "mtime", "status", "type", "confidence", "valid_from", "valid_to")
    return memory.recall(rows, F.expr("timestamp'2024-02-01'"), sinks=["_memory/"], confidence="inferred", types=["click", "view"], days=40).select("path", "score", "mtime")


NOTE = """'# T' || chr(10) || '- [fact] order ' || o_orderkey || chr(10) || '  goes on' || chr(10) || '- [x] done' || chr(10) || '## Relations' || chr(10) || '- placed_by [[C' || o_custkey || '|shown]]' || chr(10) || '- Bad [[C]]' || chr(10) || '- placed_by [[C]] tail'"""


def order_notes(spark, sf) -> DataFrame:
    lines = F.concat(F.lit("# T\n- [fact] order "), "o_orderkey", F.lit("\n  goes on\n- [x] done\n## Relations\n- placed_by [[C"), "o_custkey", F.lit("|shown]]\n- Bad [[C]]\n- placed_by [[C]] tail"))
    return table(ship(spark), sf, "orders").select("o_orderkey", lines.alias("text"))


@query("SELECT o_orderkey, 2::INT AS first, 3::INT AS last, 'fact' AS category, 'order ' || o_orderkey || chr(10) || 'goes on' AS text FROM orders")
def note_statements(spark, sf):
    return order_notes(spark, sf).select("o_orderkey", F.inline(md.extracted("text", "statements"))).select("o_orderkey", "first", "last", "category", "text")


@query("SELECT o_orderkey, 'placed_by' AS role, 'C' || o_custkey AS target, 6::INT AS line FROM orders")
def note_relations(spark, sf):
    return order_notes(spark, sf).select("o_orderkey", F.inline(md.extracted("text", "relations")))


@query("""SELECT o_orderkey, u.f AS first, u.l AS last FROM orders, unnest([{f: 2, l: 3}, {f: 4, l: 4}, {f: 6, l: 6}, {f: 7, l: 7}, {f: 8, l: 8}]) AS t(u)""")
def note_items(spark, sf):
    return order_notes(spark, sf).select("o_orderkey", F.inline(md.extracted("text", "items"))).select("o_orderkey", "first", "last")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a' || chr(10) || '  [Datacore view]' || chr(10) || o_orderstatus ELSE 'a' || chr(10) || '```sql' || chr(10) || o_orderstatus || chr(10) || '```' END AS text, (o_orderkey % 2 = 0)::INT AS views FROM orders""")
def views_stripped(spark, sf):
    """Fences with computed views give way to a placeholder, others stay."""
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([md.without_views(t or "") for t in texts], columns=["text", "views"])

    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("a\n  ```dataview\nLIST\n  ```\n"), "o_orderstatus")).otherwise(F.concat(F.lit("a\n```sql\n"), "o_orderstatus", F.lit("\n```")))
    rows = table(ship(spark), sf, "orders").select("o_orderkey", F.pandas_udf(run, "struct<text: string, views: int>")(text).alias("s"))
    return rows.select("o_orderkey", "s.*")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_id % 3 <> 0 THEN 'agent_write_outside_sink' WHEN event_id % 4 <> 0 AND event_id % 3 = 0 THEN 'sink_is_for_agents' WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN 'missing_provenance' WHEN event_id % 3 = 0 AND event_id % 7 = 0 THEN 'invalid_provenance' END AS reason FROM events""")
def record_validation(spark, sf):
    number = F.col("event_id")
    rows = table(spark, sf, "events").select(
        "event_id", F.concat(F.when(number % 3 == 0, "_memory/").otherwise("notes/"), number).alias("path"), (number % 4 == 0).alias("agent"), F.when(number % 5 == 0, " ").otherwise("agent").alias("source"),
        F.when(number % 7 == 0, "sure").otherwise("direct").alias("confidence"), F.lit("active").alias("status"), F.lit("2024-01-01").alias("observed_at"), F.lit(None).cast("string").alias("superseded_by"),
    )
    return memory.validate(rows, ["_memory/"]).select("event_id", "reason")


@query("""WITH w AS (SELECT o_orderkey, o_orderkey % 5 <> 0 AS there, o_orderkey % 7 = 0 AS del, CASE WHEN o_orderkey % 3 = 0 THEN 'stale' WHEN o_orderkey % 3 = 1 THEN 'h' END AS expected, CASE WHEN o_orderkey % 11 = 0 THEN 'h' ELSE 'n' END AS hash FROM orders)
SELECT o_orderkey::VARCHAR AS path, CASE WHEN del AND NOT there THEN 'refused: not_found' WHEN del AND expected IS NULL THEN 'refused: expected_hash_required' WHEN expected IS NOT NULL AND (NOT there OR expected <> 'h') THEN 'refused: hash_mismatch' WHEN del THEN 'deleted' WHEN NOT there THEN 'created' WHEN hash = 'h' THEN 'unchanged' ELSE 'updated' END AS action FROM w""")
def write_actions(spark, sf):
    """Writes and deletions against what is there: accepted, unchanged or refused."""
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    current = orders.filter("o_orderkey % 5 <> 0").select(key.cast("string").alias("path"), F.lit("h").alias("hash"))
    writes = orders.select(key.cast("string").alias("path"), F.when(key % 11 == 0, "h").otherwise("n").alias("hash"), F.when(key % 3 == 0, "stale").when(key % 3 == 1, "h").alias("expected"), (key % 7 == 0).alias("delete"))
    return memory.stage_writes(current, writes).select("path", "action")


@query("""WITH n AS (SELECT doc_id, coalesce(lang, 'x') || '/' || source || '/' || doc_id AS path, coalesce(lang, 'x') || '/' || source AS f, coalesce(lang, 'x') AS g FROM documents), a AS (SELECT f, count(*) AS c FROM n GROUP BY 1), b AS (SELECT g, count(*) AS c FROM n GROUP BY 1)
SELECT path, CASE WHEN a.c >= 20 THEN f WHEN b.c >= 20 THEN g END AS folder FROM n JOIN a USING (f) JOIN b USING (g) WHERE a.c >= 20 OR b.c >= 20""")
def folder_prior(spark, sf):
    path = F.concat_ws("/", F.coalesce("lang", F.lit("x")), "source", F.col("doc_id").cast("string"))
    return memory.prior_folder(table(spark, sf, "documents").select(path.alias("path")), 20)


@query(r"""SELECT doc_id FROM documents WHERE (regexp_matches(coalesce(lang, 'x') || '/' || source || '/' || doc_id || '.md', '^en/.*\.md$') OR regexp_matches(coalesce(lang, 'x') || '/' || source || '/' || doc_id || '.md', '^[^/]*/src1[0-9]?/[^/][^/]\.md$')) AND NOT starts_with(coalesce(lang, 'x') || '/' || source, 'en/src1')""")
def path_filters(spark, sf):
    """Globs that take paths in, and a prefix that leaves some out."""
    path = F.concat(F.concat_ws("/", F.coalesce("lang", F.lit("x")), "source", F.col("doc_id").cast("string")), F.lit(".md"))
    rows = table(spark, sf, "documents").select("doc_id", path.alias("path"))
    return rows.filter(predicates.matches_any_glob(F.col("path"), ["en/**/*.md", "en/*/*.md", "*/src1*/??.md", "*/src1/??.md"]) & ~F.col("path").startswith("en/src1")).select("doc_id")


@query("""SELECT count(*) FILTER (vec_id % 11 = 0) AS orphans FROM embeddings""")
def orphan_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id")
    return vectors.join(vectors.filter("vec_id % 11 <> 0"), "vec_id", "left_anti").agg(F.count("*").alias("orphans"))


@query("""WITH c AS (SELECT l_orderkey AS note, list_sort(list(DISTINCT md5(l_linenumber || l_returnflag || l_linestatus))) AS h FROM lineitem GROUP BY 1),
n AS (SELECT h, min(note) AS there FROM c WHERE note % 2 = 1 GROUP BY h) SELECT note AS gone, there FROM c JOIN n USING (h) WHERE note % 2 = 0""")
def rename_match(spark, sf):
    """Notes that went, with the first new note of the same set of chunk hashes: of two notes in turn one went and one is new."""
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("note"), F.md5(F.concat(F.col("l_linenumber").cast("string"), "l_returnflag", "l_linestatus")).alias("hash"))
    marks = chunks.groupBy("note").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("hash")), ","), 256).alias("set"))
    fresh = marks.filter("note % 2 = 1").groupBy("set").agg(F.min("note").alias("there"))
    return marks.filter("note % 2 = 0").join(fresh, "set").select(F.col("note").alias("gone"), "there")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN TIMESTAMP '2024-02-29 10:00:00' WHEN 1 THEN TIMESTAMP '2024-02-29 08:00:00' END AS at FROM orders""")
def strict_times(spark, sf):
    key = F.col("o_orderkey") % 4
    value = F.when(key == 0, "2024-02-29T10:00:00Z").when(key == 1, "2024-02-29T10:00:00.5+02:00").when(key == 2, "2023-02-29T10:00:00Z").otherwise("2024-02-28")
    return table(spark, sf, "orders").select("o_orderkey", F.date_trunc("second", records.strict_time(value)).alias("at"))


@query("""SELECT 'doc/' || doc_id AS id, 'Document ' || doc_id AS title, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 200) AS snippet FROM documents WHERE doc_id = 11""")
def connector_fetch(spark, sf):
    """One document by id, as a connector hands it out."""
    own = table(spark, sf, "documents").filter("doc_id = 11")
    return own.select(F.concat(F.lit("doc/"), "doc_id").alias("id"), F.concat(F.lit("Document "), "doc_id").alias("title"), outline.snippet(F.col("text")).alias("snippet"))




@query("""WITH n AS (SELECT c_custkey AS id, repeat('d/', (c_custkey % 3 + 1)::INT) || 'n' || (c_custkey % 200) || '.md' AS path, 'N' || (c_custkey % 250 + 100) AS alias FROM customer), l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'n' || (o_orderkey % 400) ELSE 'd/d/n' || (o_orderkey % 230) END AS target FROM orders),
p AS (SELECT path, min(id) AS id FROM n GROUP BY 1), f AS (SELECT regexp_extract(path, '[^/]*$') AS name, arg_min(id, {n: length(path), p: path}) AS id FROM (SELECT path, min(id) AS id FROM n GROUP BY 1) GROUP BY 1), a AS (SELECT lower(alias) AS name, arg_min(id, {n: length(path), p: path, i: id}) AS id FROM n GROUP BY 1)
SELECT o_orderkey, coalesce(p.id, CASE WHEN target NOT LIKE '%/%' THEN f.id END, a.id) AS resolved FROM l LEFT JOIN p ON p.path = target || '.md' LEFT JOIN f ON f.name = target || '.md' LEFT JOIN a ON a.name = target""")
def resolve_ties(spark, sf):
    """Exact paths before file names before aliases; of several the shortest path, then the first."""
    from lodestack.sources import markdown

    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(key.alias("id"), F.concat(F.repeat(F.lit("d/"), (key % 3 + 1).cast("int")), F.lit("n"), key % 200, F.lit(".md")).alias("path"), F.concat(F.lit("N"), key % 250 + 100).alias("alias"))
    links = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("n"), F.col("o_orderkey") % 400)).otherwise(F.concat(F.lit("d/d/n"), F.col("o_orderkey") % 230)).alias("target"))
    return markdown.resolve(links, rows.select("id", "path"), rows.select("id", "alias")).select("o_orderkey", "resolved")


@query("""SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'delete' WHEN o_orderkey % 5 = 0 THEN 'create' ELSE 'update' END AS op FROM orders WHERE NOT (o_orderkey % 7 = 0 AND o_orderkey % 5 = 0)""")
def write_audit(spark, sf):
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    current = orders.filter("o_orderkey % 5 <> 0").select(key.cast("string").alias("path"), F.lit("h").alias("hash"))
    writes = orders.select(key.cast("string").alias("path"), F.lit("n").alias("hash"), F.when(key % 7 == 0, "h").alias("expected"), (key % 7 == 0).alias("delete"))
    return memory.audit_rows(memory.stage_writes(current, writes), F.expr("timestamp'2024-01-01'"), "me").select("path", "op")


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS norm, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6)::DOUBLE AS first, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS squashed FROM embeddings""")
def vector_norms(spark, sf):
    from lodestack.functions import vectors

    v = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), F.round(F.element_at(vectors.unit(v), 1), 6).alias("first"), F.round(vectors.sigmoid(F.element_at(v, 1).cast("double")), 6).alias("squashed"))


@query("""SELECT doc_id, 'store://doc/' || doc_id || '#chunk-' || left(sha256(nfc_normalize(rtrim(replace(text, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(13)))), 7) AS chunk FROM documents""")
def chunk_ids(spark, sf):
    """Ids of chunks that stay with their content, whatever place it has."""
    from lodestack.functions import hashing

    docs = table(ship(spark), sf, "documents")
    return docs.select("doc_id", hashing.chunk_ids(F.concat(F.lit("store://doc/"), "doc_id"), F.col("text")).alias("chunk"))
