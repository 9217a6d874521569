import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import communities, edges

LINK = "g string, src long, dst long"


def greedy(pairs):
    """Modularity that sequential local moving with contraction reaches, nodes in ascending order."""
    pairs = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    weights = {}
    for a, b in pairs:
        weights.setdefault(a, {})[b] = weights.setdefault(b, {})[a] = 1.0
    owner, total = {n: n for n in weights}, 2.0 * len(pairs)
    while True:
        place, degree = {n: n for n in weights}, {n: sum(w.values()) for n, w in weights.items()}
        tot, moved, ever = dict(degree), True, False
        while moved:
            moved = False
            for n in sorted(weights):
                near = {}
                for m, w in weights[n].items():
                    if m != n:
                        near[place[m]] = near.get(place[m], 0) + w
                tot[place[n]] -= degree[n]
                gain = lambda c: near.get(c, 0) - tot[c] * degree[n] / total  # noqa: B023, E731
                to = max(sorted(near), key=gain, default=place[n])
                if gain(to) > gain(place[n]) + 1e-9:
                    place[n], moved, ever = to, True, True
                tot[place[n]] += degree[n]
        if not ever:
            break
        owner = {n: place[c] for n, c in owner.items()}
        merged = {}
        for n, near in weights.items():
            for m, w in near.items():
                row = merged.setdefault(place[n], {})
                row[place[m]] = row.get(place[m], 0) + w
        weights = merged
    degree = {}
    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    sums = {}
    for n, k in degree.items():
        sums[owner[n]] = sums.get(owner[n], 0) + k
    return sum(owner[a] == owner[b] for a, b in pairs) / len(pairs) - sum((s / total) ** 2 for s in sums.values())


def test_modularity_is_within_two_percent_of_sequential_louvain(spark):
    rng = random.Random(4)
    planted = [(a, b) for a in range(120) for b in range(a) if rng.random() < (0.4 if a % 6 == b % 6 else 0.03)]
    weak = [(a, b) for a in range(150) for b in range(a) if rng.random() < (0.2 if a % 5 == b % 5 else 0.08)]
    ring = [(5 * c + a, 5 * c + b) for c in range(20) for a in range(5) for b in range(a)] + [(5 * c, (5 * c + 6) % 100) for c in range(20)]
    hub = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(1, 199, 2)]
    graphs = {"planted": planted, "weak": weak, "ring": ring, "hub": hub}
    rows = spark.createDataFrame([(g, a, b) for g, e in graphs.items() for a, b in e], LINK)
    found = communities.louvain(rows, "g").cache()
    told = {r["g"]: r for r in communities.modularity(rows, found, "g").collect()}
    for g, e in graphs.items():
        assert told[g]["modularity"] >= 0.98 * greedy(e) and told[g]["nodes"] == len({x for p in e for x in p}) and told[g]["edges"] == len(set(e))
    assert told["planted"]["gainers"] == told["ring"]["gainers"] == 0
    members = found.filter("g = 'planted'").groupBy("cluster").agg(F.collect_set(F.col("node") % 6).alias("kinds")).collect()
    assert len(members) == 6 and all(len(r["kinds"]) == 1 for r in members)
    # The same graph in other partitions, turned and with repeated edges and loops gives the same clusters.
    other = rows.select("g", F.col("dst").alias("src"), F.col("src").alias("dst")).unionByName(rows.limit(50)).unionByName(spark.createDataFrame([("ring", 3, 3), ("ring", None, 3)], LINK)).repartition(7)
    assert sorted(map(tuple, communities.louvain(other, "g").collect())) == sorted(map(tuple, found.collect()))


def test_cliques_are_named_by_their_smallest_node(spark):
    cliques = [(a, b) for base in (0, 10) for a in range(base, base + 5) for b in range(base, a)] + [(4, 10)]
    rows = {r["node"]: r["cluster"] for r in communities.louvain(spark.createDataFrame(cliques, "src long, dst long")).collect()}
    assert {rows[i] for i in range(5)} == {0} and {rows[i] for i in range(10, 15)} == {10}
    assert communities.louvain(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_clusters_from_a_query_or_from_seeds(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8), (9, 9)], "src long, dst long")
    search = lambda vault, asked, top: spark.createDataFrame([(1,), (9,)][:top], "node long")
    got = lambda **o: [tuple(r) for r in edges.cluster(links, edges.seeds_of(search=search, **o)).collect()]
    assert got(asked="atlas", vaults=["a"]) == got(asked="atlas", vaults=["a", "b"], vault="b") == [(1, 1), (2, 1), (3, 1), (9, 9)]
    assert got(asked="atlas", vaults=["a"], top=1) == got(seeds=spark.createDataFrame([(1,), (1,)], "seed long")) == [(1, 1), (2, 1), (3, 1)]
    for wrong in ({}, {"asked": "x", "seeds": links.select(F.col("src").alias("seed"))}):
        with pytest.raises(ValueError, match="both_seeds_and_query"):
            edges.seeds_of(search=search, **wrong)
    for wrong in ({"vaults": ["a", "b"]}, {"vaults": ["a", "b"], "vault": "c"}):
        with pytest.raises(ValueError, match="vault_required"):
            edges.seeds_of(asked="x", search=search, **wrong)
    with pytest.raises(ValueError, match="nodes"):
        edges.cluster(links, spark.createDataFrame([(1,)], "seed long"), limit=2)


def test_a_round_joins_links_once(spark):
    rows = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 1), ("g", 3, 4)], LINK)
    links = communities.both_ways(rows, "g").localCheckpoint()
    place = communities.degrees(links).withColumn("c", F.when(F.col("node") < 3, 1).otherwise(F.col("node"))).localCheckpoint()
    known, linked = communities.totalled(place).localCheckpoint(), communities.ready(links, place).localCheckpoint()
    each = communities.weighed(linked, known)
    got = {r["node"]: (r["own"], round(r["stay"] * communities.STEP, 6), round(r["best"]["value"] * communities.STEP, 6), -r["best"]["minus"], r["best"]["waits"]) for r in each.collect()}
    # m2 = 8, degrees 2, 2, 3, 1; clusters {1, 2}, {3}, {4}
    assert got == {1: (1, 0.5, 0.25, 3, False), 2: (1, 0.5, 0.25, 3, False), 3: (3, 0.0, 0.625, 4, True), 4: (4, 0.0, 0.625, 3, False)}
    assert each._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_rounds_over_blocks_are_those_of_one(spark, monkeypatch):
    rng = random.Random(9)
    rows = spark.createDataFrame([(g, rng.randrange(-90, 90), rng.randrange(-90, 90)) for g in ("x", "y") for _ in range(300)] + [("hub", 0, k) for k in range(1, 150)] + [(None, 1, 2), ("loop", 5, 5)], LINK)
    clusters = communities.louvain(rows, "g").localCheckpoint()
    found, judged = sorted(map(tuple, clusters.collect())), communities.modularity(rows, clusters, "g").collect()
    monkeypatch.setattr(communities.moves, "LINKS", 500)
    level = communities.leveled(rows, "g")
    assert level.parts > 2 and sorted(map(tuple, communities.louvain(rows, "g", level=level).collect())) == found
    assert sorted(communities.modularity(rows, clusters, "g", level=level).collect()) == sorted(judged)
    assert {g for g, *_ in found} == {"x", "y", "hub"} and len(found) == len({(a, b) for a, b, _ in found})


def test_a_block_weighs_moves_as_joins_do(spark, monkeypatch):
    monkeypatch.setattr(communities.moves, "LINKS", 60)
    rng = random.Random(3)
    rows = spark.createDataFrame([("g", rng.randrange(40), rng.randrange(40)) for _ in range(150)], LINK)
    level, links = communities.leveled(rows, "g"), communities.both_ways(rows, "g").localCheckpoint()
    place = communities.degrees(links).withColumn("c", F.col("node") - F.col("node") % 2).localCheckpoint()
    place = place.join(place.select(F.col("node").alias("c")), "c", "left_semi").localCheckpoint()
    told = communities.modularity(rows, place.select("g", "node", F.col("c").alias("cluster")), "g", level=level).first()
    whole = communities.degrees(links).join(place.select("g", "node", "c"), ["g", "node"], "left").withColumn("c", F.coalesce("c", "node")).localCheckpoint()
    each = communities.weighed(communities.ready(links, whole), communities.totalled(whole))
    assert level.parts > 1 and told["gainers"] == each.filter(F.col("best.value") > F.col("stay") + 1).count()
    assert (told["nodes"], told["edges"], told["clusters"]) == (place.count(), links.count() / 2, whole.select("c").distinct().count())
    node, turn = spark.range(-5, 6).withColumnRenamed("id", "node"), 7
    hashes = [r[0] for r in node.select(F.xxhash64("node", F.lit(turn))).collect()]
    assert sorted(communities.moves.xxhash(communities.moves.np.arange(-5, 6), turn).tolist()) == sorted(hashes)


def test_all_rounds_of_a_level_are_few_jobs(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([("g", rng.randrange(60), rng.randrange(60, 120)) for _ in range(500)], LINK).localCheckpoint()
    spark.sparkContext.setJobGroup("louvain", "jobs of all levels")
    level = communities.leveled(rows, "g")
    built = len(spark.sparkContext.statusTracker().getJobIdsForGroup("louvain"))
    state, used = level.rounds(level.singles(), 0, 12, 0.0)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("louvain")) - built
    spark.sparkContext.setJobGroup(None, None)
    assert used > 3 and jobs <= 6 and state.count() == 1
