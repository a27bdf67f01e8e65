"""Sources, topology, graph building, checks and paths."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from strider.config import from_args
from strider.operators import components, graphbuild, graphqa, paths, topology
from strider.plans import catalog, venue
from strider.sources import geojson, graph, panels, sinks


@pytest.fixture(scope="module")
def built(spark):
    classified = topology.classify(topology.convert(venue.zones(spark)))
    return classified, *graphbuild.build_graph(classified)


def dist(a, b):
    return math.hypot((a[0] - b[0]) * 88800, (a[1] - b[1]) * 111000)


def crossing(p, q, rings):
    ccw = lambda a, b, c: (c[1] - a[1]) * (b[0] - a[0]) > (b[1] - a[1]) * (c[0] - a[0])
    return any(ccw(p, c, d) != ccw(q, c, d) and ccw(p, q, c) != ccw(p, q, d) for r in rings for c, d in zip(r, r[1:] + r[:1]))


def test_graph_against_brute_force(spark, built):  # F7 F4 J5-J8 P13 G5
    classified, nodes, edges = built
    assert graphqa.verify(nodes, edges).first()["n_missing_ends"] == 0
    rings = {}
    for r in classified.where("class = 'corridor'").collect():
        rings.setdefault(r["level"], []).extend([list(map(tuple, ring)) for ring in json.loads(r["coordinates"])])
    at = {r["id"]: r for r in nodes.collect()}
    found = {(r["source"], r["target"]): r for r in edges.collect()}
    grid = sorted((r for r in at.values() if r["type"] == "corridor"), key=lambda r: int(r["id"][5:]))
    want = set()
    for i, a in enumerate(grid):
        for b in grid[i + 1 :]:
            p, q = (a["x"], a["y"]), (b["x"], b["y"])
            if a["level"] == b["level"] and dist(p, q) <= 10 and not crossing(p, q, rings[a["level"]]):
                want.add((a["id"], b["id"]))
    assert {k for k, r in found.items() if r["type"] == "corridor"} == want
    for r in (r for r in at.values() if r["type"] in graphbuild.SPECIAL):
        near = sorted((dist((r["x"], r["y"]), (g["x"], g["y"])), int(g["id"][5:]), g) for g in grid if g["level"] == r["level"])[:10]
        ok = [g for d, _, g in near if d < 5 or not crossing((r["x"], r["y"]), (g["x"], g["y"]), rings[r["level"]])]
        link = [e for k, e in found.items() if k[0] == r["id"] and e["type"].startswith("connection")]
        assert [(e["target"], e["type"]) for e in link] == [(ok[0]["id"], "connection") if ok else (near[0][2]["id"], "connection_fallback")]
    up = {k for k, e in found.items() if e["level"] == "1-2"}
    assert {at[a]["type"] for a, _ in up} == {"elevator", "escalator"} and all(found[k]["weight"] == 15 for k in up)
    assert nodes.count() == len(at) and set(at) == {x for k in found for x in k}


def test_graph_document_round_trip(spark, built, tmp_path):  # S4 K7 J1
    _, nodes, edges = built
    graph.write_graph(nodes, edges.unionByName(edges.limit(1).withColumn("target", F.lit("nowhere"))), f"{tmp_path}/g")
    n, e = graph.read_graph(spark, f"{tmp_path}/g")
    assert (n.count(), e.count()) == (nodes.count(), edges.count())
    graph.write_graph_tables(nodes, edges, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t/edges").count() == edges.count()


def test_geojson_round_trip(spark, tmp_path):  # S5 K8 F3
    geojson.write_features(venue.zones(spark), 'a"b'.replace('"', ""), f"{tmp_path}/z")
    back = geojson.read_features(spark, f"{tmp_path}/z").collect()
    rows = venue.zone_rows()
    assert [(r["properties"], r["geometry_type"], json.loads(r["coordinates"])) for r in back] == [(p, t, json.loads(c)) for _, p, t, c in rows]
    kinds = [("Point", "[1,2]", 1), ("LineString", "[[1,2],[3,4]]", 2), ("Polygon", "[[[1,2],[3,4],[5,6]]]", 3), ("MultiPolygon", "[[[[1,2],[3,4],[5,6]]],[[[7,8]]]]", 4), ("Other", "[9]", 0)]
    df = spark.createDataFrame([k[:2] for k in kinds], "t string, c string")
    got = df.select(F.size(geojson.vertices(F.col("t"), F.col("c"))).alias("n"), topology.reproject(F.col("t"), F.col("c")).alias("r")).collect()
    assert [r["n"] for r in got[:4]] == [1, 2, 3, 4] and got[4]["r"] == "[9]"
    assert json.loads(got[0]["r"])[0] == pytest.approx(1 / 20037508.34 * 180)


def test_quality_checks(spark):  # A16 A17 J2 G3 G6
    nodes = spark.createDataFrame([(x,) for x in "aabcde"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("x", "y"), ("d", "z")], "source string, target string")
    assert {r["id"]: r["warnings"] for r in graphqa.duplicate_nodes(nodes).collect()} == {"a": 1}
    assert {r["id"] for r in graphqa.dangling_ends(nodes, edges).collect()} == {"x", "z"}
    assert {r["id"]: r["degree"] for r in graphqa.degrees(nodes, edges).collect()} == {"a": 1, "b": 1, "c": 1, "d": 0, "e": 0}
    assert {r["id"]: r["component"] for r in graphqa.node_components(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
    assert not graphqa.verify(nodes, edges).first()["fully_connected"]


def test_components_of_a_long_path(spark):
    n = 300
    order = random.Random(1).sample(range(n), n)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])], "a int, b int")
    from strider.operators.components import components

    got = components(edges)
    assert got.count() == n and got.select("component").distinct().collect()[0][0] == 0 and got.select("component").distinct().count() == 1


def test_paths_against_floyd_warshall(spark):  # G1 G2 D16
    rnd = random.Random(3)
    n = 14
    raw = [(str(rnd.randrange(n)), str(rnd.randrange(n)), float(rnd.randint(1, 6))) for _ in range(22)]
    edges = spark.createDataFrame([(*e, i) for i, e in enumerate(raw)], "source string, target string, weight double, pos long")
    both = graph.directed(edges)
    d = {(str(i), str(j)): 0.0 if i == j else math.inf for i in range(n) for j in range(n)}
    for a, b, w in raw:
        d[a, b], d[b, a] = min(d[a, b], w), min(d[b, a], w)
        d[a, a] = d[b, b] = 0.0
    for k in range(n):
        for i in range(n):
            for j in range(n):
                d[str(i), str(j)] = min(d[str(i), str(j)], d[str(i), str(k)] + d[str(k), str(j)])
    sources = spark.createDataFrame([(str(i),) for i in range(n)], "id string")
    want = {k: v for k, v in d.items() if math.isfinite(v)}
    assert {(r["source"], r["node"]): r["dist"] for r in paths.distances(sources, both).collect()} == want
    assert {(r["source"], r["node"]): r["dist"] for r in paths.relaxed_distances(sources, both).collect()} == want
    for r in paths.paths(sources, both).collect():
        assert r["path"][0] == r["source"] and r["path"][-1] == r["target"]
        assert sum(min(w for a, b, w in raw if {a, b} == {x, y}) for x, y in zip(r["path"], r["path"][1:])) == r["dist"]


@pytest.mark.parametrize("links", [0, 200])
def test_relaxed_distances_of_directed_graphs(spark, monkeypatch, links):  # G1 by labels and in rounds
    monkeypatch.setattr(paths, "MOST_LINKS", links)
    monkeypatch.setattr(paths, "START_ROWS", 40)
    rnd = random.Random(7)
    raw = [(rnd.randrange(30), rnd.randrange(30), rnd.randint(0, 8) / 4) for _ in range(50)] + [(40, 41, 1.0), (40, 41, 0.5), (None, 1, 1.0), (2, None, 1.0), (3, 4, None)]
    edges = spark.createDataFrame(raw, "src long, dst long, weight double")
    clean = [r for r in raw if None not in r]
    want = {}
    for s in (*range(30), 40, 77):
        d = {s: 0.0}
        for _ in clean:
            for a, b, w in clean:
                if a in d:
                    d[b] = min(d.get(b, math.inf), d[a] + w)
        want |= {(s, v): x for v, x in d.items()}
    sources = spark.createDataFrame([(s,) for s in (*range(30), 40, 40, 77)], "id long")
    got = paths.relaxed_distances(sources, edges).collect()
    assert {(r["source"], r["node"]): r["dist"] for r in got} == want and len(got) == len(want)
    assert paths.relaxed_distances(sources, edges.limit(0)).count() == 32 and paths.relaxed_distances(sources.limit(0), edges).count() == 0


def test_relaxed_distances_of_a_long_lattice_take_no_rounds(spark, monkeypatch):  # a round for each hop, 200 here
    monkeypatch.setattr(paths, "_rounds", lambda *_: pytest.fail("rounds"))
    ids = range(800)
    raw = [(a, b, 1.0 + (a * 7 + b * 13) % 10 / 4) for a in ids for b in ((a + 1,) if a % 4 < 3 else ()) + (a + 4,) if b < 800]
    both = graph.directed(spark.createDataFrame([(str(a), str(b), w, i) for i, (a, b, w) in enumerate(raw)], "source string, target string, weight double, pos long"))
    sources = spark.createDataFrame([(str(i),) for i in range(0, 800, 9)], "id string")
    rows = lambda df: sorted((r["source"], r["node"], r["dist"]) for r in df.collect())
    assert rows(paths.relaxed_distances(sources, both)) == rows(paths.distances(sources, both))


def test_path_lengths_equal_the_sums_of_hops(spark):  # M5 W7, parallel links, no way, no links
    rnd = random.Random(5)
    raw = [(str(rnd.randrange(16)), str(rnd.randrange(16)), rnd.randint(1, 6) / 4) for _ in range(30)] + [("20", "21", 0.5), ("20", "21", 2.0)]
    both = graph.directed(spark.createDataFrame([(*e, i) for i, e in enumerate(raw)], "source string, target string, weight double, pos long"))
    sources = spark.createDataFrame([(str(i),) for i in (*range(16), 20, 30)], "id string")
    found = paths.paths(sources, both)
    cost = both.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    sums = {(r["source"], r["target"]): (r["n"], r["d"]) for r in paths.path_hops(found).join(cost, ["src", "dst"]).groupBy("source", "target").agg(F.count("*").alias("n"), F.sum("weight").alias("d")).collect()}
    got = {(r["source"], r["node"]): (r["hops"], r["length"]) for r in paths.path_lengths(sources, both).collect()}
    assert got == {(r["source"], r["target"]): sums.get((r["source"], r["target"]), (0, 0.0)) for r in found.select("source", "target").collect()}
    assert got["30", "30"] == (0, 0.0) and got["20", "21"] == (1, 0.5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_path_lengths_make_no_rows_of_hops(spark):  # neither a row for each hop nor a join of all pairs
    plan = catalog.QUERIES["path_lengths"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("MapInArrow")]
    assert "Generate" not in top and "Join" not in top


def test_panel_files(spark, tmp_path):  # S1 S3 S6 S8 K6 E1
    p = tmp_path / "p.csv"
    p.write_text("﻿panel_id, site_id ,latitude,longitude,orientation,floor\n27001,,-36.5,174.5,90, 2 \n\n\"27000\",9,x,1,2,1\n", encoding="utf-8")
    rows = panels.read_panels(spark, str(p)).collect()
    assert [(r["panel_id"], r["site_id"], r["latitude"], r["floor"], r["panel_ord"]) for r in rows] == [("27001", "17056", -36.5, "2", 0), ("27000", "9", None, "1", 1)]
    panels.write_panels(panels.read_panels(spark, str(p)).where("latitude IS NOT NULL"), f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").first()["latitude"] == "-36.50000000"
    t = tmp_path / "t.csv"
    t.write_text("a\tb\n1\t2\n")
    assert panels.read_map_table(spark, str(t)).columns == ["a", "b"]


def test_report_files(spark, tmp_path):  # K1-K4
    from strider.config import SimConfig
    from strider.operators import audience, metrics

    pn = venue.panels(spark).withColumn("active", F.col("floor") == "1")
    ex = spark.createDataFrame([(0, 0, "27000", 2), (1, 1, "27000", 1), (1, 1, "27001", 1)], "trip long, person long, panel_id string, contacts long")
    m = metrics.ranked(metrics.panel_metrics(ex, pn, 10))
    sinks.write_panel_metrics(m, f"{tmp_path}/m")
    first = spark.read.option("header", True).csv(f"{tmp_path}/m").orderBy(F.col("rank").cast("int")).first()
    assert (first["panel_id"], first["unique_reach"], first["contacts"], first["exposure_efficiency_pct"]) == ("27000", "2", "3", "20.00")
    sinks.write_pair_overlap(audience.pair_overlap(ex, pn), f"{tmp_path}/o")
    assert spark.read.option("header", True).csv(f"{tmp_path}/o").count() == 66
    sinks.write_lines(sinks.score_report(m, pn, SimConfig(), "Report", "now"), f"{tmp_path}/s")
    back = spark.read.option("header", True).option("comment", "#").csv(f"{tmp_path}/s")
    assert back.count() == 12 and back.columns[0] == "Rank"
    sinks.write_vectors(audience.vectors(ex, pn, 10, "sparse", 1), f"{tmp_path}/v")
    assert {r["Panel ID"]: r["Interaction Data"] for r in spark.read.option("header", True).csv(f"{tmp_path}/v").collect()}["Panel 27000"] == "1;2"


def test_nearest_is_exact_at_any_distance(spark):  # J6: cells that grow until k are found
    rnd = random.Random(3)
    at = lambda: (174.777 + rnd.uniform(-1, 1) ** 5 * 0.01, -36.871 + rnd.uniform(-1, 1) ** 5 * 0.01)
    targets = [(i, *at(), rnd.choice("12")) for i in range(200)] + [(900 + i, 174.777, -36.871, "3") for i in range(4)]
    points = [(f"p{i}", *at(), rnd.choice("123")) for i in range(40)]
    t = spark.createDataFrame(targets, "grid_ord long, x double, y double, level string")
    p = spark.createDataFrame(points, "id string, x double, y double, level string")
    got = sorted((r["id"], r["rank"], r["target_ord"]) for r in graphbuild.nearest(p, t, 10).collect())
    far = lambda a, b: math.hypot((a[1] - b[1]) * 88800.0, (a[2] - b[2]) * 111000.0)
    want = [(a[0], k + 1, b[0]) for a in points for k, b in enumerate(sorted((b for b in targets if b[3] == a[3]), key=lambda b: (far(a, b), b[0]))[:10])]
    assert got == sorted(want)
    assert graphbuild.nearest(p, t.limit(0)).count() == 0 and graphbuild.nearest(p.limit(0), t).count() == 0


def test_what_is_too_large_or_no_polygon_is_refused(spark, monkeypatch):  # D19, broadcasts
    zone = spark.createDataFrame([("MultiPolygon", "[[[[0,0],[1,0],[1,1],[0,0]]]]")], "t string, c string")
    with pytest.raises(Exception, match="MultiPolygon"):
        zone.select(geojson.rings(F.col("t"), F.col("c"))).collect()
    edges = spark.createDataFrame([("a", "b", 1.0, 0), ("b", "a", 1.0, 1)], "src string, dst string, weight double, pos long")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert paths.paths(ids, edges, ids).count() == 5
    monkeypatch.setattr(paths, "BROADCAST_EDGES", 2)
    with pytest.raises(ValueError, match="targets"):
        paths.paths(ids, edges, ids)


def test_command_line():  # S10
    config, args = from_args(["--panels", "p", "--graph", "g", "--out", "o", "--trips", "20", "--routing-mode", "shortest", "--step-meters", "1.5", "--partitions", "3"])
    assert (config.weekly_visits, config.routing_mode, config.step_m, args.partitions, args.out) == (20, "shortest", 1.5, 3, "o")
    with pytest.raises(SystemExit):
        from_args(["--panels", "p"])


@pytest.mark.parametrize("at_once", [0, 10**6])
def test_components_by_rounds_and_at_once(spark, monkeypatch, at_once):  # G3 A18
    monkeypatch.setattr(components, "FINISH", at_once)
    rnd = random.Random(at_once)
    edges = [(k, k + 1) for k in range(300)] + [(1000 + rnd.randrange(200), 1000 + rnd.randrange(200)) for _ in range(150)] + [(5000, 5000 + k) for k in range(200)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    for name in (int, lambda x: f"n{x:05}"):
        df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], ["a", "b"])
        got = {r["node"]: r["component"] for r in components.components(df).collect()}
        assert got == {name(k): name(v) for k, v in want.items()}
    assert components.components(df.limit(0)).count() == 0
