"""Trips, walks, passages and the whole week."""

import collections
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strider.config import DAILY_WEIGHTS, SimConfig
from strider.operators import audience, graphbuild, metrics, paths, topology, trips, visibility, walk
from strider.plans import catalog, venue, weekly
from strider.sources.graph import directed
from strider.storage import shared_dir, written


@pytest.fixture(scope="module")
def site(spark):
    nodes, edges = graphbuild.build_graph(topology.classify(topology.convert(venue.zones(spark))))
    both = written(directed(edges), f"{shared_dir(spark)}/e")
    return nodes, edges, both, venue.panels(spark)


def test_daily_counts(spark):  # A11 W5 J10
    counts = trips.daily_counts(spark, 200_000, DAILY_WEIGHTS)
    assert [r["trips"] for r in counts.orderBy("day_idx").collect()] == [22000, 24000, 26000, 29000, 33000, 39000, 27000]
    assert sum(r["trips"] for r in trips.daily_counts(spark, 7, DAILY_WEIGHTS, half_up=True).collect()) == 7
    days = trips.trip_days(spark.createDataFrame([(0,), (21999,), (22000,), (10**6,)], "trip long"), counts)
    assert {r["trip"]: r["day_idx"] for r in days.collect()} == {0: 0, 21999: 0, 22000: 1, 10**6: 6}


@pytest.mark.parametrize("total,pool", [(0, 5), (5, 0), (3, 10), (10, 10), (25, 10), (200_000, 123_000)])
def test_trip_plan(spark, total, pool):  # M1
    rows = trips.trip_plan(spark, total, pool).collect()
    n = total if pool else 0
    assert sorted(r["trip"] for r in rows) == list(range(n))
    seen = collections.Counter(r["person"] for r in rows)
    assert all(0 <= p < pool for p in seen)
    assert len(seen) == min(n, pool) if n else not seen


def test_choice_frequencies(spark, site):  # M2 P16
    nodes, _, both, _ = site
    w = walk.world(nodes, both, SimConfig(zone_anchor=venue.ANCHOR))
    assert w.zone.any()
    u = (np.arange(200_000) + 0.5) / 200_000
    current = np.full(len(u), w.shops[0])
    for last in (-1, 3):
        pick = walk.choose_shop(w, current, np.full(len(u), last), u)
        pull = w.weights[w.row_of[w.shops[0]]].copy()
        if last >= 0:
            pull[last] = 0
            assert not (pick == last).any()
        assert np.abs(np.bincount(pick, minlength=len(pull)) / len(u) - pull / pull.sum()).max() < 1e-4


@pytest.mark.parametrize("n_shops", [0, 1, 40])
def test_placed_choice_equals_the_table_of_pairs(spark, n_shops):  # M2 P16 W4
    places = spark.createDataFrame([(k, 174.777 + k * 0.00005, -36.871 + k % 4 * 0.00005) for k in range(12)], "current long, x double, y double")
    shops = spark.range(n_shops).select(F.concat(F.lit("s"), F.col("id") % 30).alias("shop"), (100 - F.col("id")).alias("shop_ord"), (174.7771 + F.col("id") * 0.00003).alias("x"), F.lit(-36.8711).alias("y"), (0.3 / (1 + F.col("id") % 4)).alias("base"))
    last = F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), F.col("id") % 33))  # some are no shops
    # every second walker is at one place; draws reach both ends
    walkers = spark.range(600).select(F.col("id").alias("walker"), F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 14).cast("long").alias("current"), last.alias("last"))
    u = F.when(F.col("walker") % 50 < 3, F.col("walker") % 50 / 2.0).otherwise(F.col("walker") * 37 % 600 / 600.0)
    dist = F.greatest(F.lit(2.0), F.hypot((F.col("x") - F.col("sx")) * 88800.0, (F.col("y") - F.col("sy")) * 111000.0))
    pairs = places.crossJoin(shops.withColumnsRenamed({"x": "sx", "y": "sy"})).withColumn("weight", F.col("base") / F.pow(dist, F.lit(1.3)))
    rows = lambda df: sorted(map(tuple, df.select("walker", "shop").collect()))
    got = trips.choose_placed_shops(walkers, places, shops, u, 1.3)
    want = rows(trips.choose_shops(walkers, pairs, u))
    assert rows(got) == want and len(want) == (0 if not n_shops else len({w for w, _ in want}))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_gravity_choice_makes_no_table_of_pairs(spark):  # places and shops were joined, and that to the walkers
    plan = catalog.QUERIES["gravity_choice"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Window" not in plan


def test_step_frequencies(spark, site):  # M3: against a slow sampler with its own random numbers
    nodes, _, both, _ = site
    config = SimConfig(zone_anchor=venue.ANCHOR)
    w = walk.world(nodes, both, config)
    n = 60_000
    current, target = int(w.spawn[0]), int(w.shops[-1])
    options = [v for v in w.neighbours[current] if v >= 0]
    while len(options) < 3:
        current = options[0]
        options = [v for v in w.neighbours[current] if v >= 0]
    prev = options[0]
    got = walk.step(w, config, np.arange(n), 0, 0, np.full(n, current), np.full(n, prev), np.full(n, target))
    rnd = np.random.default_rng(1)
    rest = [v for v in options if v != prev]
    d = w.dist[w.row_of[target]]
    score = np.array([config.beta_progress * (d[current] - d[v]) + config.zone_boost * w.zone[v] + config.beta_vertical * (w.level[v] != w.level[target] and w.moves_up[v]) for v in rest])
    weight = np.exp(score + rnd.gumbel(size=(n, len(rest))))
    slow = np.array(rest)[(np.cumsum(weight, 1) >= (rnd.random(n) * weight.sum(1))[:, None]).argmax(1)]
    assert not (got == prev).any()
    for v in rest:
        assert abs((got == v).mean() - (slow == v).mean()) < 0.012


@pytest.mark.parametrize("candidates", ["floor", "grid"])
def test_passages_three_ways(spark, site, candidates):  # M6 M7 J11 W3 D1 D2
    nodes, _, both, panels = site
    config = SimConfig(weekly_visits=40, weekly_uniques=25, zone_anchor=venue.ANCHOR, candidates=candidates, max_hops=60)
    plan = trips.trip_plan(spark, 40, 25)
    views = visibility.edge_views(nodes, both, panels, config)
    kept = walk.reachable_views(views) if candidates == "floor" else views
    w = walk.world(nodes, both, config, kept, panels)
    hops = written(walk.simulate_hops(plan, w, config), f"{shared_dir(spark)}/h")
    as_set = lambda df: {(r["trip"], r["person"], r["panel_id"], r["contacts"]) for r in df.collect()}
    slow = as_set(visibility.passages_by_sample(hops, nodes, panels, config))
    assert slow and as_set(visibility.passages(hops, views)) == slow
    assert as_set(walk.simulate_exposures(plan, w, config)) == slow
    # draws do not depend on how trips are dealt out
    assert as_set(walk.simulate_exposures(plan.repartition(7), w, config)) == slow
    # legs join up, hops follow edges
    legs = {(r["trip"], r["leg"]): r for r in walk.simulate_legs(plan, w, config).collect()}
    by_trip = collections.defaultdict(list)
    for (t, leg), r in sorted(legs.items()):
        by_trip[t].append(r)
    for rows in by_trip.values():
        assert 3 <= len(rows) <= 5 and rows[-1]["is_exit"] and all(a["target"] == b["start"] for a, b in zip(rows, rows[1:]))
        shops = [r["target"] for r in rows[:-1]]
        assert all(a != b for a, b in zip(shops, shops[1:]))


def test_state_machine_agrees_with_lag(spark):  # W3 M7
    rnd = np.random.default_rng(7)
    rows = [(t, p, int(i), bool(h)) for t in range(6) for p in "ab" for i, h in enumerate(rnd.random(50) < 0.4)]
    df = visibility.rises(spark.createDataFrame(rows, "trip int, panel_id string, s int, hit boolean"), ["trip", "panel_id"], ["s"])
    got = {(r["trip"], r["panel_id"]): r["n"] for r in df.groupBy("trip", "panel_id").agg(F.count_if("rise").alias("n")).collect()}
    want = collections.Counter()
    inside = {}
    for t, p, _, h in rows:
        want[t, p] += h and not inside.get((t, p), False)
        inside[t, p] = h
    assert got == dict(want)


@pytest.mark.parametrize("mode", ["segment_logit", "shortest"])
def test_week(spark, site, tmp_path, mode):  # M8 M9 A1-A7 K1 K2 K9
    nodes, edges, _, panels = site
    config = SimConfig(weekly_visits=300, weekly_uniques=200, routing_mode=mode, zone_anchor=venue.ANCHOR, max_hops=150)
    week = weekly.simulate(spark, nodes, edges, panels, config, partitions=3)
    rows = week.metrics.collect()
    assert len(rows) == 12 and sum(r["contacts"] for r in rows) > 0
    assert all(r["unique_reach"] <= min(r["contacts"], 200) for r in rows)
    union = metrics.summary(week.exposures, 200).first()
    assert max(r["unique_reach"] for r in rows) <= union["unique_reach"] <= sum(r["unique_reach"] for r in rows)
    assert {r["panel_id"]: r["unique_reach"] for r in metrics.bitmap_reach(week.exposures).collect()} == {r["panel_id"]: r["unique_reach"] for r in rows if r["unique_reach"]}
    for r in audience.pair_overlap(week.exposures, panels).collect():
        assert 0 <= r["shared_agents"] <= min(r["unique_reach_a"], r["unique_reach_b"]) and 0 <= r["overlap_coefficient"] <= 1
    weekly.report(week, panels, config, str(tmp_path))
    assert len(weekly.console(week, config)) >= 6
    only = weekly.simulate(spark, nodes, edges, panels, SimConfig(**{**config.__dict__, "active_panel_ids": ("27000",)}))
    assert {r["panel_id"] for r in only.exposures.select("panel_id").distinct().collect()} <= {"27000"}


def test_shortest_walks_follow_paths(spark, site):  # M5
    nodes, _, both, panels = site
    config = SimConfig(zone_anchor=venue.ANCHOR)
    w = walk.world(nodes, both, config)
    legs = walk.simulate_legs(trips.trip_plan(spark, 20, 20), w, config)
    ends = paths.decision_nodes(nodes).select("id")
    hops = walk.shortest_hops(legs, paths.paths(ends, both, ends)).orderBy("trip", "leg", "hop").collect()
    start = {(r["trip"], r["leg"]): (r["start"], r["target"]) for r in legs.collect()}
    by = collections.defaultdict(list)
    for h in hops:
        by[h["trip"], h["leg"]].append(h)
    for k, hs in by.items():
        assert (hs[0]["src"], hs[-1]["dst"]) == start[k] and all(a["dst"] == b["src"] for a, b in zip(hs, hs[1:]))


def test_vectors(spark):  # F21-F24 D5
    ex = spark.createDataFrame([(0, 0, "a", 1), (0, 8, "a", 2), (0, 40, "a", 1), (0, 3, "a", 0)], "trip long, person long, panel_id string, contacts long")
    panels = spark.createDataFrame([("a",), ("b",)], "panel_id string")
    get = lambda fmt: {r["panel_id"]: r["data"] for r in audience.vectors(ex, panels, 10, fmt, 1).collect()}
    assert get("sparse") == {"a": "1;9;41", "b": ""}
    assert get("binary") == {"a": "1000000010", "b": "0000000000"}
    assert get("base64") == {"a": "gIA=", "b": "AAA="}


def test_stream_of_samples(spark, tmp_path):  # extension of M7
    from strider.streaming.passages import stream_passages

    rows = [(1, 1, "a", f"2024-01-01 00:00:{s:02d}", s, h) for s, h in enumerate([True, True, False, True, False, False, True])]
    src = str(tmp_path / "in")
    for k in (0, 4):
        spark.createDataFrame(rows[k : k + 4 if k == 0 else None], "trip long, person long, panel_id string, ts string, seq int, hit boolean").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_passages(stream).writeStream.format("memory").queryName("passages").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert spark.table("passages").count() in (3, 4)
