"""Column functions against hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from strider.config import SimConfig, from_json, to_json
from strider.functions import geo, rng, similarity, text


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_distance_and_view(spark):  # F1 P5 D4
    lit = F.lit
    assert one(spark, geo.distance_m(lit(0.0), lit(0.0), lit(1.0), lit(0.0))) == pytest.approx(88800)
    see = lambda x, y, hx, hy: one(spark, geo.in_view(lit(x), lit(y), lit(hx), lit(hy), lit(0.0), lit(0.0), lit(0.0), 15.0, math.cos(math.radians(60))))
    north = 10 / 111000
    assert see(0.0, north, 0.0, -1.0)  # in front of it, walking toward it
    assert not see(0.0, north, 0.0, 1.0)  # walking away
    assert see(0.0, north, 0.0, 0.0)  # standing
    assert not see(0.0, -north, 0.0, 1.0)  # behind it
    assert not see(0.0, 2 * north, 0.0, -1.0)  # too far
    assert not see(0.0, 0.0, 0.0, -1.0)  # on it


def test_polygon(spark):  # F4 F5 F6
    square = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]]
    rings = F.array(*[F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in r]) for r in square])
    inside = lambda x, y: one(spark, geo.point_in_polygon(F.lit(x), F.lit(y), rings))
    assert [inside(x, y) for x, y in ((3.0, 3.0), (1.5, 1.5), (5.0, 1.0), (0.5, 4.0), (0.5, 0.0))] == [True, False, False, True, False]
    cross = lambda *p: one(spark, geo.crosses(*map(F.lit, p), rings))
    assert cross(-1.0, 3.0, 1.0, 3.1) and not cross(3.0, 3.0, 3.5, 3.5)
    thin = F.array(F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))))
    assert not one(spark, geo.point_in_polygon(F.lit(0.5), F.lit(0.5), thin))


def test_wedge_and_arrow(spark):  # F17 F18
    w = one(spark, geo.wedge(F.lit(1.0), F.lit(2.0), F.lit(90.0), 15.0, 60.0))
    assert len(w) == 27 and tuple(w[0]) == tuple(w[-1]) == (1.0, 2.0)
    assert w[13]["lon"] == pytest.approx(2 + 15 / 88800)
    a = one(spark, geo.arrow(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    assert a[1]["lat"] == pytest.approx(3 / 111111) and a[2]["lon"] == pytest.approx(-a[3]["lon"])


def test_cells_truncate(spark):  # F9
    assert [one(spark, geo.cell(F.lit(v / 88800.0), 88800.0, 15.0)) for v in (-20.0, -10.0, 10.0, 31.0)] == [-1, 0, 0, 2]


def test_categories_in_order(spark):  # P4
    names = {"ArchieBros_lv3": "archiebrothers", "RS_lv3": "rebelsport", "rhythm": "hm", "rhxm": "specialty", "rhmx": "hm", None: "specialty", "": "specialty", "Farmers hm": "farmers"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["c"] for r in df.select("n", text.store_category(F.col("n")).alias("c")).collect()} == names


def test_person_index(spark):  # F13
    want = {"person_12": 12, "x agent_7b": 7, " 33rd": 33, "none": None, "": None, None: None, "99999999999999999999": None}
    df = spark.createDataFrame([(n,) for n in want], "n string")
    assert {r["n"]: r["i"] for r in df.select("n", text.person_index(F.col("n")).alias("i")).collect()} == want


def test_names_and_numbers(spark):  # F11 F12 F14 F16
    assert one(spark, text.display_name(F.lit("jb_hifi_lv2_entry"))) == "Jb hifi"
    assert one(spark, text.fixed(F.lit(0.125), 2)) == "0.12"
    assert one(spark, text.thousands(F.lit(1234567))) == "1,234,567"
    assert one(spark, text.half_up(F.lit(2.5))) == 3
    assert one(spark, text.similarity_color(F.lit(0.0))) == "rgb(75, 85, 99)"
    assert one(spark, text.similarity_color(F.lit(1.0))) == "rgb(236, 72, 153)"


@pytest.mark.parametrize("metric,want", [("jaccard", 0.4), ("cosine", 2 / math.sqrt(12)), ("overlap", 2.0), ("overlap_coef", 2 / 3), ("other", 0.0)])
def test_similarity(spark, metric, want):  # {1,2,3} and {2,3,4,5}
    assert one(spark, similarity.similarity(metric, F.lit(3), F.lit(4), F.lit(2))) == pytest.approx(want)
    assert one(spark, similarity.similarity(metric, F.lit(0), F.lit(0), F.lit(0))) == 0.0


def test_draws(spark):  # M11 M12
    import numpy as np

    u = [r["u"] for r in spark.range(20000).select(rng.uniform(F.lit(42), F.col("id")).alias("u")).collect()]
    v = rng.np_uniform(42, np.arange(20000))
    for x in (np.array(u), v):
        assert 0 <= x.min() and x.max() < 1 and abs(x.mean() - 0.5) < 0.01 and abs(x.var() - 1 / 12) < 0.005
    assert (rng.np_uniform(42, np.arange(5)) == v[:5]).all()
    assert np.isfinite(rng.np_gumbel(np.array([0.0, 1.0]))).all()
    assert math.isfinite(one(spark, rng.gumbel(F.lit(0.0))))


def test_config_document():  # S7 K5
    c = from_json('{"totalAgents": 5, "minVisits": 6, "categoryWeights": {"hm": 0.126}, "activePanelIds": [3], "dailyWeights": [1]}')
    assert (c.weekly_visits, c.min_visits, c.max_visits, c.category_weights["hm"], c.active_panel_ids) == (5, 6, 6, 0.13, ("3",))
    assert c.daily_weights == SimConfig().daily_weights
    assert from_json('{"weeklyVisits": 7, "totalAgents": 5}').weekly_visits == 7
    assert from_json(to_json(c)) == c
    assert SimConfig(step_m=0.1).step_m == 0.5
    with pytest.raises(ValueError):
        SimConfig(routing_mode="teleport")
