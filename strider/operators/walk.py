"""Weekly walks: legs of trips and the hops between them.

Trips are rows; a batch of them is walked in lockstep with arrays, one step moves every trip that still walks. Draws are
keyed on (seed, trip, leg, hop, neighbour), so results do not depend on partitioning. The walk needs the graph, the
distances to every decision node and the choice weights of shops; their size is checked before they are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strider.config import SimConfig
from strider.functions.rng import np_gumbel, np_uniform
from strider.operators import paths as P
from strider.operators.trips import escalator_zone, gravity_table

#: Bytes of walk tables that may be broadcast.
WORLD_BYTES = 1 << 30
#: Bytes of one view of an edge in them.
VIEW_BYTES = 48
#: Trips walked at once.
CHUNK = 4096
LEGS = "trip long, person long, leg int, start string, target string, is_exit boolean"
HOPS = "trip long, person long, leg int, hop int, src string, dst string"
EXPOSURES = "trip long, person long, panel_id string, contacts long"
_START, _VISITS, _SHOP, _EXIT, _NOISE, _NEXT = range(1, 7)


@dataclass
class World:
    """Everything a walk reads, as arrays. Node numbers follow the sorted ids."""

    ids: list[str]
    level: np.ndarray  # floor code of each node
    moves_up: np.ndarray  # escalators and elevators
    zone: np.ndarray
    spawn: np.ndarray  # entrances
    shops: np.ndarray
    row_of: np.ndarray  # node -> row of dist, -1 where it is no decision node
    dist: np.ndarray  # decision node x node
    neighbours: np.ndarray  # node x place, -1 for none, in edge order
    weights: np.ndarray  # decision node x shop
    view_first: np.ndarray  # (node, place) -> first row of its views
    view_panel: np.ndarray
    view_first_hit: np.ndarray
    view_last_hit: np.ndarray
    view_rises: np.ndarray
    panels: list[str]
    panel_level: np.ndarray


def world(nodes: DataFrame, directed: DataFrame, config: SimConfig, views: DataFrame | None = None, panels: DataFrame | None = None) -> World:
    """Collects the walk tables of a venue; refuses one that does not fit a broadcast."""
    ids, src, dst, _ = P.collected(directed)
    rows = nodes.select("id", "level", "type", "name").dropDuplicates(["id"]).orderBy("id")
    rows = P.bounded(rows, P.BROADCAST_EDGES, "nodes").to_pylist()
    ids = sorted({*ids, *(r["id"] for r in rows)})
    number = {v: i for i, v in enumerate(ids)}
    decision = P.decision_nodes(nodes).select("id").distinct()
    if decision.count() * len(ids) * 8 > WORLD_BYTES:
        raise ValueError("the distance table exceeds WORLD_BYTES")
    n = len(ids)
    found = P.distances(decision, directed)
    reach = found.toArrow()
    d_ids = sorted(r["id"] for r in decision.collect())
    row_of = np.full(n, -1)
    row_of[[number[i] for i in d_ids]] = np.arange(len(d_ids))
    dist = np.full((len(d_ids), n), np.inf)
    index = lambda col: np.array([number[v] for v in col.to_pylist()], np.int64)
    dist[row_of[index(reach.column("source"))], index(reach.column("node"))] = reach.column("dist").to_numpy()
    levels = {}
    level, kind = np.full(n, -1), np.full(n, "", object)
    for r in rows:
        level[number[r["id"]]] = levels.setdefault(str(r["level"]), len(levels))
        kind[number[r["id"]]] = r["type"]
    pairs = directed.groupBy("src", "dst").agg(F.min("pos").alias("pos")).orderBy("src", "pos", "dst")
    pairs = P.bounded(pairs, P.BROADCAST_EDGES, "directed edges")
    a, b = index(pairs.column("src")), index(pairs.column("dst"))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    first = np.searchsorted(a, np.arange(n))
    place = np.arange(len(a)) - first[a]
    width = int(place.max(initial=0)) + 1
    neighbours = np.full((n, width), -1)
    neighbours[a, place] = b
    zone = np.zeros(n, bool)
    for r in escalator_zone(nodes, config).collect():
        zone[number[r["id"]]] = True
    shops = [r["id"] for r in rows if r["type"] == "shop_entry"]
    shop_rows = nodes.where(F.col("type") == "shop_entry").select("id", "name").dropDuplicates(["id"]).join(F.broadcast(nodes.sparkSession.createDataFrame([(s, i) for i, s in enumerate(shops)], "id string, shop_ord long")), "id")
    pull = gravity_table(shop_rows, found.join(decision.withColumnRenamed("id", "node"), "node", "left_semi"), config).toArrow()
    weights = np.zeros((len(d_ids), len(shops)))
    if len(pull):
        weights[row_of[index(pull.column("current"))], pull.column("shop_ord").to_numpy()] = pull.column("weight").to_numpy()
    view_first = np.zeros(n * width + 1, np.int64)
    names, v_panel, v_first, v_last, v_rises, p_level = [], *(np.empty(0, np.int64) for _ in range(5))
    if views is not None:
        floors = {r["panel_id"]: r["floor"] for r in panels.select("panel_id", "floor").collect()}
        names = sorted(floors)
        p_level = np.array([levels.get(str(floors[p]), -2) for p in names])
        p_number = {p: i for i, p in enumerate(names)}
        v = P.bounded(views, WORLD_BYTES // VIEW_BYTES, "views of edges")
        slot = {(x, y): x * width + k for x, y, k in zip(a.tolist(), b.tolist(), place.tolist())}
        key = np.array([slot[x, y] for x, y in zip(index(v.column("src")).tolist(), index(v.column("dst")).tolist())], np.int64)
        by = np.argsort(key, kind="stable")
        view_first = np.searchsorted(key[by], np.arange(n * width + 1))
        v_panel = np.array([p_number[p] for p in v.column("panel_id").to_pylist()], np.int64)[by]
        v_first, v_last = (v.column(c).to_numpy(zero_copy_only=False)[by] for c in ("first_hit", "last_hit"))
        v_rises = v.column("rises").to_numpy()[by]
    return World(ids, level, np.isin(kind, ("escalator", "elevator")), zone, np.flatnonzero(kind == "mall_entrance"), np.array([number[s] for s in shops], np.int64), row_of, dist, neighbours, weights, view_first, v_panel, v_first, v_last, v_rises, names, p_level)


def choose_shop(w: World, current: np.ndarray, last: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Shop places for walkers at nodes `current` whose last shop was place `last` (-1: none)."""
    pull = w.weights[w.row_of[current]].copy()
    has = np.flatnonzero(last >= 0)
    pull[has, last[has]] = 0.0
    run = np.cumsum(pull, 1)
    total = run[:, -1]
    pick = ((run < (u * total)[:, None]) | (pull == 0)).argmin(1)  # the first with weight that reaches the draw
    # rounding may leave the draw above the sum: then the last with weight
    beyond = ~((run >= (u * total)[:, None]) & (pull > 0)).any(1)
    pick[beyond] = (len(w.shops) - 1) - (pull[beyond, ::-1] > 0).argmax(1)
    none = total <= 0
    pick[none] = np.minimum((u[none] * len(w.shops)).astype(np.int64), len(w.shops) - 1)
    return pick


def legs_of(w: World, trip: np.ndarray, config: SimConfig):
    """M8: (leg, walkers, start, target, is_exit) in order. The next leg starts at the target in any case."""
    seed = config.seed
    n = len(trip)
    if not len(w.spawn) or not len(w.shops):
        return
    draw = lambda what, leg=0: np_uniform(seed, trip, what, leg)
    current = w.spawn[np.minimum((draw(_START) * len(w.spawn)).astype(np.int64), len(w.spawn) - 1)]
    span = config.max_visits - config.min_visits + 1
    visits = config.min_visits + np.minimum((draw(_VISITS) * span).astype(np.int64), span - 1)
    last = np.full(n, -1)
    for leg in range(config.max_visits):
        who = np.flatnonzero(leg < visits)
        place = choose_shop(w, current[who], last[who], draw(_SHOP, leg)[who])
        target = w.shops[place]
        yield leg, who, current[who], target, False
        current[who], last[who] = target, place
    exit_ = w.spawn[np.minimum((draw(_EXIT) * len(w.spawn)).astype(np.int64), len(w.spawn) - 1)]
    # the exit leg follows a trip's own last visit
    yield config.max_visits, np.arange(n), current, exit_, True


def step(w: World, config: SimConfig, trip: np.ndarray, leg: int, hop: int, current: np.ndarray, prev: np.ndarray, target: np.ndarray) -> np.ndarray:
    """M3: the next node of each walker, -1 to stop. Never back at once, unless there is no other way.

    The noise acts twice, inside the weight and in the draw among weights, as the model has it."""
    around = w.neighbours[current]
    rows = w.row_of[target]
    ahead = np.where(around >= 0, w.dist[rows[:, None], around], np.inf)
    ok = (around >= 0) & (around != prev[:, None]) & np.isfinite(ahead)
    here = w.dist[rows, current]
    with np.errstate(invalid="ignore"):
        score = config.beta_progress * (here[:, None] - ahead) + config.zone_boost * w.zone[around]
    score += config.beta_vertical * ((w.level[around] != w.level[target][:, None]) & w.moves_up[around])
    noise = np_gumbel(np_uniform(config.seed, trip[:, None], _NOISE, leg, hop, np.arange(around.shape[1])[None, :]))
    weight = np.where(ok, np.exp(np.where(ok, score, 0.0) + config.randomness * noise), 0.0)
    run = np.cumsum(weight, 1)
    r = np_uniform(config.seed, trip, _NEXT, leg, hop) * run[:, -1]
    hit = (run >= r[:, None]) & ok
    pick = np.where(hit.any(1), hit.argmax(1), (ok.shape[1] - 1) - ok[:, ::-1].argmax(1))
    return np.where(ok.any(1), around[np.arange(len(current)), pick], prev)


def walked(w: World, config: SimConfig, trip: np.ndarray):
    """M4, M8: (leg, hop, walkers, src, dst) in order, all walkers of a step together."""
    for leg, who, start, target, _ in legs_of(w, trip, config):
        going = np.flatnonzero(start != target)
        who, current, target = who[going], start[going].copy(), target[going]
        prev = np.full(len(who), -1)
        for hop in range(config.max_hops):
            if not len(who):
                break
            nxt = step(w, config, trip[who], leg, hop, current, prev, target)
            go = (nxt >= 0) & (nxt != current)
            who, current, target, nxt = who[go], current[go], target[go], nxt[go]
            if not len(who):
                break
            yield leg, hop, who, current, nxt
            prev, current = current, nxt
            on = current != target
            who, current, target, prev = who[on], current[on], target[on], prev[on]


def _batches(batches):
    for batch in batches:
        trip, person = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i in range(0, len(trip), CHUNK):
            yield trip[i : i + CHUNK], person[i : i + CHUNK]


def _shared(trips: DataFrame, w: World):
    return trips.sparkSession.sparkContext.broadcast(tuple(w.__dict__.values()))


def simulate_legs(trips: DataFrame, w: World, config: SimConfig) -> DataFrame:
    """Start and target of every leg."""
    shared = _shared(trips, w)

    def run(batches):
        w = World(*shared.value)
        ids = np.array(w.ids, object)
        for trip, person in _batches(batches):
            for leg, who, start, target, is_exit in legs_of(w, trip, config):
                yield pa.RecordBatch.from_arrays([pa.array(trip[who]), pa.array(person[who]), pa.array(np.full(len(who), leg, np.int32)), pa.array(ids[start], pa.string()), pa.array(ids[target], pa.string()), pa.array(np.full(len(who), is_exit))], ["trip", "person", "leg", "start", "target", "is_exit"])

    return trips.select("trip", "person").mapInArrow(run, LEGS)


def simulate_hops(trips: DataFrame, w: World, config: SimConfig) -> DataFrame:
    """Every hop of every trip (segment choice)."""
    shared = _shared(trips, w)

    def run(batches):
        w = World(*shared.value)
        ids = np.array(w.ids, object)
        for trip, person in _batches(batches):
            for leg, hop, who, src, dst in walked(w, config, trip):
                n = len(who)
                yield pa.RecordBatch.from_arrays([pa.array(trip[who]), pa.array(person[who]), pa.array(np.full(n, leg, np.int32)), pa.array(np.full(n, hop, np.int32)), pa.array(ids[src], pa.string()), pa.array(ids[dst], pa.string())], ["trip", "person", "leg", "hop", "src", "dst"])

    return trips.select("trip", "person").mapInArrow(run, HOPS)


def simulate_exposures(trips: DataFrame, w: World, config: SimConfig) -> DataFrame:
    """M7 inside the walk: passages are counted as trips go, so hops are never written. Only (trip, panel) rows leave."""
    shared = _shared(trips, w)

    def run(batches):
        w = World(*shared.value)
        width, n_panels = w.neighbours.shape[1], len(w.panels)
        names = np.array(w.panels, object)
        for trip, person in _batches(batches):
            inside = np.zeros((len(trip), n_panels), bool)
            contacts = np.zeros((len(trip), n_panels), np.int64)
            for _, _, who, src, dst in walked(w, config, trip):
                slot = src * width + (w.neighbours[src] == dst[:, None]).argmax(1)
                first, size = w.view_first[slot], w.view_first[slot + 1] - w.view_first[slot]
                at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                t, p = np.repeat(who, size), w.view_panel[at]
                contacts[t, p] += w.view_rises[at] + (w.view_first_hit[at] & ~inside[t, p])
                if config.candidates == "floor":  # panels of the floor that are far away are looked at, and not seen
                    inside[who] &= w.panel_level[None, :] != w.level[src][:, None]
                inside[t, p] = w.view_last_hit[at]
            t, p = np.nonzero(contacts)
            yield pa.RecordBatch.from_arrays([pa.array(trip[t]), pa.array(person[t]), pa.array(names[p], pa.string()), pa.array(contacts[t, p])], ["trip", "person", "panel_id", "contacts"])

    return trips.select("trip", "person").mapInArrow(run, EXPOSURES)


def shortest_hops(legs: DataFrame, found: DataFrame) -> DataFrame:
    """M5: hops of legs along shortest paths (source, target, path); none where there is no way."""
    ways = found.select(F.col("source").alias("start"), "target", "path").where(F.size("path") > 1)
    return P.path_hops(legs.select("trip", "person", "leg", "start", "target").join(ways, ["start", "target"])).select("trip", "person", "leg", F.col("hop").cast("int").alias("hop"), "src", "dst")


def reachable_views(views: DataFrame) -> DataFrame:
    """Summaries that can matter to the walk kernel: with a hit somewhere. For floor candidates the kernel resets what
    has no row; for grid candidates rows without a hit end a view and stay."""
    return views.where("first_hit OR last_hit OR rises > 0")
