"""Shortest paths from many sources.

`distances`, `paths` and `path_lengths` run one source per row inside Arrow batches over a broadcast graph of checked size; beyond
BROADCAST_EDGES, and where no source should be searched from by itself, `relaxed_distances` finds all distances with joins.
"""

from __future__ import annotations

import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strider.storage import observed, shared_dir, written

BROADCAST_EDGES = 5_000_000
#: Edges for which an order of elimination is looked for, neighbours that a node may have when it is taken out, the squares
#: of these numbers summed over the nodes, and links there and back that may be held at once.
PLAN_EDGES, MOST_LINKS, MOST_WORK, MOST_LIVE = 500_000, 400, 60_000_000, 1_500_000
#: Labels of sources that are broadcast at once, and products of them and nodes in a task.
START_ROWS, TASK_LABELS = 500_000, 40_000_000
DECISION_TYPES = ("mall_entrance", "shop_entry")


def decision_nodes(nodes: DataFrame) -> DataFrame:
    """Entrances and shops."""
    return nodes.where(F.col("type").isin(*DECISION_TYPES))


class Graph:
    """Adjacency in compressed rows; node numbers follow the sorted ids."""

    def __init__(self, ids: list[str], src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        self.ids = ids
        n = len(ids)
        self.out = [[] for _ in range(n)]
        for u, v, w in zip(src.tolist(), dst.tolist(), weight.tolist()):
            self.out[u].append((v, w))
        by = np.lexsort((weight, dst, src))
        pair = src[by].astype(np.int64) * n + dst[by]
        least = np.flatnonzero(np.diff(pair, prepend=-1))
        self.pair, self.least = pair[least], np.asarray(weight, float)[by[least]]

    def tree(self, source: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances (inf where there is no way) and predecessors (-1); of equal ways the smallest predecessor."""
        n = len(self.ids)
        dist, prev, done = [np.inf] * n, [-1] * n, [False] * n
        dist[source] = 0.0
        heap = [(0.0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            for v, w in self.out[u]:
                alt = d + w
                if alt < dist[v]:
                    dist[v], prev[v] = alt, u
                    heapq.heappush(heap, (alt, v))
                elif alt == dist[v] and not done[v] and u < prev[v]:
                    prev[v] = u
        return np.array(dist), np.array(prev)

    def along(self, prev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and summed weight of the hops of every node's path. Paths of one source share their beginnings: each
        hop is looked up once, and sums double the part of a path that they cover until all begin at its source."""
        hit = np.flatnonzero(prev >= 0)
        hops, length, up = (prev >= 0).astype(np.int64), np.zeros(len(prev)), np.arange(len(prev))
        length[hit] = self.least[np.searchsorted(self.pair, prev[hit] * len(prev) + hit)]
        up[hit] = prev[hit]
        while (up[up] != up).any():
            hops, length, up = hops + hops[up], length + length[up], up[up]
        return hops, length

    def path(self, prev: np.ndarray, source: int, target: int) -> list[int]:
        if target != source and prev[target] < 0:
            return []
        out = [target]
        while out[-1] != source:
            out.append(int(prev[out[-1]]))
        return out[::-1]


def bounded(df: DataFrame, most: int, what: str) -> pa.Table:
    """The rows of a table that must be small; refuses a larger one."""
    rows = df.limit(most + 1).toArrow()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def collected(edges: DataFrame) -> tuple:
    """The directed edges (src, dst, weight, pos) as sorted ids and arrays, for broadcasting; the size is checked."""
    rows = edges.orderBy("src", "pos", "dst").limit(BROADCAST_EDGES + 1).toArrow()
    if len(rows) > BROADCAST_EDGES:
        raise ValueError(f"more than {BROADCAST_EDGES} directed edges: use relaxed_distances")
    src, dst = (rows.column(c).to_numpy(zero_copy_only=False).astype(str) for c in ("src", "dst"))
    ids = np.unique(np.concatenate((src, dst)))
    return ids.tolist(), np.searchsorted(ids, src), np.searchsorted(ids, dst), rows.column("weight").to_numpy()


def _per_source(sources: DataFrame, edges: DataFrame, schema: str, rows_of) -> DataFrame:
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(collected(edges))

    def run(batches):
        graph = Graph(*shared.value)
        number = {v: i for i, v in enumerate(graph.ids)}
        for batch in batches:
            for source in batch.column(0).to_pylist():
                if source in number:
                    yield rows_of(graph, source, *graph.tree(number[source]), number[source])
                else:  # a node without edges reaches itself
                    yield rows_of(Graph([source], np.empty(0, int), np.empty(0, int), np.empty(0)), source, np.zeros(1), np.full(1, -1), 0)

    n = max(1, min(sources.count(), 4 * spark.sparkContext.defaultParallelism))
    return sources.select("id").distinct().repartition(n).mapInArrow(run, schema)


def distances(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """source, node, dist for every node that a source reaches. Unreachable ones have no row."""

    def rows(graph, source, dist, prev, at):
        hit = np.flatnonzero(np.isfinite(dist))
        return pa.RecordBatch.from_arrays([pa.array([source] * len(hit)), pa.array([graph.ids[i] for i in hit]), pa.array(dist[hit])], ["source", "node", "dist"])

    return _per_source(sources, edges, "source string, node string, dist double", rows)


def paths(sources: DataFrame, edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """source, target, dist, path (node ids, both ends included), for all or the given targets."""
    wanted = None if targets is None else set(bounded(targets.select("id").distinct(), BROADCAST_EDGES, "targets").column("id").to_pylist())

    def rows(graph, source, dist, prev, at):
        hit = [i for i in np.flatnonzero(np.isfinite(dist)).tolist() if wanted is None or graph.ids[i] in wanted]
        ways = [[graph.ids[k] for k in graph.path(prev, at, i)] for i in hit]
        return pa.RecordBatch.from_arrays([pa.array([source] * len(hit), pa.string()), pa.array([graph.ids[i] for i in hit], pa.string()), pa.array(dist[hit], pa.float64()), pa.array(ways, pa.list_(pa.string()))], ["source", "target", "dist", "path"])

    return _per_source(sources, edges, "source string, target string, dist double, path array<string>", rows)


def path_lengths(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """M5: source, node, hops, length: the weights of the hops of each of the `paths`, added up without a row or an array
    for its hops, which are far more than the paths."""

    def rows(graph, source, dist, prev, at):
        hit = np.flatnonzero(np.isfinite(dist))
        hops, length = graph.along(prev)
        return pa.RecordBatch.from_arrays([pa.array([source] * len(hit), pa.string()), pa.array([graph.ids[i] for i in hit], pa.string()), pa.array(hops[hit]), pa.array(length[hit])], ["source", "node", "hops", "length"])

    return _per_source(sources, edges, "source string, node string, hops long, length double", rows)


def elimination(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> tuple | None:
    """An order of n nodes in which each is taken out and its neighbours are linked by the ways through it. Returns the
    nodes in order and, by place in it, where the links to later places begin, these places and the weights there and
    back (inf: none). None where a node would keep over MOST_LINKS neighbours, or beyond MOST_WORK or MOST_LIVE, which
    bound the driver's time and memory.

    The next is one with few neighbours that stands on few others, so that parts are taken out side by side."""
    near: list[dict] = [{} for _ in range(n)]
    for u, v, w in zip(src.tolist(), dst.tolist(), weight.tolist()):
        if u != v:
            near[u][v] = min(w, near[u].get(v, np.inf))
            near[v].setdefault(u, np.inf)
    depth, key = [0] * n, [2 * len(x) for x in near]
    live = sum(map(len, near))
    heap = sorted((k, v) for v, k in enumerate(key))
    order, count, work = [], [0], 0
    to, weight_to, weight_from = array("q"), array("d"), array("d")
    while heap:
        k, v = heapq.heappop(heap)
        if k != key[v]:
            continue
        work += len(near[v]) ** 2
        if len(near[v]) > MOST_LINKS or work > MOST_WORK or live > MOST_LIVE:
            return None
        key[v] = -1
        order.append(v)
        links = [(x, near[x].pop(v), there) for x, there in near[v].items()]  # neighbour, weight from and to it
        near[v] = {}
        count.append(len(links))
        for x, from_x, to_x in links:
            to.append(x)
            weight_to.append(to_x)
            weight_from.append(from_x)
        for i, (x, from_x, to_x) in enumerate(links):
            at_x = near[x]
            live -= 2 + 2 * len(at_x)
            for y, from_y, to_y in links[i + 1 :]:
                if from_x + to_y < at_x.setdefault(y, np.inf):
                    at_x[y] = from_x + to_y
                if from_y + to_x < near[y].setdefault(x, np.inf):
                    near[y][x] = from_y + to_x
            live += 2 * len(at_x)
        for x, _, _ in links:
            depth[x] = max(depth[x], depth[v] + 1)
            key[x] = 2 * len(near[x]) + depth[x]
            heapq.heappush(heap, (key[x], x))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return np.array(order, np.int64), np.cumsum(count), place[np.array(to, np.int64)], np.array(weight_to), np.array(weight_from)


def _labels(numbers: DataFrame, plan: tuple) -> DataFrame:
    """num, hub, there, back: the shortest ways by links to later places from each place to every place that it so
    reaches, and back (null: no way). A shortest way between two nodes leads over a hub of both."""
    shared = numbers.sparkSession.sparkContext.broadcast(plan[1:])

    def run(batches):
        first, *links = (x.tolist() for x in shared.value)
        links = list(zip(*links))
        for batch in batches:
            rows = []
            for num in batch.column(0).to_pylist():
                found, heap = {num: (0.0, 0.0)}, [num]
                while heap:
                    x = heapq.heappop(heap)
                    there, back = found[x]
                    for y, t, b in links[first[x] : first[x + 1]]:
                        if y in found:
                            ty, by = found[y]
                            found[y] = (min(ty, there + t), min(by, back + b))
                        else:
                            found[y] = (there + t, back + b)
                            heapq.heappush(heap, y)
                rows += [(num, hub, t, b) for hub, (t, b) in found.items()]
                if len(rows) > 100_000:
                    yield _label_rows(rows)
                    rows = []
            if rows:
                yield _label_rows(rows)

    return numbers.mapInArrow(run, "num int, hub int, there double, back double")


def _label_rows(rows: list[tuple]) -> pa.RecordBatch:
    num, hub, *ways = zip(*rows)
    ways = [pa.array(w, mask=np.isinf(w)) for w in map(np.array, ways)]
    return pa.RecordBatch.from_arrays([pa.array(num, pa.int32()), pa.array(hub, pa.int32()), *ways], ["num", "hub", "there", "back"])


def relaxed_distances(sources: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """The same as `distances` for all sources together. Graphs of up to PLAN_EDGES edges between which few links come
    when nodes are taken out (venues, lattices, roads) get labels, and one join of labels on their hubs gives all
    distances, however many hops they have. Other graphs are relaxed in rounds of joins, one for each hop of the longest
    of the shortest ways."""
    out = shared_dir(edges.sparkSession)
    e = edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")).where("src IS NOT NULL AND dst IS NOT NULL AND weight IS NOT NULL")
    e = written(e, f"{out}/edges")
    rows = e.orderBy("src", "dst").limit(PLAN_EDGES + 1).toArrow()
    if len(rows) <= PLAN_EDGES:
        src, dst = (rows.column(c) for c in ("src", "dst"))
        ends = pa.chunked_array([*src.chunks, *dst.chunks], src.type).combine_chunks().dictionary_encode()
        code = ends.indices.to_numpy()
        plan = elimination(len(ends.dictionary), code[: len(rows)], code[len(rows) :], rows.column("weight").to_numpy())
        if plan:
            return _joined(sources, ends.dictionary, plan, out)
    return _rounds(sources, e, out, max_rounds)


def _joined(sources: DataFrame, ids: pa.Array, plan: tuple, out: str) -> DataFrame:
    """Distances by labels. The sources' labels are broadcast in blocks of START_ROWS; those of a node are together, so
    that what its hubs give for a source is reduced where it arises."""
    spark = sources.sparkSession
    cores = spark.sparkContext.defaultParallelism
    start = sources.select("id").distinct()
    names = spark.createDataFrame(pa.table({"id": ids.take(pa.array(plan[0])), "num": pa.array(np.arange(len(ids)), pa.int32())}))
    names = written(names.repartition(4 * cores), f"{out}/names")
    labels = written(_labels(names.select("num"), plan), f"{out}/labels")
    starts = labels.where("there IS NOT NULL").join(names.join(start, "id").select("num"), "num").select(F.col("num").alias("source"), "hub", "there")
    starts, seen = observed(starts, f"{out}/starts", n=F.count(F.lit(1)), least=F.min("source"))
    blocks = -(-seen["n"] // START_ROWS)
    parts = max(4 * cores, -(-seen["n"] * len(ids) // max(1, blocks) // TASK_LABELS))
    ends = labels.where("back IS NOT NULL").select(F.col("num").alias("node"), "hub", "back").repartition(parts, "node")
    name = lambda c: F.broadcast(names.select(F.col("id").alias(f"_{c}"), F.col("num").alias(c)))
    # a source without edges reaches itself
    found = start.join(names, "id", "left_anti").select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0.0).alias("dist"))
    for k in range(blocks):
        block = starts.where(F.pmod("source", F.lit(blocks)) == k)
        best = ends.join(F.broadcast(block), "hub").groupBy("node", "source").agg(F.min(F.col("there") + F.col("back")).alias("dist"))
        found = found.unionByName(best.join(name("source"), "source").join(name("node"), "node").select(F.col("_source").alias("source"), F.col("_node").alias("node"), "dist"))
    return found


def _rounds(sources: DataFrame, e: DataFrame, out: str, max_rounds: int) -> DataFrame:
    """Distances by relaxing with joins: only what improved in the last round goes on, written to the shared folder."""
    best = sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0.0).alias("dist")).distinct()
    best = front = written(best, f"{out}/start")
    for i in range(max_rounds):
        step = front.join(e, front["node"] == e["src"]).select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("new")).groupBy("source", "node").agg(F.min("new").alias("new"))
        merged = best.join(step, ["source", "node"], "full").select("source", "node", F.least("dist", "new").alias("dist"), (F.col("new") < F.coalesce("dist", F.lit(float("inf")))).alias("better"))
        merged = written(merged, f"{out}/{i}")
        best, front = merged.select("source", "node", "dist"), merged.where("better").select("source", "node", "dist")
        if front.isEmpty():
            return best
    raise RuntimeError("distances did not settle")


def path_hops(found: DataFrame) -> DataFrame:
    """Consecutive nodes of paths: the other columns, hop, src, dst."""
    keep = [c for c in found.columns if c != "path"]
    n = F.size("path")
    pair = lambda i: F.struct((i - 1).alias("hop"), F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst"))
    return found.where(n > 1).select(*keep, F.inline(F.transform(F.sequence(F.lit(1), n - 1), pair)))


def lead_hops(steps: DataFrame, key: list[str], order: str = "pos") -> DataFrame:
    """The same for paths with a row for each node."""
    w = W.partitionBy(*key).orderBy(order)
    return steps.withColumn("dst", F.lead("node").over(w)).where("dst IS NOT NULL").withColumnRenamed("node", "src")
