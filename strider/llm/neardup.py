"""Near duplicates with HyperMinHash.

A document is its set of distinct five-word shingles. Its sketch has REGISTERS registers; each keeps, of the smallest
hash that fell into it, the number of leading zeros (6 bits) and the MANTISSA bits after the leading one. Large sets fill
GROUPS independent sketches of a few buckets each, small sets one bucket in each of REGISTERS sketches, so no register
stays empty for want of shingles; sizes between SMALL_MIN and SMALL_MAX do both, so that any two sets similar enough
to link have a scheme in common. Registers are banded, BAND to a band. Documents that share a band are compared by the
collision-corrected Jaccard estimate, those near the threshold by their full shingle sets.

A pair at similarity 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6, and falls under the estimate's margin
of five standard errors with 3e-7.

No pairs are listed within a group. Documents with equal sets are one class, represented by the smallest id. In a band's
group each member is first compared with the smallest one (a star); the links give components; only groups that still
hold several components are looked at again, their members outside the group's first component against all members by
the estimate, in blocks of bounded size that emit a forest of what passes. The trees (blobs) hold every pair that may
still link; their documents are verified by full sets, those outside the blob's largest component against all, again in
blocks of bounded size that emit a forest. Pairs inside one component need no check.

Scale: texts are read once for the sketches and shuffled once, those of documents that share a band with another; what
else is shuffled is ids, band keys and sketches. Group minima are aggregated before shuffles and joined back, so AQE can
split a hot group. Components are found by alternating stars over written edge tables. Documents of one group that are
near the threshold but not linked are compared pairwise: work that is quadratic in such documents. Blocks are bounded by
bytes (VERIFY of 64-bit shingles, OUTSIDERS and OTHERS sketches), so memory is not; a document's set is copied once for
every VERIFY bytes of what it is compared with, which is once or a few times up to some ten thousand documents in a blob.

Defined cases: null and empty texts, and texts of white space, have an empty set, no links and are kept; fewer than five
words are one shingle; rows that share a doc_id are one node; a null doc_id links to nothing; ids must be integers
(anything else is refused); empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.llm.common import bounded_batches, byte_view, integer_ids, mix64, slices, table
from strider.storage import remove, shared_dir, written
from strider.operators.components import components
from strider.llm.shingles import shingle_sets

SIZE, NUM, DEN = 5, 75, 100
REGISTERS, GROUPS, BAND, MANTISSA = 128, 8, 4, 10
BUCKETS = REGISTERS // GROUPS
SMALL_MAX, SMALL_MIN = 256, 192
#: Five standard errors of an estimate from REGISTERS registers at the threshold.
MARGIN = 5 * (0.75 * 0.25 / REGISTERS) ** 0.5
#: HyperMinHash's constant for accidental register collisions.
COLLISION = 0.169919487159739
#: Members of a mixed group that one task compares: outsiders by all others.
OUTSIDERS, OTHERS = 4_000, 32_000
#: Bytes of shingle sets in a block that is verified against another.
VERIFY = 2 << 20
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
FEATURES = "doc_id long, n_shingles long, f1 long, f2 long, small binary, large binary"
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("small", pa.binary()), ("large", pa.binary())])
_SEEDS = mix64(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _permuted(h: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | np.uint64(1))


def registers(low: np.ndarray) -> np.ndarray:
    """Smallest hashes as leading zeros and mantissa in 16 bits; all ones if the bucket is empty."""
    exponent = np.frexp(low.astype(np.float64))[1].clip(1, 64)
    top = low << (64 - exponent).astype(np.uint64)
    out = ((64 - exponent).astype(np.uint16) << np.uint16(MANTISSA)) | ((top >> np.uint64(63 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)
    out[low == EMPTY] = 0xFFFF
    return out


def sketches(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents with a small sketch, their registers, documents with a large one, their registers)."""
    n = np.diff(at)
    small, large = np.flatnonzero((n > 0) & (n <= SMALL_MAX)), np.flatnonzero(n >= SMALL_MIN)
    out = []
    owner = np.repeat(np.arange(len(n)), n)
    for chosen, few in ((small, True), (large, False)):
        regs = np.full((len(chosen), REGISTERS), EMPTY)
        if len(chosen):
            place = np.full(len(n), -1)
            place[chosen] = np.arange(len(chosen))
            mine = place[owner]
            v, mine = h[mine >= 0], mine[mine >= 0]
            if few:
                first = np.searchsorted(mine, np.arange(len(chosen)))
                for k in range(REGISTERS):
                    regs[:, k] = np.minimum.reduceat(_permuted(v, k), first)
            else:
                flat = regs.reshape(-1)
                for g in range(GROUPS):
                    p = _permuted(v, g)
                    np.minimum.at(flat, mine * REGISTERS + g * BUCKETS + (p >> np.uint64(60)).astype(np.int64), p << np.uint64(4))
        out += [chosen, registers(regs)]
    return tuple(out)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set (f1, f2) and its sketches."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            raw, offsets = byte_view(batch.column(1))
            for i, j in slices(offsets):
                h, at = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SIZE)
                n = np.diff(at)
                with np.errstate(over="ignore"):
                    marks = []
                    for c in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
                        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix64(h ^ c), dtype=np.uint64)))
                        marks.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
                si, sr, li, lr = sketches(h, at)
                small, large = [None] * (j - i), [None] * (j - i)
                for own, rows, to in ((si, sr, small), (li, lr, large)):
                    for k, row in zip(own.tolist(), rows):
                        to[k] = row.astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(n), pa.array(marks[0]), pa.array(marks[1]), pa.array(small, pa.binary()), pa.array(large, pa.binary())], schema=_FEATURES)

    return docs.select("doc_id", "text").mapInArrow(run, FEATURES)


def bands(sets: DataFrame) -> DataFrame:
    """key, doc_id: a row for each band of each sketch."""
    width = 2 * BAND
    one = lambda name, kind: F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda i: F.xxhash64(F.lit(kind), i, F.substring(F.col(name), i * width + 1, F.lit(width))))
    none = F.array().cast("array<bigint>")
    keys = F.concat(F.when(F.col("small").isNotNull(), one("small", 1)).otherwise(none), F.when(F.col("large").isNotNull(), one("large", 2)).otherwise(none))
    return sets.select(F.explode(keys).alias("key"), "doc_id")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of paired sketches (rows of registers), accidental collisions taken off."""
    same = (a == b).sum(1)
    ratio = n_a / np.maximum(n_b, 1)
    accident = COLLISION * REGISTERS / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return (same - accident) / (REGISTERS - accident)


def _likely(a, b, n_a, n_b) -> np.ndarray:
    fits = np.minimum(n_a, n_b) * DEN >= NUM * np.maximum(n_a, n_b)
    return fits & (estimate(a, b, n_a, n_b) >= NUM / DEN - MARGIN)


def _matrix(col) -> np.ndarray:
    out = np.full((len(col), REGISTERS), 0, np.uint16)
    has = [i for i, x in enumerate(col) if x.is_valid]
    if has:
        out[has] = np.frombuffer(b"".join(col[i].as_py() for i in has), "<u2").reshape(-1, REGISTERS)
    return out


def estimated(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose estimate comes near the threshold."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("small").alias(f"small_{x}"), F.col("large").alias(f"large_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") * DEN >= F.greatest("n_a", "n_b") * NUM)
    both = both.select("a", "b", "n_a", "n_b", *[F.when(F.col("small_a").isNotNull() & F.col("small_b").isNotNull(), F.col(f"small_{x}")).otherwise(F.col(f"large_{x}")).alias(f"s_{x}") for x in "ab"])

    def run(batches):
        for batch in batches:
            a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
            ok = _likely(_matrix(batch.column(4)), _matrix(batch.column(5)), n_a, n_b)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok], pa.int64()), pa.array(b[ok], pa.int64())], ["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def shared_sizes(h: np.ndarray, at: np.ndarray, g: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Intersection sizes of paired sorted sets."""
    own, other = np.repeat(np.arange(len(at) - 1), np.diff(at)), np.repeat(np.arange(len(bt) - 1), np.diff(bt))
    keys, rows = np.concatenate((h, g)), np.concatenate((own, other))
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    twice = (keys[1:] == keys[:-1]) & (rows[1:] == rows[:-1])
    return np.bincount(rows[1:][twice], minlength=len(at) - 1)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    bounded_batches(pairs.sparkSession)
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            raw, offsets = byte_view(batch.column(2))
            raw_b, offsets_b = byte_view(batch.column(3))
            keep = np.zeros(len(a), bool)
            for i, j in slices(offsets + offsets_b):
                h, at = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SIZE)
                g, bt = shingle_sets(raw_b[offsets_b[i] : offsets_b[j]], offsets_b[i : j + 1] - offsets_b[i], SIZE)
                both_ = shared_sizes(h, at, g, bt)
                keep[i:j] = (both_ > 0) & (DEN * both_ >= NUM * (np.diff(at) + np.diff(bt) - both_))
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _across(members: DataFrame) -> DataFrame:
    """members: key, doc_id, component, of groups with several components, and n_shingles, sketch.

    Pairs of different components in a group that pass the estimate, thinned to a forest: what comes out connects
    exactly the documents that the pairs connect, with fewer rows than members."""
    groups = members.groupBy("key").agg(F.min("component").alias("first"), F.count(F.lit(1)).alias("_n"))
    rows = members.join(groups, "key").withColumn("_out", F.col("component") != F.col("first"))
    counts = rows.where("_out").groupBy("key").agg(F.count(F.lit(1)).alias("_n_out"))
    rows = rows.join(counts, "key")
    n_out, n_all = F.ceil(F.col("_n_out") / OUTSIDERS), F.ceil(F.col("_n") / OTHERS)
    spot = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), n).cast("int")
    base = ["key", "doc_id", "component", "n_shingles", "sketch"]
    others = rows.select(*base, F.explode(F.sequence(F.lit(0), (n_out - 1).cast("int"))).alias("x"), spot(n_all, 1).alias("y"), F.lit(False).alias("outsider"))
    outsiders = rows.where("_out").select(*base, spot(n_out, 0).alias("x"), F.explode(F.sequence(F.lit(0), (n_all - 1).cast("int"))).alias("y"), F.lit(True).alias("outsider"))

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, comp, n = (t.column(k).to_numpy() for k in ("doc_id", "component", "n_shingles"))
        regs, out = _matrix(t.column("sketch").combine_chunks()), t.column("outsider").to_numpy(zero_copy_only=False)
        mine, rest = np.flatnonzero(out), np.flatnonzero(~out)
        forest = Forest(ids)
        for i in mine:
            js = rest[(comp[rest] != comp[i]) & (np.minimum(n[rest], n[i]) * DEN >= NUM * np.maximum(n[rest], n[i]))]
            if len(js):
                forest.join(i, js[_likely(regs[js], regs[i][None, :], n[js], n[i])])
        return forest.table()

    # blocks of one key go to tasks of their own
    return others.unionByName(outsiders).repartition("key", "x", "y").groupBy("key", "x", "y").applyInArrow(run, "a long, b long").distinct()


class Forest:
    """Joins rows of documents and remembers the edges that joined something new."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.edges = ids, []
        self.label = np.unique(ids, return_inverse=True)[1]

    def join(self, i: int, js: np.ndarray) -> None:
        labels, first = np.unique(self.label[js], return_index=True)
        new = labels != self.label[i]
        if new.any():
            self.edges += [(int(self.ids[i]), int(self.ids[j])) for j in js[first[new]]]
            self.label[np.isin(self.label, labels[new])] = self.label[i]

    def table(self) -> pa.Table:
        a, b = zip(*self.edges) if self.edges else ((), ())
        return pa.table({"a": pa.array(map(min, a, b), pa.int64()), "b": pa.array(map(max, a, b), pa.int64())})


def shingled(texts: DataFrame) -> DataFrame:
    """doc_id, n_shingles, shingles: rising 64-bit hashes as bytes."""

    def run(batches):
        for batch in batches:
            raw, offsets = byte_view(batch.column(1))
            for i, j in slices(offsets):
                h, at = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SIZE)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(np.ascontiguousarray(at * 8)), pa.py_buffer(h.astype("<u8").tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(np.diff(at)), data], ["doc_id", "n_shingles", "shingles"])

    bounded_batches(texts.sparkSession)
    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, shingles binary")


def linked_within(blobs: DataFrame, sets: DataFrame) -> DataFrame:
    """blobs: blob, doc_id, component. sets: doc_id, n_shingles, shingles. Links between different components of a blob,
    by full sets, thinned to a forest.

    What is not in the blob's largest component meets everything in it: blocks of the one and of the other, in a task for
    each pair of blocks, which counts shared shingles through an inverted index."""
    rows = blobs.join(sets, "doc_id")
    parts = rows.groupBy("blob", "component").agg(F.sum(F.col("n_shingles") * 8).alias("_bytes"))
    sizes = parts.groupBy("blob").agg(F.sum("_bytes").alias("_all"), F.max(F.struct("_bytes", "component")).alias("_most")).where(F.col("_all") > F.col("_most._bytes"))
    blocks = lambda b: F.ceil(b / VERIFY).cast("int")
    sizes = sizes.select("blob", F.col("_most.component").alias("_most"), blocks(F.col("_all") - F.col("_most._bytes")).alias("_x"), blocks(F.col("_all")).alias("_y"))
    rows = rows.join(sizes, "blob")
    spot = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), n).cast("int")
    base = ["blob", "doc_id", "component", "n_shingles", "shingles"]
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    others = rows.select(*base, every(F.col("_x")).alias("x"), spot(F.col("_y"), 1).alias("y"), F.lit(False).alias("outsider"))
    outsiders = rows.where("component <> _most").select(*base, spot(F.col("_x"), 0).alias("x"), every(F.col("_y")).alias("y"), F.lit(True).alias("outsider"))

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, comp, n = (t.column(k).to_numpy() for k in ("doc_id", "component", "n_shingles"))
        outsider = t.column("outsider").to_numpy(zero_copy_only=False)
        h = byte_view(t.column("shingles"))[0].view("<u8")
        at = np.concatenate(([0], np.cumsum(n)))
        _, code = np.unique(h, return_inverse=True)
        row = np.repeat(np.arange(len(ids)), n)
        listed = np.flatnonzero(~outsider[row])
        listed = listed[np.argsort(code[listed], kind="stable")]
        begin = np.searchsorted(code[listed], np.arange(int(code.max(initial=-1)) + 2))
        listed = row[listed]
        forest = Forest(ids)
        forest.label = np.unique(comp, return_inverse=True)[1]
        for i in np.flatnonzero(outsider):
            codes = code[at[i] : at[i + 1]]
            size = begin[codes + 1] - begin[codes]
            if not size.sum():
                continue
            where = np.repeat(begin[codes] - np.cumsum(size) + size, size) + np.arange(size.sum())
            both = np.bincount(listed[where], minlength=len(ids))
            js = np.flatnonzero((both > 0) & (forest.label != forest.label[i]))
            js = js[DEN * both[js] >= NUM * (n[js] + n[i] - both[js])]
            if len(js):
                forest.join(i, js)
        return forest.table()

    bounded_batches(blobs.sparkSession)
    # blocks of one blob go to tasks of their own
    return others.unionByName(outsiders).repartition("blob", "x", "y").groupBy("blob", "x", "y").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, component_id and kept for every row."""
    spark, out = docs.sparkSession, shared_dir(docs.sparkSession)
    integer_ids(docs)
    sets = written(features(docs), f"{out}/sets")
    classes = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("class_id"))
    classes = written(classes, f"{out}/classes")
    firsts = written(
        sets.join(classes, (sets["doc_id"] == classes["class_id"]) & (sets["f1"] == classes["f1"]) & (sets["f2"] == classes["f2"])).select(sets["doc_id"], sets["n_shingles"], "small", "large"), f"{out}/firsts"
    )
    # groups of documents that share a band
    rows = bands(firsts)
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last")).where("first < _last").select("key", "first")
    members = written(rows.join(groups, "key").distinct(), f"{out}/members")
    texts = written(docs.select("doc_id", "text").join(members.select("doc_id").distinct(), "doc_id", "left_semi"), f"{out}/texts")
    # stars: every member against the smallest of its group
    stars = members.where("first < doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = written(verified(written(estimated(stars, firsts), f"{out}/near"), texts), f"{out}/links")
    found = components(links)
    # groups that still hold several components
    placed = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    placed = written(placed, f"{out}/placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("key")
    kind = firsts.select("doc_id", "n_shingles", "small", "large")
    again = placed.join(mixed, "key").join(kind, "doc_id")
    # a key belongs to one scheme; the sketch of that scheme
    is_small = F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda i: F.xxhash64(F.lit(1), i, F.substring("small", i * 2 * BAND + 1, F.lit(2 * BAND)))), F.col("key"))
    again = again.withColumn("sketch", F.when(F.coalesce(is_small, F.lit(False)), F.col("small")).otherwise(F.col("large"))).drop("small", "large")
    near = components(written(_across(again), f"{out}/across"))
    blobs = near.select(F.col("node").alias("doc_id"), F.col("component").alias("blob")).join(placed.select("doc_id", "component").distinct(), "doc_id")
    blobs = written(blobs, f"{out}/blobs")
    full = written(shingled(texts.join(blobs.select("doc_id").distinct(), "doc_id", "left_semi")), f"{out}/full")
    all_links = links.unionByName(written(linked_within(blobs, full.dropDuplicates(["doc_id", "n_shingles", "shingles"])), f"{out}/links2"))
    for done in ("firsts", "members", "texts", "near", "placed", "across", "blobs", "full"):
        remove(spark, f"{out}/{done}")
    final = components(all_links).select(F.col("node").alias("class_id"), "component")
    ids = classes.join(final, "class_id", "left").select("n_shingles", "f1", "f2", F.coalesce("component", "class_id").alias("_component"))
    result = sets.select("doc_id", "n_shingles", "f1", "f2").join(ids, ["n_shingles", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("_component", "doc_id"), F.col("doc_id")))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l0 AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
l AS MATERIALIZED (SELECT a, b FROM l0 UNION ALL SELECT b, a FROM l0),
reach(id, other) USING KEY (id) AS (SELECT doc_id, doc_id FROM n UNION SELECT b, min(r.other) FROM reach r JOIN l ON a = r.id JOIN recurring.reach q ON q.id = b WHERE r.other < q.other GROUP BY b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(other, w.doc_id) AS component_id, coalesce(other, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON id = w.doc_id"""

QUERIES = {"op3_neardup": op3_neardup}
ORACLE = {"op3_neardup": ORACLE_SQL}
