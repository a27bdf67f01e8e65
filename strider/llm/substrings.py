"""Substring dedup: every byte that a LENGTH-byte string covers which also starts in a document with a smaller id.

Strings meet by anchors. The anchor of a string is the smallest hash among its q-grams, so equal strings have equal
anchors, and consecutive strings of a text mostly share theirs: a run of them is one context, some 65 bytes for 16
strings. Only contexts whose anchor occurs in more than one text are looked at, and of equal contexts one. Those of an
anchor are gathered and their suffixes sorted to depth LENGTH by bucket-pointer refinement: suffixes start in buckets by
their first q bytes; the members of every bucket that still has several are sorted by the pointers of their later
offsets, which the rounds before have refined, and the pointers are updated in place for the next round. A round follows
pointers of exactly the depth reached so far (a pointer that is refined beyond LENGTH would tell equal strings apart), so
depth doubles; buckets with one member are never touched again. Contexts that hold no string whose hash recurs are left
out of the sort. A final bucket is one string; its smallest document id keeps it, all others lose it.

Equal texts are found first, by digest: of each text only the first document takes part, the others lose all.

Scale: what is shuffled is anchors (8-byte hash and text key), texts by doc_id twice (to meet their shared anchors, and
their spans at the end), distinct contexts by anchor, and places by context. A task merges equal anchors, and equal
contexts with their places, of up to MERGE entries before they are shuffled, so a passage that a third of all documents
share arrives as one row for each MERGE entries and not for each document. A row takes up to INLINE places along to refinement; what is lost at the
places of longer rows follows from a join on the context. A worker holds the rows of one anchor, at most HOT_MOST bytes.
Anchors with more, or with more than a task's share of all (a common line with different text before and after it in every document) are split: their strings are
grouped one by one, as final buckets, with partial aggregation and a join that adaptive execution splits.

Defined cases: null text is empty; texts under LENGTH bytes lose nothing; a string repeated inside one document is no
match; rows that share a doc_id do not match each other and are cut by their own text; a null doc_id neither loses nor
takes; ids must be integers (anything else is refused); empty tables give empty results; further columns, whatever their
names, are ignored by `removal` and passed on by `without_repeats`.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strider.llm.common import bounded_batches, byte_view, fresh, integer_ids, mix64, quoted, slices, table
from strider.storage import observed, remove, shared_dir, written

LENGTH, Q = 50, 20
#: Strings in one context at most; anchors or contexts that a task merges; bytes of texts and of contexts at a time.
RUN, MERGE, SLICE, CHUNK = 64, 400_000, 1 << 20, 1 << 20
#: An anchor's contexts are split from this share of all bytes of contexts and places, which a task should not exceed, but
#: not below the first nor above the second number of bytes, which a worker can refine at once.
SHARE, HOT_LEAST, HOT_MOST = 2000, 1 << 16, 1 << 22
#: Places that a row of contexts takes along.
INLINE = 64
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_PLACE = np.int64(32)


def _grams(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from every position, by doubling and joining powers of two."""
    out, width, have, power = None, 0, _BYTE[raw], 1
    k = 0
    while power <= size:
        if size & power:
            out = have[: len(raw) - power + 1] if out is None else out[: len(raw) - width - power + 1] * _STEPS[k] + have[width : width + len(raw) - width - power + 1]
            width += power
        if 2 * power <= size:
            have = have[:-power] * _STEPS[k] + have[power:]
        power, k = 2 * power, k + 1
    return out


def contexts(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, anchor, first byte, bytes) of the contexts of all strings of `length` bytes; bytes counted within
    the concatenation."""
    n = len(raw)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none.astype(np.uint64), none, none
    with np.errstate(over="ignore"):
        h = mix64(_grams(raw, Q))
    span, width = length - Q + 1, 1
    low = h
    while 2 * width <= span:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
    inside = np.arange(len(low)) + length <= offsets[owner + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none.astype(np.uint64), none, none
    low, owner = low[at], owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(at)))
    if runs.max() > RUN:  # a text that repeats itself: pieces of one run have the same anchor
        pieces = -(-runs // RUN)
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, runs = np.repeat(starts, pieces) + k * RUN, np.minimum(np.repeat(runs, pieces) - k * RUN, RUN)
    return owner[starts], low[starts], at[starts], runs + length - 1


#: low, rest: texts (keys of their digests), not documents.
ANCHORS = "anchor long, low long, rest array<long>"
_ANCHORS = pa.schema([("anchor", pa.int64()), ("low", pa.int64()), ("rest", pa.list_(pa.int64()))])


def anchors(docs: DataFrame) -> DataFrame:
    """anchor, low, rest: an anchor and the texts that hold it, the smallest key and others that a task met. Equal texts
    are one."""
    bounded_batches(docs.sparkSession)

    def merged(hs: list, ids: list) -> pa.RecordBatch:
        h, d = np.concatenate(hs), np.concatenate(ids)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(h)))
        others = np.concatenate(([0], np.cumsum(counts - 1))).astype(np.int32)
        rest = pa.ListArray.from_arrays(pa.array(others, pa.int32()), pa.array(d[~first], pa.int64()), mask=pa.array(counts == 1))
        return pa.RecordBatch.from_arrays([pa.array(h[starts].view(np.int64)), pa.array(d[starts]), rest], schema=_ANCHORS)

    def run(batches):
        hs, ids, held = [], [], 0
        for batch in batches:
            raw, offsets = byte_view(batch.column(0))
            for i, j in slices(offsets, SLICE):
                owner, h, _, _ = contexts(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                data, at = raw[offsets[i] : offsets[j]].tobytes(), (offsets[i : j + 1] - offsets[i]).tolist()
                keys = np.array([text_key(data[a:b]) for a, b in zip(at, at[1:])], np.int64)
                hs.append(h)
                ids.append(keys[owner])
                held += len(h)
                if held >= MERGE:
                    yield merged(hs, ids)
                    hs, ids, held = [], [], 0
        if held:
            yield merged(hs, ids)

    return docs.where("doc_id IS NOT NULL").select("text").mapInArrow(run, ANCHORS)


def text_key(data: bytes) -> int:
    """64 bits of a text's digest, as `digests` has them."""
    return int.from_bytes(hashlib.md5(data).digest()[:8], "big", signed=True)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, md5 and its first 64 bits, of every text."""
    md5 = F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))
    return docs.where("doc_id IS NOT NULL").select("doc_id", md5.alias("md5"), F.conv(F.substring(md5, 1, 16), 16, -10).cast("long").alias("text_key"))


def shared_anchors(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """doc_id, anchors: for the first document of each text the anchors that other texts hold too."""
    w = W.partitionBy("anchor")
    several = (F.min("low").over(w) != F.max("low").over(w)) | F.max(F.col("rest").isNotNull()).over(w)
    rows = anchors(docs).withColumn("_several", several).where("_several")
    each = rows.select("anchor", F.explode(F.concat(F.array("low"), F.coalesce("rest", F.array().cast("array<bigint>")))).alias("text_key"))
    by_text = each.groupBy("text_key").agg(F.collect_set("anchor").alias("anchors"))
    # an id stands for several texts only where rows share it
    return by_text.join(firsts, "text_key").groupBy("doc_id").agg(F.flatten(F.collect_list("anchors")).alias("anchors"))


#: low, high: smallest and largest document; places: document, place, document, place, ...
CONTEXTS = "anchor long, context binary, low long, high long, places array<long>"
_CONTEXTS = pa.schema([("anchor", pa.int64()), ("context", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("places", pa.list_(pa.int64()))])
#: A context in tables without its bytes: the anchor and 128 bits of hash.
KEY = ["anchor", "k1", "k2"]


def _mark(data: bytes) -> int:
    """Tells texts of rows that share a doc_id apart."""
    return zlib.crc32(data) & 0x7FFFFFFF


def shared_contexts(joined: DataFrame) -> DataFrame:
    """joined: doc_id, text, anchors. KEY, bytes, extent and places (text mark and first byte) of the contexts of shared
    anchors."""

    def run(batches):
        held: dict[tuple[int, bytes], list[int]] = {}
        n = 0

        def flush():
            keys = list(held)
            for at in range(0, len(keys), 20_000):
                part = keys[at : at + 20_000]
                docs = [held[k][::2] for k in part]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part], pa.int64()), pa.array([k[1] for k in part], pa.binary()), pa.array(map(min, docs), pa.int64()), pa.array(map(max, docs), pa.int64()), pa.array([held[k] for k in part], pa.list_(pa.int64()))], schema=_CONTEXTS)

        for batch in batches:
            has = batch.column(2).is_valid()
            batch = batch.filter(has)
            if not len(batch):
                continue
            doc = batch.column(0).to_numpy()
            raw, offsets = byte_view(batch.column(1))
            lists = batch.column(2)
            first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            wanted = lists.flatten().to_numpy()
            for i, j in slices(offsets, SLICE):
                part = raw[offsets[i] : offsets[j]]
                owner, h, start, size = contexts(part, offsets[i : j + 1] - offsets[i])
                # members of (text, anchor) pairs asked for
                asked = np.repeat(np.arange(j - i), np.diff(first[i : j + 1]))
                with np.errstate(over="ignore"):
                    pair = lambda o, x: mix64(x ^ mix64(o.astype(np.uint64) + np.uint64(1)))
                    hit = np.isin(pair(owner, h), pair(asked, wanted[first[i] : first[j]].view(np.uint64)))
                data, base = part.tobytes(), offsets[i : j + 1] - offsets[i]
                ids, starts = doc[i:j].tolist(), base.tolist()
                marks = [_mark(data[a:b]) << 32 for a, b in zip(starts, starts[1:])]
                for o, a, s, z in zip(owner[hit].tolist(), h[hit].view(np.int64).tolist(), start[hit].tolist(), size[hit].tolist()):
                    held.setdefault((a, data[s : s + z]), []).extend((ids[o], marks[o] | (s - starts[o])))
                n += int(hit.sum())
                if n >= MERGE // 8:
                    yield from flush()
                    held.clear()
                    n = 0
        yield from flush()

    found = joined.select("doc_id", "text", "anchors").mapInArrow(run, CONTEXTS)
    return found.select("anchor", F.xxhash64("context").alias("k1"), F.xxhash64(F.lit(1), "context").alias("k2"), F.octet_length("context").alias("size"), "context", "low", "high", (F.size("places") / 2).cast("int").alias("n"), "places")


def refine(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a string of `length` bytes starts inside one context, and its bucket: equal exactly if the
    strings are."""
    n = len(raw)
    end = np.repeat(offsets[1:], np.diff(offsets))
    pos = np.arange(n)
    depth = 8
    packed = np.zeros(n, np.uint64)
    for j in range(depth):
        packed[: n - j] = (packed[: n - j] << np.uint64(8)) | raw[j:]
    valid = pos + depth <= end
    bucket = np.zeros(n, np.int64)
    at = np.flatnonzero(valid)
    _, bucket[at], sizes = np.unique(packed[at], return_inverse=True, return_counts=True)
    n_buckets = len(sizes)
    open_ = at[sizes[bucket[at]] > 1]
    while depth < length:
        step = min(depth, length - depth)
        open_ = open_[open_ + depth + step <= end[open_]]
        # a bucket's members sorted by the bucket that their suffix at the later offset lies in
        pairs = bucket[open_] * np.int64(n_buckets + 1) + bucket[open_ + step]
        keys, inverse, sizes = np.unique(pairs, return_inverse=True, return_counts=True)
        bucket[open_] = n_buckets + inverse  # in place; what is not open is alone in its bucket and stays so
        n_buckets += len(keys)
        open_ = open_[sizes[inverse] > 1]
        depth += step
    starts = np.flatnonzero(pos + length <= end)
    return starts, bucket[starts]


def _recurring(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which contexts hold a string whose hash occurs elsewhere as well; no other can hold an equal string."""
    if len(raw) < length:
        return np.zeros(len(offsets) - 1, bool)
    with np.errstate(over="ignore"):
        h = _grams(raw, length)
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(h)]
    at = np.flatnonzero(np.arange(len(h)) + length <= end)
    order = np.argsort(h[at])
    same = h[at][order][1:] == h[at][order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, at[twice], "right") - 1] = True
    return out


def _gathered(raw: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen pieces of a concatenation, concatenated."""
    size = np.diff(offsets)[chosen]
    to = np.concatenate(([0], np.cumsum(size)))
    return raw[np.repeat(offsets[:-1][chosen] - to[:-1], size) + np.arange(to[-1])], to


#: What is lost: at places that came along (doc_id, place, size), or of a distinct context (KEY): all of it in documents
#: other than `low`, and in `low` the runs.
LOST = "doc_id long, place long, size int, anchor long, k1 long, k2 long, low long, run_at array<int>, run_size array<int>"
_RUNS = pa.list_(pa.int32())
_LOST = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("size", pa.int32()), *((c, pa.int64()) for c in (*KEY, "low")), ("run_at", _RUNS), ("run_size", _RUNS)])


def _lists(x: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x.astype(np.int32)))


def _at_places(flat: np.ndarray, row: np.ndarray, low: np.ndarray, size: np.ndarray, runs: np.ndarray, run_at: np.ndarray, run_size: np.ndarray) -> pa.RecordBatch:
    """LOST at places (flat: document, place, ...) of contexts `row`; runs: where each context's runs begin (n + 1)."""
    doc, place = flat[::2], flat[1::2]
    whole = doc > low[row]  # the same context stands in a smaller document
    out = [(doc[whole], place[whole], size[row[whole]])]
    rest = np.flatnonzero(~whole)
    times = np.diff(runs)[row[rest]]
    if times.sum():
        which = _spread(runs[row[rest]], times)
        rest = np.repeat(rest, times)
        out.append((doc[rest], place[rest] + run_at[which], run_size[which]))
    cols = [pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(*out), (np.int64, np.int64, np.int32))]
    return pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(cols[0]), t) for t in _LOST.types[3:])], schema=_LOST)


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... (count of them) for every entry."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


def _lost(rows: pa.Table):
    """LOST of all contexts of some anchors; rows stand sorted by KEY."""
    key = [rows.column(c).to_numpy() for c in KEY]
    first = np.ones(len(rows), bool)
    first[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
    starts, context = np.flatnonzero(first), np.cumsum(first) - 1  # tasks may have sent equal contexts separately
    low, high = np.minimum.reduceat(rows.column("low").to_numpy(), starts), np.maximum.reduceat(rows.column("high").to_numpy(), starts)
    raw, offsets = _gathered(*byte_view(rows.column("context")), starts)
    # what contexts of smaller documents cover, in maximal runs of strings
    chosen = np.flatnonzero(_recurring(raw, offsets))
    at, bucket = refine(*(part := _gathered(raw, offsets, chosen)))
    owner = np.searchsorted(part[1], at, "right") - 1
    keeper = np.full(int(bucket.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(keeper, bucket, low[chosen[owner]])
    gone = keeper[bucket] < low[chosen[owner]]
    mine, s = owner[gone], at[gone]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1] + 1) | (mine[1:] != mine[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(s))[: len(a)] - 1
    run_of, run_at, run_size = chosen[mine[a]], s[a] - part[1][mine[a]], s[b] - s[a] + LENGTH
    runs = np.searchsorted(run_of, np.arange(len(low) + 1))
    places = rows.column("places").combine_chunks()
    came = np.diff(places.offsets.to_numpy()) // 2
    yield _at_places(places.flatten().to_numpy(), np.repeat(context, came), low, np.diff(offsets), runs, run_at, run_size)
    left = np.zeros(len(low), bool)
    left[context[~places.is_valid().to_numpy(zero_copy_only=False)]] = True  # has places elsewhere
    wanted = np.flatnonzero(left & ((high > low) | (np.diff(runs) > 0)))
    if len(wanted):
        count = np.diff(runs)[wanted]
        which, lists = _spread(runs[wanted], count), np.concatenate(([0], np.cumsum(count)))
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(wanted), t) for t in _LOST.types[:3]), *(pa.array(k[starts][wanted]) for k in key), pa.array(low[wanted]), _lists(run_at[which], lists), _lists(run_size[which], lists)], schema=_LOST)


def refined(found: DataFrame) -> DataFrame:
    """LOST from contexts that stand sorted by KEY in their partitions, all of an anchor in one."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            a = batch.column(0).to_numpy()
            # the last anchor may go on in the next batch
            cut = int(np.searchsorted(a, a[-1])) if len(a) else 0
            if size >= CHUNK or batch.nbytes >= CHUNK:
                if held and cut == 0 and held[-1].column(0)[-1].as_py() != a[-1]:
                    yield from _lost(pa.Table.from_batches(held))
                    held, size = [], 0
                elif cut:
                    yield from _lost(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held, size, batch = [], 0, batch.slice(cut)
            if len(batch):
                held.append(batch)
                size += batch.nbytes
        if held:
            yield from _lost(pa.Table.from_batches(held))

    return found.select(*KEY, "context", "low", "high", F.when(F.col("n") <= INLINE, F.col("places")).alias("places")).mapInArrow(run, LOST)


def split_up(found: DataFrame, path: str) -> DataFrame:
    """LOST, by KEY, of contexts of anchors that are too many for one task: every string is a group of its own."""
    one = written(found.groupBy(*KEY).agg(F.first("context").alias("context"), F.min("low").alias("low"), F.max("high").alias("high")), f"{path}/hot")

    def run(batches):
        for batch in batches:
            raw, offsets = byte_view(batch.column(3))
            for i, j in slices(offsets, SLICE // 16):
                counts = np.diff(offsets[i : j + 1]) - LENGTH + 1
                own = np.repeat(np.arange(i, j), counts)
                at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                strings = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[offsets[own] + at]
                strings = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), len(own), [None, pa.py_buffer(np.ascontiguousarray(strings))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(own)) for k in (0, 1, 2, 4)), pa.array(at.astype(np.int32)), strings], [*KEY, "low", "at", "string"])

    strings = written(one.select(*KEY, "context", "low").mapInArrow(run, "anchor long, k1 long, k2 long, low long, at int, string binary"), f"{path}/strings")
    keepers = strings.groupBy("string").agg(F.min("low").alias("_keeper"))
    lost = strings.join(keepers, "string").where("_keeper < low").groupBy(*KEY).agg(F.sort_array(F.collect_list("at")).alias("run_at"))  # at most RUN of a context
    none = F.array().cast("array<int>")
    out = one.join(lost, KEY, "left").where("high > low OR run_at IS NOT NULL")
    return out.select(*KEY, "low", F.coalesce("run_at", none).alias("run_at"), F.coalesce(F.transform("run_at", lambda _: F.lit(LENGTH)), none).alias("run_size"))


def covered(places: DataFrame, results: DataFrame) -> DataFrame:
    """doc_id, place, size of what is lost. places: KEY, size, places of contexts; results: LOST by KEY."""

    def run(batches):
        for batch in batches:
            lists, runs = batch.column(1).offsets.to_numpy(), batch.column(3).offsets.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(batch)), np.diff(lists) // 2)
            yield _at_places(batch.column(1).flatten().to_numpy(), row, batch.column(2).to_numpy(), batch.column(0).to_numpy(), runs - runs[0], *(batch.column(k).flatten().to_numpy() for k in (3, 4))).select(["doc_id", "place", "size"])

    return places.select(*KEY, "size", "places").join(results.select(*KEY, "low", "run_at", "run_size"), KEY).select("size", "places", "low", "run_at", "run_size").mapInArrow(run, "doc_id long, place long, size int")


def removed_spans(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs: doc_id, text. Adds two columns and names them: spans, an array of (place, size), place being the text's mark
    and the first byte, and copies, the digests of an id's texts that a smaller id holds as well, and so lose all."""
    spark, out = docs.sparkSession, shared_dir(docs.sparkSession)
    integer_ids(docs)
    bounded_batches(spark)
    texts = docs.select("doc_id", "text")
    marked = written(digests(texts), f"{out}/digests")
    firsts = written(marked.groupBy("md5", "text_key").agg(F.min("doc_id").alias("doc_id")), f"{out}/firsts")
    named, copied = fresh(docs, "spans", "copies")
    copies = marked.join(firsts.select("md5", F.col("doc_id").alias("_first")), "md5").where("doc_id > _first").groupBy("doc_id").agg(F.collect_set("md5").alias(copied))
    shared = written(shared_anchors(texts, firsts.select("text_key", "doc_id")), f"{out}/anchors")
    size = F.col("size") + 16 * F.least("n", F.lit(INLINE))
    found, seen = observed(shared_contexts(texts.join(shared, "doc_id")), f"{out}/contexts", bytes=F.coalesce(F.sum(size), F.lit(0)))
    limit = max(HOT_LEAST, min(HOT_MOST, seen["bytes"] // SHARE))
    hot = found.groupBy("anchor").agg(F.sum(size).alias("_bytes")).where(F.col("_bytes") > limit).select("anchor")
    hot = written(hot, f"{out}/hot_anchors")
    lost = written(refined(found.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions(*KEY)), f"{out}/lost")
    spans = lost.where("doc_id IS NOT NULL").select("doc_id", "place", "size").unionByName(covered(found.where(F.col("n") > INLINE), lost.where("anchor IS NOT NULL")))
    if not hot.isEmpty():
        split = found.join(hot, "anchor", "left_semi")
        spans = spans.unionByName(covered(split, written(split_up(split, out), f"{out}/split")))
    spans = written(spans, f"{out}/spans")
    for done in ("anchors", "contexts", "hot_anchors", "hot", "strings", "split", "lost"):
        remove(spark, f"{out}/{done}")
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("place", "size")).alias(named))
    return docs.join(by_doc.join(copies, "doc_id", "full"), "doc_id", "left"), named, copied


def cut(data: bytes, places: np.ndarray, sizes: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal removed runs and what is left."""
    if not len(places):
        return [], data
    mine = places >> _PLACE == _mark(data)
    start = np.sort(places[mine] & np.int64(0xFFFFFFFF))
    end = start + sizes[mine][np.argsort(places[mine] & np.int64(0xFFFFFFFF), kind="stable")]
    if not len(start):
        return [], data
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    a = np.flatnonzero(new)
    runs = list(zip(start[a].tolist(), reach[np.append(a[1:], len(start)) - 1].tolist()))
    kept, at = [], 0
    for s, e in runs:
        kept.append(data[at:s])
        at = e
    kept.append(data[at:])
    return runs, b"".join(kept)


def _each(batch: pa.RecordBatch, text: int, spans: int, copies: int):
    """(bytes, runs, kept bytes) of every row."""
    lists, texts, gone = batch.column(spans), batch.column(text).cast(pa.binary()), batch.column(copies)
    first = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
    flat = lists.flatten()
    places, sizes = (x.to_numpy() for x in flat.flatten()) if len(flat) else (np.empty(0, np.int64), np.empty(0, np.int32))
    for i in range(len(batch)):
        data = texts[i].as_py() or b""
        if len(data) >= LENGTH and gone[i].is_valid and hashlib.md5(data).hexdigest() in gone[i].as_py():
            yield data, [(0, len(data))], b""
        else:
            yield data, *cut(data, places[first[i] : first[i + 1]], sizes[first[i] : first[i + 1]])


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, runs (start, end) of every row."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        for batch in batches:
            rows = [(len(data), sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in runs]) for data, runs, kept in _each(batch, 1, 2, 3)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows), schema.types[1:]))], schema=schema)

    spans, named, copied = removed_spans(docs.select("doc_id", "text"))
    return spans.select("doc_id", "text", named, copied).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, runs array<struct<start: long, end: long>>")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their repeated bytes taken out; bytes of a character that was cut in two go as well. A text of
    which nothing is left stays as an empty one; n_chars, where present, is counted anew."""
    bounded_batches(docs.sparkSession)
    fields = docs.schema.fields
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            texts = [(kept if runs else data).decode("utf-8", "ignore") for data, runs, kept in _each(batch, 0, 1, 2)]
            cols = {n: batch.column(3 + i) for i, n in enumerate(x for x in names if x != "text")}
            null = batch.column(0).is_null().to_pylist()
            cols["text"] = pa.array([None if z else t for z, t in zip(null, texts)], pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if z else len(t) for z, t in zip(null, texts)], pa.int64()).cast(batch.column(3 + [x for x in names if x != "text"].index("n_chars")).type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    spans, named, copied = removed_spans(docs)
    return spans.select("text", named, copied, *[quoted(n) for n in names if n != "text"]).mapInArrow(run, ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in fields))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents")).drop("runs")


ORACLE_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS MATERIALIZED (SELECT doc_id, k, md5_number_lower(substr(h, 2 * k + 1, 100)) AS g1, md5_number_upper(substr(h, 2 * k + 1, 100)) AS g2 FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS k FROM d)),
f AS (SELECT g1, g2, min(doc_id) AS first FROM g GROUP BY ALL),
m AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS new FROM g JOIN f USING (g1, g2) WHERE first < doc_id),
i AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM m),
r AS MATERIALIZED (SELECT doc_id, run, min(k) AS a, max(k) + 50 AS b FROM i GROUP BY ALL),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM r),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS runs, max(b) AS last, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""

QUERIES = {"op8_substrings": op8_substrings}
ORACLE = {"op8_substrings": ORACLE_SQL}
