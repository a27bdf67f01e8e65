"""Benchmark decontamination: BM25 retrieval with block-max WAND, verified by question and answer overlap.

The test items form an inverted index; every passage of every document is a query. A passage is a window of two
segments that advances by one, and a segment is as long as the longest item of its length class, so an item that is
quoted anywhere lies in one window. A window's score for an item is BM25 over distinct terms divided by the score of
the item's own text: 1 if the window has all its terms. Items are numbered in blocks of BLOCK, and every term has its
largest impact in each block.

Retrieval is block-max WAND with the threshold fixed, for all windows of a batch at once. A window's terms stand by
falling bound; the pivot is where the bounds of what follows no longer reach a share of the threshold. Only postings before the
pivot are read; their block maxima and the bounds behind the pivot decide which blocks stay, then the block maxima behind
it, looked up for these blocks alone, and only items of blocks that are left are scored. All items at or above the
threshold are retrieved.

A retrieved item is verified on five-word shingles: the share of the question's shingles and of the answer's that the
window holds must each reach OVERLAP. An item's answer is what follows its last question mark, else its last line, else its
last sentence; an item of one sentence is all question.

Scale: benchmarks of at most INDEX_BYTES of text are indexed once, on the driver, with array code (100,000 items take
seconds), and the arrays are broadcast: one scan of the documents, no shuffle but that of the found pairs. For a larger
benchmark the same statistics are computed by aggregation and every item is found by the terms before its own pivot: a
window that reaches the threshold holds at least one of them. Segments and items meet in a join on these terms, and only
windows that met an item are read again, scored and verified; nothing of it is broadcast but the hashes of these terms
where they fit in TERM_BYTES. Working memory is bounded by BATCH_BYTES of text and EXPAND postings. Documents are whole
in a batch, however long.

Defined cases: null or empty items are never found, nor are null or empty documents; items under five words must occur
as a whole; items that share an id are one item of several texts; rows that share a doc_id are one document of several
texts; ids may have any type that can be grouped; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strider.llm.common import BATCH_BYTES, bounded_batches, slices, table
from strider.storage import shared_dir, written

K1, B = 1.2, 0.75
SHINGLE, OVERLAP, THRESHOLD = 5, 0.5, 0.3
#: Rounding that sums of single-precision impacts may differ by.
SLACK = 1e-5
BLOCK, INDEX_BYTES, TERM_BYTES, EXPAND = 2, 16 << 20, 64 << 20, 2_000_000
#: Where the pivot stands: what follows it is bounded by this share of the threshold. The smaller, the more postings are
#: read in order and the fewer are looked up.
PIVOT = 0.5
#: Entries of a table that finds postings by term and block without a search.
PLACES = 8_000_000
#: Length classes: items of up to 64 words, 256, 1024, ...
CLASS_WORDS, CLASS_STEP = 64, 4
WORD = r"[^\p{L}\p{N}]+"


def tokens(texts: pa.Array) -> pa.ListArray:
    return pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), WORD)


def question_and_answer(text: str) -> tuple[str, str]:
    text = text.strip()
    if "?" in text[:-1]:
        at = text.rindex("?", 0, len(text) - 1) + 1
    elif "\n" in text:
        at = text.rindex("\n")
    else:
        ends = [m.end() for m in re.finditer(r"[.!?;:](?=\s)", text)]
        at = ends[-1] if ends else len(text)
    return text[:at], text[at:]


def length_class(n_words):
    """The longest item of the class of items with so many words."""
    size = np.full(np.shape(n_words), CLASS_WORDS, np.int64)
    while (size < n_words).any():
        size = np.where(size < n_words, size * CLASS_STEP, size)
    return size


def impact(idf, tf, n_words, mean):
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_words / mean))


def idf_of(n_items, df):
    return np.log(1 + (n_items - df + 0.5) / (df + 0.5))


def encoded(split: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, their numbers in order, where each row begins (n + 1)); empty strings are no words."""
    flat = split.flatten().dictionary_encode()
    offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.empty(0, np.int64)
    blank = pc.index(flat.dictionary, "").as_py()
    if blank < 0:
        return flat.dictionary, codes, offsets
    real = codes != blank
    return flat.dictionary, codes[real], np.concatenate(([0], np.cumsum(real)))[offsets]


@dataclass
class Index:
    """The items of one length class, terms numbered by the vocabulary of the benchmark."""

    segment: int
    items: np.ndarray  # numbers of the items
    first: np.ndarray  # per term, where its block postings begin
    keys: np.ndarray  # of block postings: term * n_blocks + block, rising
    lanes: np.ndarray  # per block posting, the impact on each item of the block
    maxima: np.ndarray  # and the largest
    bounds: np.ndarray  # per term, the largest of all
    places: np.ndarray | None  # posting by key, or -1

    @property
    def n_blocks(self) -> int:
        return -(-len(self.items) // BLOCK)


@dataclass
class Benchmark:
    ids: list
    vocabulary: pa.Array
    words: np.ndarray  # of all items, question before answer
    begin: np.ndarray
    split: np.ndarray  # where the answer begins
    indexes: list[Index]
    known: dict = field(default_factory=dict)

    def parts(self, item: int) -> tuple[set, set]:
        """Shingles of an item's question and answer."""
        if item not in self.known:
            a, b, c = self.begin[item], self.split[item], self.begin[item + 1]
            self.known[item] = shingles(self.words[a:b].tolist()), shingles(self.words[b:c].tolist())
        return self.known[item]


def shingles(words: list) -> set[tuple]:
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def build(rows: list[tuple[object, str]]) -> Benchmark:
    """Indexes items (id, text)."""
    rows = [r for r in rows if r[1]]
    n = len(rows)
    parts = [question_and_answer(t) for _, t in rows]
    vocabulary, codes, at = encoded(tokens(pa.array([q for q, _ in parts] + [a for _, a in parts], pa.large_string()).cast(pa.string())))
    sizes = np.diff(at)
    order = np.repeat(np.concatenate((2 * np.arange(n), 2 * np.arange(n) + 1)), sizes)  # question, answer, question, ...
    words = codes[np.argsort(order, kind="stable")]
    n_q, n_words = sizes[:n], sizes[:n] + sizes[n:]
    begin = np.concatenate(([0], np.cumsum(n_words)))
    item = np.repeat(np.arange(n), n_words)
    classes = length_class(n_words)
    indexes, v = [], len(vocabulary)
    for size in np.unique(classes[n_words > 0]):
        mine = np.flatnonzero((classes == size) & (n_words > 0))
        place = np.full(n, -1)
        place[mine] = np.arange(len(mine))
        chosen = place[item] >= 0
        pair, tf = np.unique(words[chosen] * len(mine) + place[item[chosen]], return_counts=True)  # by term, then item
        term, own = pair // len(mine), pair % len(mine)
        df = np.bincount(term, minlength=v)
        x = impact(idf_of(len(mine), df[term]), tf, n_words[mine][own], n_words[mine].mean())
        x = x / np.bincount(own, x, minlength=len(mine))[own]
        n_blocks = -(-len(mine) // BLOCK)
        keys, where = np.unique(term * n_blocks + own // BLOCK, return_inverse=True)
        lanes = np.zeros((len(keys), BLOCK), np.float32)
        lanes[where, own % BLOCK] = x
        maxima = lanes.max(1)
        first = np.searchsorted(keys, np.arange(v + 1) * n_blocks)
        bounds = np.zeros(v, np.float32)
        np.maximum.at(bounds, keys // n_blocks, maxima)
        places = None
        if v * n_blocks <= PLACES:
            places = np.full(v * n_blocks, -1, np.int32)
            places[keys] = np.arange(len(keys))
        indexes.append(Index(int(size), mine, first, keys, lanes, maxima, bounds, places))
    return Benchmark([r[0] for r in rows], vocabulary, words, begin, begin[:-1] + n_q, indexes)


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... (count of them) for every entry."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


def retrieve(index: Index, window: np.ndarray, term: np.ndarray, n_windows: int, threshold: float, seen: dict | None = None):
    """(window, place of the item, score) at or above the threshold. window and term are distinct pairs, windows rising.

    `seen` counts block postings of the windows' terms ("all"), those read before pivots ("read") and those looked up for
    blocks that stayed ("looked")."""
    seen = {} if seen is None else seen
    floor, n_blocks = threshold - SLACK, index.n_blocks
    bound = index.bounds[term].astype(np.float64)
    some = bound > 0
    window, term, bound = window[some], term[some], bound[some]
    seen["all"] = seen.get("all", 0) + int((index.first[term + 1] - index.first[term]).sum())
    able = np.bincount(window, bound, minlength=n_windows)[window] >= floor  # other windows can reach nothing
    window, term, bound = window[able], term[able], bound[able]
    order = np.lexsort((-bound, window))
    window, term, bound = window[order], term[order], bound[order]
    edges = np.searchsorted(window, np.arange(n_windows + 1))
    sums = np.concatenate(([0.0], np.cumsum(bound)))
    rest = sums[edges[window + 1]] - sums[:-1]  # of a term and those after it
    pivot = rest >= floor * PIVOT
    behind = np.bincount(window, np.where(pivot, 0.0, bound), minlength=n_windows)
    pivots = edges[:-1] + np.bincount(window, pivot, minlength=n_windows).astype(np.int64)
    lead = np.flatnonzero(pivot)
    count = index.first[term[lead] + 1] - index.first[term[lead]]
    seen["read"] = seen.get("read", 0) + int(count.sum())
    lead_edges = np.searchsorted(window[lead], np.arange(n_windows + 1))
    work = np.concatenate(([0], np.cumsum(count)))[lead_edges]  # postings before each window
    s = 0
    while s < n_windows:
        e = min(n_windows, max(s + 1, int(np.searchsorted(work, work[s] + EXPAND, "right")) - 1))
        lo, hi = lead_edges[s], lead_edges[e]
        at = _spread(index.first[term[lead[lo:hi]]], count[lo:hi])
        pair = np.repeat(window[lead[lo:hi]] - s, count[lo:hi]) * n_blocks + index.keys[at] % n_blocks
        if (e - s) * n_blocks <= 8 * EXPAND:
            total = np.bincount(pair, index.maxima[at], minlength=(e - s) * n_blocks)
            left = np.flatnonzero(total > 0)
            total = total[left]
        else:
            left, place = np.unique(pair, return_inverse=True)
            total = np.bincount(place, index.maxima[at])
        stay = total + behind[s:e][left // n_blocks] >= floor
        left, total = left[stay], total[stay]
        for i in range(0, len(left), max(1, EXPAND // 100)):
            part, score = left[i : i + EXPAND // 100], total[i : i + EXPAND // 100]
            w, block = part // n_blocks + s, part % n_blocks
            # block maxima behind the pivot
            owner, value, _ = _looked_up(index, term, pivots[w], edges[w + 1], block, seen)
            stay = score + np.bincount(owner, value, minlength=len(w)) >= floor
            w, block = w[stay], block[stay]
            owner, _, at = _looked_up(index, term, edges[w], edges[w + 1], block, seen)
            for lane in range(BLOCK):
                score = np.bincount(owner, index.lanes[at, lane], minlength=len(w))
                ok = np.flatnonzero((score >= floor) & (block * BLOCK + lane < len(index.items)))
                yield w[ok], block[ok] * BLOCK + lane, score[ok]
        s = e


def _looked_up(index: Index, term: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: np.ndarray, seen: dict):
    """(entry, block maximum, posting) of the terms lo:hi of every entry that have a posting in its block."""
    owner = np.repeat(np.arange(len(lo)), hi - lo)
    key = term[_spread(lo, hi - lo)] * np.int64(index.n_blocks) + block[owner]
    if index.places is not None:
        at = index.places[key]
        hit = at >= 0
    else:
        at = np.minimum(np.searchsorted(index.keys, key), len(index.keys) - 1)
        hit = index.keys[at] == key
    seen["looked"] = seen.get("looked", 0) + int(hit.sum())
    return owner[hit], index.maxima[at[hit]], at[hit]


def shares(parts: tuple[set, set], window: list) -> tuple[float, float]:
    """How much of an item's question and answer a window holds."""
    grams: dict[int, set] = {}
    for n in {len(s) for part in parts for s in part}:
        grams[n] = {tuple(window[i : i + n]) for i in range(len(window) - n + 1)}
    return tuple(sum(s in grams[len(s)] for s in part) / len(part) if part else 1.0 for part in parts)


def n_windows_of(n_words: np.ndarray, segment: int) -> np.ndarray:
    """A window is a segment and the next."""
    n = -(-n_words // segment)
    return np.where(n > 1, n - 1, n)


def search(bench: Benchmark, split: pa.ListArray, threshold: float, overlap: float, seen: dict | None = None):
    """(row, item, score, question overlap, answer overlap) of verified items, for each window."""
    distinct, codes, begin = encoded(split)
    if not len(codes):
        return
    number = pc.index_in(distinct, bench.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    term = number[codes]
    owner = np.repeat(np.arange(len(split)), np.diff(begin))
    known = np.flatnonzero(term >= 0)
    for index in bench.indexes:
        mine = known[index.bounds[term[known]] > 0]
        windows = n_windows_of(np.diff(begin), index.segment)
        base = np.concatenate(([0], np.cumsum(windows)))
        o, v = owner[mine], len(bench.vocabulary)
        seg = (mine - begin[o]) // index.segment
        one, two = seg < windows[o], seg > 0
        pairs = np.unique(np.concatenate(((base[o] + seg)[one] * v + term[mine[one]], (base[o] + seg - 1)[two] * v + term[mine[two]])))
        row_of = np.repeat(np.arange(len(split)), windows)
        for found, items, scores in retrieve(index, pairs // v, pairs % v, int(base[-1]), threshold, seen):
            for k in range(len(found)):
                w, item = int(found[k]), int(index.items[items[k]])
                row = int(row_of[w])
                at = begin[row] + (w - base[row]) * index.segment
                q, a = shares(bench.parts(item), term[at : min(begin[row + 1], at + 2 * index.segment)].tolist())
                if q >= overlap and a >= overlap:
                    yield row, item, float(scores[k]), q, a


FIGURES = "score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs: doc_id, text. items: item_id, text. A row for each document and item found in it, with its best window's
    figures."""
    bounded_batches(docs.sparkSession)
    items = items.select("item_id", "text").where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = _broadcast if total <= index_bytes else _joined
    best = F.max(F.struct(F.least("question_overlap", "answer_overlap").alias("_least"), "score", "question_overlap", "answer_overlap")).alias("_best")
    rows = found(docs.select("doc_id", "text"), items, threshold, overlap).groupBy("doc_id", "item_id").agg(best)
    return rows.select("doc_id", "item_id", "_best.score", "_best.question_overlap", "_best.answer_overlap")


def _typed(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def _broadcast(docs: DataFrame, items: DataFrame, threshold: float, overlap: float) -> DataFrame:
    rows = items.toArrow()  # the caller has checked the size
    bench = build(list(zip(range(len(rows)), rows.column("text").to_pylist())))
    shared = docs.sparkSession.sparkContext.broadcast((bench, rows.column("item_id").combine_chunks()))

    def run(batches):
        bench, item_ids = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = pc.binary_length(texts.fill_null("")).to_numpy().astype(np.int64)
            best: dict[tuple[int, int], tuple] = {}
            for i, j in slices(np.concatenate(([0], np.cumsum(sizes))), BATCH_BYTES):
                for row, item, score, q, a in search(bench, tokens(texts.slice(i, j - i)), threshold, overlap):
                    best[i + row, bench.ids[item]] = max(best.get((i + row, bench.ids[item]), (-1.0,)), (min(q, a), score, q, a))
            if best:
                own, item = (pa.array(x, pa.int64()) for x in zip(*best))
                _, *figures = zip(*best.values())
                yield pa.RecordBatch.from_arrays([ids.take(own), item_ids.take(item), *(pa.array(c, pa.float64()) for c in figures)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return docs.mapInArrow(run, f"{_typed(docs, 'doc_id')}, {_typed(items, 'item_id')}, {FIGURES}")


def _item_terms(items: DataFrame) -> DataFrame:
    """item, size, n_words, term, tf."""

    def run(batches):
        for batch in batches:
            distinct, codes, at = encoded(tokens(batch.column(1)))
            n_words, v = np.diff(at), max(1, len(distinct))
            pair, tf = np.unique(np.repeat(np.arange(len(batch)), n_words) * v + codes, return_counts=True)
            own = pair // v
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(length_class(n_words)[own]), pa.array(n_words[own]), distinct.take(pa.array(pair % v)), pa.array(tf)], ["item", "size", "n_words", "term", "tf"])

    return items.select("item", "text").mapInArrow(run, "item long, size long, n_words long, term string, tf long")


def _segment_terms(docs: DataFrame, sizes: list[int], wanted) -> DataFrame:
    """uid, size, segment, windows (of the document), term: distinct, only wanted terms if these are given."""

    def run(batches):
        for batch in batches:
            lengths = pc.binary_length(batch.column(1).fill_null("")).to_numpy().astype(np.int64)
            for i, j in slices(np.concatenate(([0], np.cumsum(lengths))), BATCH_BYTES):
                distinct, codes, at = encoded(tokens(batch.column(1).slice(i, j - i)))
                owner = np.repeat(np.arange(j - i), np.diff(at))
                place = np.arange(len(codes)) - at[owner]
                if wanted is not None:
                    mine = pc.is_in(distinct, wanted.value).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.empty(0, bool)
                    codes, owner, place = codes[mine], owner[mine], place[mine]
                for size in sizes:
                    table_ = np.unique(np.stack((owner, place // size, codes), 1), axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, j - i).take(pa.array(table_[:, 0])), pa.array(np.full(len(table_), size)), pa.array(table_[:, 1]), pa.array(n_windows_of(np.diff(at), size)[table_[:, 0]]), distinct.take(pa.array(table_[:, 2]))],
                        ["uid", "size", "segment", "windows", "term"],
                    )

    return docs.select("uid", "text").mapInArrow(run, "uid long, size long, segment long, windows long, term string")


def _windows(docs: DataFrame) -> DataFrame:
    """docs: doc_id, uid, text, _at (size and number of windows). uid, size, window, doc_id and the window's words."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                words = [w for w in tokens(batch.column(2).slice(i, 1))[0].as_py() if w]
                at = batch.column(3)[i].as_py()
                for k in range(0, len(at), 1000):
                    part = at[k : k + 1000]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).take(pa.array([i] * n)), pa.array([x["size"] for x in part], pa.int64()), pa.array([x["window"] for x in part], pa.int64()), batch.column(0).take(pa.array([i] * n)),
                         pa.array([words[x["window"] * x["size"] : (x["window"] + 2) * x["size"]] for x in part], pa.list_(pa.string()))],
                        ["uid", "size", "window", "doc_id", "words"],
                    )

    return docs.select("doc_id", "uid", "text", "_at").mapInArrow(run, f"uid long, size long, window long, {_typed(docs, 'doc_id')}, words array<string>")


def _joined(docs: DataFrame, items: DataFrame, threshold: float, overlap: float, term_bytes: int = TERM_BYTES) -> DataFrame:
    """The same for a benchmark of any size: every step is a join or an aggregation on terms, items or windows. A term
    that is before the pivot of an item and common in the documents makes a skewed key of the first join only, which
    adaptive execution splits."""
    spark, out, floor = docs.sparkSession, shared_dir(docs.sparkSession), threshold - SLACK
    items = items.withColumn("item", F.xxhash64("item_id", "text"))
    terms = written(_item_terms(items), f"{out}/terms")
    classes = terms.select("item", "size", "n_words").distinct().groupBy("size").agg(F.count(F.lit(1)).alias("_n"), F.avg("n_words").alias("_mean"))  # a row for each length class
    df = terms.groupBy("size", "term").agg(F.count(F.lit(1)).alias("_df"))
    x = terms.join(df, ["size", "term"]).join(F.broadcast(classes), "size")
    x = x.withColumn("_x", F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_words") / F.col("_mean"))))
    # one row for each item: its terms, rarest first
    by_item = x.groupBy("item", "size").agg(F.sort_array(F.collect_list(F.struct("_df", "term", "_x"))).alias("_t"), F.sum("_x").alias("_sum"))
    by_item = written(by_item.select("item", "size", F.transform("_t", lambda t: F.struct(t["term"].alias("term"), (t["_x"] / F.col("_sum")).alias("x"))).alias("terms")), f"{out}/items")
    before = W.partitionBy("item").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)  # the terms of one item
    leads = by_item.select("item", "size", F.posexplode("terms").alias("_i", "_t")).withColumn("_before", F.coalesce(F.sum("_t.x").over(before), F.lit(0.0)))
    leads = written(leads.where(1 - F.col("_before") >= floor).select("size", F.col("_t.term").alias("term"), "item"), f"{out}/leads")
    distinct = leads.select("term").distinct()
    few = (distinct.agg(F.sum(F.octet_length("term") + 4)).first()[0] or 0) <= term_bytes
    wanted = spark.sparkContext.broadcast(distinct.toArrow().column("term").combine_chunks()) if few else None
    sizes = [r["size"] for r in classes.select("size").orderBy("size").collect()]
    docs = docs.where("text IS NOT NULL").withColumn("uid", F.xxhash64("doc_id", "text")).dropDuplicates(["uid"])
    met = _segment_terms(docs, sizes, wanted).join(leads, ["size", "term"]).select("uid", "size", "segment", "windows", "item").distinct()
    number = F.explode(F.filter(F.array(F.col("segment"), F.col("segment") - 1), lambda w: (w >= 0) & (w < F.col("windows"))))
    met = written(met.select("uid", "size", "item", number.alias("window")).distinct(), f"{out}/met")
    at = met.groupBy("uid").agg(F.collect_set(F.struct("size", "window")).alias("_at"))  # at most the windows of one text
    windows = _windows(docs.join(at, "uid"))
    pairs = met.join(windows, ["uid", "size", "window"]).join(by_item.drop("size"), "item").join(items, "item")

    def run(batches):
        for batch in batches:
            rows = []
            for k, (words, terms, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                held = set(words)
                score = sum(t["x"] for t in terms if t["term"] in held)
                if score >= floor:
                    q, a = shares(tuple(shingles([w for w in tokens(pa.array([part], pa.string()))[0].as_py() if w]) for part in question_and_answer(text)), words)
                    if q >= overlap and a >= overlap:
                        rows.append((k, score, q, a))
            if rows:
                own, *figures = zip(*rows)
                own = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(pa.array(c, pa.float64()) for c in figures)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return pairs.select("doc_id", "item_id", "words", "terms", "text").mapInArrow(run, f"{_typed(docs, 'doc_id')}, {_typed(items, 'item_id')}, {FIGURES}")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontam": op10_decontam}
ORACLE: dict[str, str] = {}
