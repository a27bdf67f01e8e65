"""Language identification with segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary. A word (a run of letters, lower-cased,
with the vocabulary's word mark in front) scores the sum over all its segmentations into pieces, computed by a forward
pass; a text scores the product over its words. The probabilities are learned by expectation maximisation, whose
expected piece counts come from the same forward pass and its backward twin.

Learning uses a bounded sample: SAMPLE_DOCS texts of each language (smallest hash of doc_id among the labelled rows of
the training folds) and all their words; a column with more than MAX_LANGS labels is refused. The model is a vocabulary
by languages matrix, the only thing broadcast. Prediction reads whole texts and sums over whole words, however long:
scripts without spaces have sentences for words.

Scale: every language is learned in a task of its own; the sample is chosen on ids alone (a limited ranking per language, pruned before its shuffle); prediction is one
scan without shuffle. A task scores each distinct word once and keeps at most CACHE_WORDS of them; memory follows the
Arrow batch, not the partition, and of a word only the positions that a piece reaches back to are held.

Defined cases: null texts and texts without a letter give `und` with score 0, as does everything when nothing is
labelled; equal scores go to the language that sorts first; repeated rows are predicted alike; empty tables give empty
results; further columns are passed on, and the three that `predict` adds can be named so that none clashes. lang, source
and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strider.llm.common import bounded_batches, mix64, quoted, table
from strider.storage import shared_dir, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE_DOCS = 400
#: Languages whose samples and columns of the model are held; a label column with more is not one of languages.
MAX_LANGS = 500
#: Added to twice the sample: fewer candidates than the sample itself remain with negligible probability.
SPARE = 200
ROUNDS, SMOOTHING, UNKNOWN = 4, 0.05, 1e-7
CACHE_WORDS = 200_000
#: Positions between rescalings; words from LONG on are scored in blocks of SPAN; positions of words at a time.
STEP, LONG, SPAN, BATCH_CELLS = 24, 256, 64, 100_000
MARK, UND = "▁", "und"
#: Probabilities are scaled by this per character, which keeps products between rescalings in range.
SCALE = 16.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The lower-case letter pieces of a sentencepiece vocabulary, with or without the word mark."""
    import os

    import sentencepiece

    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}: pass the path of a sentencepiece model as vocabulary_path")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return sorted({p for p in pieces if (w := p.removeprefix(MARK)).isalpha() and w == w.lower() or p == MARK})


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64), lengths


class Lattice:
    """The pieces that occur in words: ids[k-1][i] is the piece of k characters that starts at character i, or -1."""

    def __init__(self, words: list[str], hashes: np.ndarray, longest: int):
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        self.order = np.array(order, np.int64)
        self.words = [words[i] for i in order]
        cp, self.lengths = _code_points(self.words)
        n = len(cp)
        self.starts = np.cumsum(self.lengths) - self.lengths
        end = np.repeat(self.starts + self.lengths, self.lengths)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(0, n - 1), _BASE))), dtype=np.uint64)[:n]
            inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(0, n - 1), _INVERSE))), dtype=np.uint64)[:n]
            sums = np.concatenate(([np.uint64(0)], np.cumsum(mix64(cp + np.uint64(1)) * power, dtype=np.uint64)))
            self.ids = []
            at = np.arange(n)
            for k in range(1, longest + 1):
                out = np.full(n, -1, np.int32)
                inside = np.flatnonzero(at + k <= end)
                h = mix64((sums[inside + k] - sums[inside]) * inverse[inside] + np.uint64(k))
                place = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
                hit = hashes[place] == h if len(hashes) else np.zeros(len(h), bool)
                out[inside[hit]] = place[hit]
                self.ids.append(out)
        # words are ordered by falling length: those with at least p characters are a prefix
        self.active = np.searchsorted(-self.lengths, -np.arange(int(self.lengths.max(initial=0)) + 2), "right")

    def final(self, prob: np.ndarray) -> np.ndarray:
        """Log of the scaled probability of all segmentations of every word, for each column of prob (pieces + 2 rows:
        the last two are no piece and an unknown character). Only the last positions that a piece reaches are held."""
        n, n_langs, v, k_max = len(self.words), prob.shape[1], len(prob) - 2, len(self.ids)
        ring, logs, out = np.zeros((k_max + 1, n, n_langs)), np.zeros((n, n_langs)), np.zeros((n, n_langs))
        ring[0] = 1.0
        for p in range(1, len(self.active) - 1):
            m = self.active[p]
            acc = np.zeros((m, n_langs))
            for k in range(1, min(p, k_max) + 1):
                ids = self.ids[k - 1][self.starts[:m] + p - k]
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    acc[hit] += ring[(p - k) % (k_max + 1), hit] * prob[ids[hit]]
                if k == 1:
                    miss = np.flatnonzero(ids < 0)
                    acc[miss] += ring[(p - 1) % (k_max + 1), miss] * prob[v + 1]
            ring[p % (k_max + 1), :m] = acc
            ends = slice(self.active[p + 1], m)
            out[ends] = np.log(np.maximum(acc[ends], 1e-300)) + logs[ends]
            if p % STEP == 0:
                top = np.maximum(ring[:, :m].max(0), 1e-300)
                ring[:, :m] /= top
                logs[:m] += np.log(top)
        return out

    def expected(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece, for one language: prob is a column, counts are per word in this order.

        Positions are rescaled in blocks of `step`; sa and sb are the logs of what was taken out."""
        n, v, k_max, longest_word = len(self.words), len(prob) - 2, len(self.ids), len(self.active) - 2
        step = max(STEP, k_max)
        alpha, beta = np.zeros((longest_word + 1, n)), np.zeros((longest_word + 1, n))
        sa, sb = (np.zeros((longest_word // step + 2, n)) for _ in range(2))
        column, unknown = prob[:, 0], prob[v + 1, 0]

        def piece(p: int, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
            """Ids and probabilities of the pieces of k characters that end at p; 0 where there is none."""
            ids = self.ids[k - 1][self.starts[:m] + p - k]
            return ids, np.where(ids >= 0, column[ids], unknown if k == 1 else 0.0)

        alpha[0] = 1.0
        for p in range(1, longest_word + 1):
            m, b = self.active[p], p // step
            if p % step == 0:
                sa[b, :m] = sa[b - 1, :m] + np.log(np.maximum(alpha[max(0, p - k_max) : p, :m].max(0), 1e-300))
            for k in range(1, min(p, k_max) + 1):
                flow = alpha[p - k, :m] * piece(p, k, m)[1]
                alpha[p, :m] += flow if (p - k) // step == b else flow * np.exp(sa[b - 1, :m] - sa[b, :m])
        ends = np.arange(n)
        total = np.log(np.maximum(alpha[self.lengths, ends], 1e-300)) + sa[self.lengths // step, ends]
        beta[self.lengths, ends] = 1.0
        uses, plain = np.zeros(v), counts * np.exp(-total) if longest_word < step else None
        for p in range(longest_word - 1, -1, -1):
            b = p // step
            if (p + 1) % step == 0:
                m = self.active[p + 1]
                sb[b, :m] = sb[b + 1, :m] + np.log(np.maximum(beta[p + 1 : p + 1 + k_max, :m].max(0), 1e-300))
            for k in range(1, min(longest_word - p, k_max) + 1):
                m = self.active[p + k]
                if not m:
                    break
                ids, q = piece(p + k, k, m)
                flow, above = beta[p + k, :m] * q, (p + k) // step
                weight = counts[:m] * np.exp(sa[b, :m] + sb[above, :m] - total[:m]) if plain is None else plain[:m]
                hit = np.flatnonzero(ids >= 0)
                uses += np.bincount(ids[hit], (alpha[p, :m] * flow * weight)[hit], minlength=v)
                beta[p, :m] += flow if above == b else flow * np.exp(sb[above, :m] - sb[b, :m])
        return uses


def piece_hashes(pieces: list[str]) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            cp = mix64(np.array([ord(c) for c in p], np.uint64) + np.uint64(1))
            power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(p) - 1, _BASE))), dtype=np.uint64)
            out[i] = mix64(np.array([(cp * power).sum(dtype=np.uint64) + np.uint64(len(p))], np.uint64))[0]
    return out


@dataclass
class Model:
    langs: list[str]
    hashes: np.ndarray  # of pieces, rising
    prob: np.ndarray  # scaled; pieces + 2 rows, a column for each language
    longest: int

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Natural log of the marginal probability of every word in every language."""
        out = np.zeros((len(words), len(self.langs)))
        short = sorted((i for i, w in enumerate(words) if len(w) < LONG), key=lambda i: -len(words[i]))
        for part in batches([len(words[i]) + 1 for i in short], BATCH_CELLS):
            lat = Lattice([MARK + words[i] for i in short[part]], self.hashes, self.longest)
            out[np.array(short[part])[lat.order]] = lat.final(self.prob) - lat.lengths[:, None] * np.log(SCALE)
        for i, w in enumerate(words):
            if len(w) >= LONG:
                out[i] = self.long_score(MARK + w)
        return out

    def long_score(self, word: str) -> np.ndarray:
        """The same for a word of any length. Where a segmentation stands in it is known from the last `longest`
        positions, so a block of SPAN characters is a matrix from the positions before it to those at its end. The
        matrices of many blocks are computed at once and multiplied in order."""
        k_max, n_langs = max(1, self.longest), len(self.langs)
        blocks = max(1, BATCH_CELLS * 16 // ((k_max + 1) * k_max * n_langs))
        state, logs = np.zeros((k_max, n_langs)), np.zeros(n_langs)  # state[s]: at the character s before
        state[0] = 1.0
        at = 0
        while at < len(word):
            span = min(SPAN, len(word) - at)
            n = min(blocks, (len(word) - at) // span)
            before = min(at, k_max - 1)
            lat = Lattice([word[at - before : at + n * span]], self.hashes, self.longest)
            steps, scales = self._transfer(lat.ids, before + span * np.arange(n), span)
            for step, scale in zip(steps, scales):
                state = np.einsum("sl,stl->tl", state, step)
                top = np.maximum(state.max(0), 1e-300)
                state, logs = state / top, logs + scale + np.log(top)
            at += n * span
        return np.log(np.maximum(state[0], 1e-300)) + logs - len(word) * np.log(SCALE)

    def _transfer(self, ids: list[np.ndarray], first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """For every block that starts at `first`: what a unit at each position before it (s characters back) becomes at
        each of the positions t characters before its end; and the logs of what was taken out."""
        k_max, n, n_langs, v = max(1, self.longest), len(first), len(self.langs), len(self.prob) - 2
        size = k_max + 1
        ring, logs = np.zeros((size, n, k_max, n_langs)), np.zeros((n, n_langs))
        for s in range(k_max):
            ring[-s % size, :, s] = 1.0
        for p in range(1, span + 1):
            acc = np.zeros((n, k_max, n_langs))
            for k in range(1, k_max + 1):
                start = first + p - k
                found = np.where(start >= 0, ids[k - 1][np.maximum(start, 0)], -1) if ids else np.full(n, -1)
                hit = np.flatnonzero(found >= 0)
                acc[hit] += ring[(p - k) % size, hit] * self.prob[found[hit]][:, None, :]
                if k == 1:
                    miss = np.flatnonzero(found < 0)
                    acc[miss] += ring[(p - 1) % size, miss] * self.prob[v + 1]
            ring[p % size] = acc
            if p % STEP == 0 or p == span:
                top = np.maximum(ring.max((0, 2)), 1e-300)
                ring /= top[None, :, None, :]
                logs += np.log(top)
        return np.stack([ring[(span - t) % size] for t in range(k_max)], 2), logs


def batches(sizes: list[int], cells: int):
    """Slices of a falling list of sizes: first size times their number is at most `cells` (one entry at least)."""
    at = 0
    while at < len(sizes):
        n = max(1, cells // max(1, sizes[at]))
        yield slice(at, at + n)
        at += n


@dataclass
class Pieces:
    """A vocabulary: hashes (rising) and lengths of its pieces."""

    hashes: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(pieces: list[str]) -> "Pieces":
        hashes = piece_hashes(pieces)
        rising = np.argsort(hashes)
        return Pieces(hashes[rising], np.array([len(pieces[i]) for i in rising], np.int64))

    @property
    def longest(self) -> int:
        return int(self.lengths.max(initial=1))

    def lattices(self, words: list[str]):
        """(batch of word numbers, lattice) over all words."""
        order = sorted(range(len(words)), key=lambda i: (-len(words[i]), words[i]))
        for part in batches([len(words[i]) + 1 for i in order], BATCH_CELLS):
            lat = Lattice([MARK + words[i] for i in order[part]], self.hashes, self.longest)
            yield np.array(order[part])[lat.order], lat

    def used(self, words: list[str]) -> np.ndarray:
        """Numbers of the pieces that occur in words."""
        out = np.zeros(len(self.hashes), bool)
        for _, lat in self.lattices(words):
            for ids in lat.ids:
                out[ids[ids >= 0]] = True
        return np.flatnonzero(out)

    def only(self, kept: np.ndarray) -> "Pieces":
        return Pieces(self.hashes[kept], self.lengths[kept])

    def learned(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """A column of the model: scaled probabilities of the pieces, learned by expectation maximisation."""
        n, scale = len(self.hashes), SCALE ** self.lengths.astype(np.float64)
        mine = [(lat, counts[which].astype(np.float64)) for which, lat in self.lattices(words)]
        p = np.full(n, 1 / max(1, n))
        column = lambda: np.concatenate((p * scale, [0.0, UNKNOWN * SCALE]))
        for _ in range(ROUNDS):
            uses = sum((lat.expected(column()[:, None], c) for lat, c in mine), np.zeros(n))
            p = (uses + SMOOTHING) / (uses.sum() + SMOOTHING * n)
        return column()


def fit(words: dict[str, dict[str, int]], pieces: list[str]) -> Model:
    """words: per language, counts of words. What `train` does, in this process."""
    langs, vocabulary_ = sorted(words), Pieces.of(pieces)
    # what no training word holds has no evidence for any language
    kept = vocabulary_.only(np.unique(np.concatenate([np.empty(0, np.int64), *(vocabulary_.used(list(words[x])) for x in langs)])))
    columns = [kept.learned(list(words[x]), np.array(list(words[x].values()))) for x in langs]
    return Model(langs, kept.hashes, np.stack(columns, 1) if columns else np.zeros((len(kept.hashes) + 2, 0)), kept.longest)


def held_out(doc_id: Column) -> Column:
    """The fold that learning never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, vocabulary_path: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from labelled rows outside the held-out fold."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # the smallest hashes of each language; those far above the expected cut are left out before they are ranked, so a
    # language of any size sends a few times sample_docs rows to its task
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_all"))
    n_all = counts.limit(MAX_LANGS + 1).collect()
    if len(n_all) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} labels in lang")
    counts = docs.sparkSession.createDataFrame(n_all, "lang string, _all long")
    rank = F.xxhash64("doc_id").cast("double") / F.lit(2.0**64) + 0.5
    near = rows.select("doc_id", "lang").join(F.broadcast(counts), "lang").withColumn("_rank", rank).where(F.col("_rank") * F.col("_all") <= 2 * sample_docs + SPARE)
    place = F.row_number().over(W.partitionBy("lang").orderBy("_rank", "doc_id"))
    ids = near.withColumn("_n", place).where(F.col("_n") <= sample_docs).select("doc_id", "lang").distinct()
    # at most sample_docs ids for each language
    texts = rows.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    words = texts.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''").groupBy("lang", "word").count()
    spark = docs.sparkSession
    words = written(words, f"{shared_dir(spark)}/words")
    every = Pieces.of(vocabulary(vocabulary_path))
    shared = spark.sparkContext.broadcast(every)  # a vocabulary

    def used(parts):
        for batch in parts:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.used(batch.column(0).to_pylist()))], ["piece"])

    kept = every.only(np.sort(words.select("word").mapInArrow(used, "piece long").distinct().toArrow().column(0).to_numpy()))  # of a vocabulary
    shared_kept = spark.sparkContext.broadcast(kept)

    def learn(t: pa.Table) -> pa.Table:
        column = shared_kept.value.learned(t.column("word").to_pylist(), t.column("count").to_numpy())
        return pa.table({"lang": t.column("lang").slice(0, 1), "column": pa.array([column.tobytes()], pa.binary())})

    # a language's words are those of at most sample_docs texts; a column is as long as the vocabulary
    columns = sorted((r["lang"], r["column"]) for r in words.groupBy("lang").applyInArrow(learn, "lang string, column binary").collect())
    prob = np.stack([np.frombuffer(c) for _, c in columns], 1) if columns else np.zeros((len(kept.hashes) + 2, 0))
    return Model([x for x, _ in columns], kept.hashes, prob, kept.longest)


ADDED = ("lang_pred", "score", "n_words")


def predict(docs: DataFrame, model: Model, names: tuple[str, str, str] = ADDED) -> DataFrame:
    """Adds lang_pred, score (posterior of that language) and n_words, under the given names, to documents with a text;
    columns that have one of these names already are replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model.langs, model.hashes, model.prob, model.longest))
    taken = {n.lower() for n in names}
    fields = [f for f in docs.schema if f.name.lower() not in taken]
    at = [f.name for f in fields].index("text")
    docs = docs.select(*[quoted(f.name) for f in fields])

    def run(batches):
        model = Model(*shared.value)
        n_langs = len(model.langs)
        known: dict[str, int] = {}
        table_ = np.zeros((0, n_langs))
        for batch in batches:
            split = pc.split_pattern_regex(pc.utf8_lower(batch.column(at).fill_null("")), r"[^\p{L}]+")
            flat = split.flatten().dictionary_encode()
            ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
            unique = flat.dictionary.to_pylist()
            new = [w for w in unique if w and w not in known]
            if len(known) + len(new) > CACHE_WORDS:
                known, table_, new = {}, np.zeros((0, n_langs)), [w for w in unique if w]
            known |= dict(zip(new, range(len(table_), len(table_) + len(new))))
            table_ = np.concatenate((table_, model.word_scores(new)))
            rows = np.array([known[w] if w else -1 for w in unique], np.int64)
            scores = np.concatenate((table_, np.zeros((1, n_langs))))[rows] if len(rows) else np.zeros((0, n_langs))
            index = flat.indices.to_numpy()
            docs_of = np.repeat(np.arange(len(batch)), np.diff(ends))
            is_word = (rows >= 0)[index] if len(index) else np.zeros(0, bool)
            n_words = np.bincount(docs_of[is_word], minlength=len(batch))
            pred, score = np.full(len(batch), UND, object), np.zeros(len(batch))
            if n_langs:
                total = np.stack([np.bincount(docs_of, scores[index, j], minlength=len(batch)) for j in range(n_langs)], 1)
                best = total.argmax(1)
                posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                has = n_words > 0
                pred[has], score[has] = np.array(model.langs, object)[best[has]], posterior[has]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(n_words.astype(np.int64))], [*batch.schema.names, *names])

    return docs.mapInArrow(run, ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in fields) + ", `{}` string, `{}` double, `{}` long".format(*names))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words")


QUERIES = {"op1_langid": op1_langid}
ORACLE: dict[str, str] = {}
