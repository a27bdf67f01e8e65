import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strider.llm import langid

SYLLABLES = {"aa": ["ba", "ki", "lo", "me"], "bb": ["zu", "xo", "qui", "ver"], "cc": ["sch", "ung", "ei", "ach"]}


def text(lang, n, rnd):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(1)
    rows = [(i, text(lang, rnd.randint(3, 60), rnd), lang) for i, lang in enumerate(rnd.choices(list(SYLLABLES), k=600))]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", None), (1003, "ba" * 30_000, None), (1003, "ba" * 30_000, None), (1004, text("bb", 9, rnd), None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_cases(spark, corpus):
    rows, df = corpus
    got = langid.predict(df.withColumn("score", F.lit("clash")), langid.train(df)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    sure = [r["lang_pred"] == r["lang"] for r in got if r["doc_id"] < 1000]
    assert sum(sure) / len(sure) > 0.99 and all(0 <= r["score"] <= 1 for r in got)
    for i in (1000, 1001, 1002):
        assert (by[i][0]["lang_pred"], by[i][0]["score"]) == ("und", 0.0)
    assert len(by[1003]) == 2 and by[1003][0] == by[1003][1] and by[1003][0]["lang_pred"] == "aa" and by[1004][0]["lang_pred"] == "bb"


def test_forward_pass_sums_all_segmentations():
    rnd = random.Random(2)
    pieces = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "aba", "abab", "c"]
    model = langid.fit({"x": {"ab": 3, "abab": 2, "ba": 4, "cab": 1}, "y": {"aba": 2, "b": 5, "cc": 1}}, pieces)
    number = {h: i for i, h in enumerate(model.hashes.tolist())}
    place = {p: number.get(int(h)) for p, h in zip(pieces, langid.piece_hashes(pieces))}

    def total(word, lang):
        word, v = "▁" + word, len(model.prob) - 2
        ways = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                k = place.get(word[start:end])
                if k is not None:
                    ways[end] += ways[start] * model.prob[k, lang] / langid.SCALE ** (end - start)
                elif end - start == 1:
                    ways[end] += ways[start] * model.prob[v + 1, lang] / langid.SCALE
        return ways[-1]

    def log_total(word, lang):
        """In logarithms, for any length."""
        v = len(model.prob) - 2
        ways = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            terms = []
            for start in range(max(0, end - 5), end):
                k = place.get(word[start:end])
                p = model.prob[k, lang] if k is not None else model.prob[v + 1, lang] if end - start == 1 else 0
                if p:
                    terms.append(ways[start] + math.log(p) - (end - start) * math.log(langid.SCALE))
            top = max(terms)
            ways[end] = top + math.log(sum(math.exp(t - top) for t in terms))
        return ways[-1]

    words = ["".join(rnd.choices("abcd", k=rnd.randint(1, 12))) for _ in range(60)]
    scores = model.word_scores(words)
    for w, s in zip(words, scores):
        for lang in range(2):
            assert s[lang] == pytest.approx(math.log(total(w, lang)), rel=1e-9)
    long = ["".join(rnd.choices("abcd", k=n)) for n in (49, 255, 256, 257, 300, 64 * 5 - 1, 1000)]
    for w, s in zip(long, model.word_scores(long)):
        for lang in range(2):
            assert s[lang] == pytest.approx(log_total("▁" + w, lang), rel=1e-9)
    assert np.isfinite(model.word_scores(["a" * 50_000, "Ж" * 3000])).all()


def test_learning_never_sees_the_held_out_fold(spark, corpus):
    _, df = corpus
    odd = df.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("other")).otherwise(F.col("lang")))
    assert langid.train(odd).langs == ["aa", "bb", "cc"]


def test_nothing_labelled(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    got = langid.predict(df, langid.train(df)).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)
    assert langid.predict(df.limit(0), langid.train(df.limit(0))).count() == 0


def test_expected_uses_are_those_of_all_segmentations():
    """One round of learning against sums over explicit segmentations; long words in a scale of their own."""
    rnd = random.Random(3)
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba"]
    hashes = langid.piece_hashes(pieces)
    order = np.argsort(hashes)
    prob = np.array([0.1, 0.2, 0.3, 0.25, 0.05, 0.15, 0.35, 0.0, 0.01])
    words = ["▁" + "".join(rnd.choices("abc", k=n)) for n in (1, 2, 5, 9, 9, 12)]
    rising = [pieces[i] for i in order]

    def ways(w):
        if not w:
            yield ()
        for k in range(1, min(4, len(w)) + 1):
            if w[:k] in rising or k == 1:
                for rest in ways(w[k:]):
                    yield (w[:k], *rest)

    want = np.zeros(len(pieces))
    for count, w in enumerate(words, 1):
        found = [(s, math.prod(prob[rising.index(x)] if x in rising else prob[-1] for x in s)) for s in ways(w)]
        whole = sum(p for _, p in found)
        for s, p in found:
            for x in s:
                if x in rising:
                    want[rising.index(x)] += count * p / whole
    lat = langid.Lattice(words, hashes[order], 3)
    assert lat.expected(prob[:, None], np.arange(1.0, 7.0)[lat.order]) == pytest.approx(want)
    # a word of many rescalings: its uses cover its characters
    long = "▁" + "".join(rnd.choices("ab", k=2000))
    uses = langid.Lattice([long], hashes[order], 3).expected(prob[:, None], np.ones(1))
    assert (uses * [len(p) for p in rising]).sum() == pytest.approx(len(long))


def test_equal_scores_go_to_the_first_language_and_too_many_labels_are_refused(spark, monkeypatch):
    rows = [(i, "same words here", lang) for i, lang in enumerate(["zz", "aa"] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    words = {"same": 3, "words": 2, "here": 1}
    assert {r["lang_pred"] for r in langid.predict(df, langid.fit({"zz": words, "aa": words}, ["▁", "a", "s", "e", "me"])).collect()} == {"aa"}
    monkeypatch.setattr(langid, "MAX_LANGS", 1)
    with pytest.raises(ValueError):
        langid.train(df)


def test_texts_without_spaces(spark):
    """Words of sentence length, over two scripts' letters."""
    rnd = random.Random(4)
    say = lambda letters: "".join(rnd.choices(letters, weights=range(1, len(letters) + 1), k=rnd.randint(100, 700))) + "。"
    rows = [(i, say("的一是不了人我在有他" if lang == "zh" else "のにはをたがでてとし"), lang) for i, lang in enumerate(["ja", "zh"] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.train(df)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 58


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_documents_of_the_test_tables(spark):
    """Documents that hold a long passage of another language count as they are labelled."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op1_langid(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
