import os
import random
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strider.llm import decontam


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def parts_of(item):
    """Question and answer, told apart by the rules of the operator's description."""
    item = item.strip()
    for mark in ("?", "\n"):
        if mark in item[:-1]:
            at = item[:-1].rindex(mark) + (mark == "?")
            return item[:at], item[at:]
    ends = [i + 1 for i, c in enumerate(item[:-1]) if c in ".!?;:" and item[i + 1].isspace()]
    return (item[: ends[-1]], item[ends[-1] :]) if ends else (item, "")


def overlaps(docs, items, width):
    """(document, item) pairs whose question and answer overlap by half in some stretch of `width` words, at any word."""
    out = set()
    for i, t in docs:
        w = words(t)
        for j, it in items:
            if not words(it):
                continue
            parts = [shingles(words(p)) for p in parts_of(it)]
            # where shingles of the item stand
            spots = [[(x, s) for x in range(len(w)) for s in p if tuple(w[x : x + len(s)]) == s] for p in parts]
            for start in {x for found in spots for x, _ in found}:
                inside = [{s for x, s in found if start <= x and x + len(s) <= start + width} for found in spots]
                if all(not p or 2 * len(f) >= len(p) for p, f in zip(parts, inside)):
                    out.add((i, j))
                    break
    return out


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)] + ["the", "of"] * 60
    sentence = lambda n: " ".join(rnd.choices(vocabulary, k=n)).capitalize() + "."
    items = [(k, f"{sentence(rnd.randint(6, 20))} {sentence(rnd.randint(5, 12))}") for k in range(30)]
    items += [(30, "What is w1 w2 w3 w4 w5? w6 w7 w8 w9 w10 w11"), (31, None), (32, ""), (33, "w397 w398 w399")]
    docs = [(i, " ".join(sentence(rnd.randint(5, 25)) for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    for i in range(60, 90):
        _, it = items[i - 60]
        noisy = it.upper() if i % 3 else re.sub(r" ", " ### ", it)
        docs.append((i, f"{sentence(rnd.randint(1, 90))} {noisy} {sentence(rnd.randint(1, 90))}"))
    half = items[0][1].split(". ")[0]
    docs += [(90, sentence(30) + half), (91, None), (92, ""), (93, sentence(20_000) + " " + items[5][1]), (94, "x w397 w398 w399 y"), (94, "x w397 w398 w399 y")]
    return docs, items


def test_against_brute_force(spark, documents, case, monkeypatch):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(documents(docs), bench).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(got) == len(pairs)
    # whatever overlaps within the length of the longest item lies in a window; a window is two segments of 64 words
    assert overlaps(docs, items, 35) <= pairs <= overlaps(docs, items, 128)
    assert {(60 + k, k) for k in range(30)} <= pairs and (93, 5) in pairs and (94, 33) in pairs
    assert not {i for i, _ in pairs} & set(range(60)) and (90, 0) not in pairs
    # beyond the size of a broadcast index the same is found by joins, with and without a broadcast of terms
    figures = lambda rows: {(r["doc_id"], r["item_id"]): tuple(round(r[c], 4) for c in ("score", "question_overlap", "answer_overlap")) for r in rows}
    assert figures(decontam.contaminated(documents(docs), bench, index_bytes=400).collect()) == figures(got)
    monkeypatch.setattr(decontam._joined, "__defaults__", (0,))
    assert figures(decontam.contaminated(documents(docs), bench, index_bytes=0).collect()) == figures(got)


def test_ids_of_any_type(spark, documents, case):
    docs, items = case
    bench = spark.createDataFrame([(f"i{i}", t) for i, t in items], "item_id string, text string")
    texts = documents(docs).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    for size in (1 << 20, 0):
        pairs = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(texts, bench, index_bytes=size).collect()}
        assert {(f"d{60 + k}", f"i{k}") for k in range(30)} <= pairs


def test_long_items_and_empty_tables(spark, documents, case):
    docs, items = case
    rnd = random.Random(8)
    long = " ".join(f"v{rnd.randrange(5000)}" for _ in range(900)) + ". And an answer of some words here."
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    got = decontam.contaminated(documents([(7, "before " * 300 + long + " after" * 50), (8, long[:2000])]), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(7, 1)] and got[0]["score"] == pytest.approx(1)
    assert decontam.contaminated(documents(docs), bench.limit(0)).count() == 0
    assert decontam.contaminated(documents(docs).limit(0), bench).count() == 0


def test_pruning_loses_nothing(case):
    """Every item whose exact score reaches the threshold is retrieved, and few postings are looked at."""
    _, items = case
    bench = decontam.build(items)
    (index,) = bench.indexes
    rnd = np.random.default_rng(1)
    n, v = 40, len(bench.vocabulary)
    has = rnd.random((n, v)) < 0.4
    window, term = np.nonzero(has)
    got = {(int(w), int(i)): s for ws, is_, ss in decontam.retrieve(index, window, term, n, 0.45) for w, i, s in zip(ws, is_, ss)}
    assert got
    for w in range(n):
        for i in range(len(index.items)):
            exact = sum(float(index.lanes[k, i % decontam.BLOCK]) for k in range(len(index.keys)) if has[w, index.keys[k] // index.n_blocks] and index.keys[k] % index.n_blocks == i // decontam.BLOCK)
            assert abs(exact - 0.45) < 1e-4 or ((w, i) in got) == (exact >= 0.45)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_postings_read_on_the_test_tables():
    """Postings read before pivots and looked up behind them are well below all postings of the windows' terms."""
    rows = pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist()
    bench = decontam.build([(r["item_id"], r["text"]) for r in rows])
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).combine_chunks()
    seen = {}
    assert sum(1 for _ in decontam.search(bench, decontam.tokens(texts), decontam.THRESHOLD, decontam.OVERLAP, seen))
    assert seen["read"] + seen["looked"] < 0.8 * seen["all"]


def test_a_large_benchmark_is_indexed_in_seconds():
    rnd = random.Random(6)
    vocabulary = [f"w{k}" for k in range(50_000)]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=30)) + "? " + " ".join(rnd.choices(vocabulary, k=5))) for i in range(100_000)]
    began = time.time()
    bench = decontam.build(rows)
    assert time.time() - began < 20 and len(bench.ids) == 100_000


def test_question_and_answer():
    assert decontam.question_and_answer("Why so? Because.") == ("Why so?", " Because.")
    assert decontam.question_and_answer("a\nb\nc") == ("a\nb", "\nc")
    assert decontam.question_and_answer("One. Two. Three") == ("One. Two.", " Three")
    assert decontam.question_and_answer("One") == ("One", "")
