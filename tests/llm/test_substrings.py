import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strider.llm import substrings


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                cover[k : k + 50] = b"\1" * 50
        runs = sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))
        out.append((i, len(b), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    base = "".join(rnd.choice("ab ") for _ in range(3000))
    piece = lambda: (lambda k: rnd.choice([base[k : k + rnd.randint(20, 200)], "a" * rnd.randint(1, 150), "xyz" * rnd.randint(1, 60), "é" * rnd.randint(0, 70)]))(rnd.randint(0, 2800))
    return [(i, "".join(piece() for _ in range(rnd.randint(0, 8)))) for i in rnd.sample(range(1000), 120)] + [(2000, None), (2001, ""), (2002, "short"), (2003, "ab " * 20_000)]


def digests(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.removal(df).collect())


@pytest.mark.parametrize("seed,chunk,merge,hot", [(3, 4 << 20, 400_000, 1 << 18), (4, 2000, 50, 1 << 18), (5, 2000, 50, 500), (6, 1 << 20, 400_000, 0)])
def test_against_brute_force(documents, monkeypatch, seed, chunk, merge, hot):
    """With anchors refined as a whole, in part, and all split up; with places that come along and some that do not."""
    monkeypatch.setattr(substrings, "HOT_LEAST", hot)
    monkeypatch.setattr(substrings, "INLINE", {3: 64, 4: 1, 5: 0, 6: 2}[seed])
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    monkeypatch.setattr(substrings, "MERGE", merge)
    rows = corpus(seed)
    assert digests(documents(rows)) == brute(rows)


def test_repeated_ids_and_empty(spark, documents):
    p, q = "passage " * 10, "another " * 12
    rows = [(1, p), (2, p + q), (2, "x" + q), (2, p + q), (3, q)]
    assert digests(documents(rows)) == brute(rows)
    assert digests(documents(rows).limit(0)) == []
    df = spark.createDataFrame([(None, p), (5, p)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substrings.removal(df).collect()) == [0, 0]


def test_runs_are_returned(documents):
    p, q = "passage " * 10, "another " * 12
    rows = [(1, p), (2, "x" + p + "y"), (3, q), (4, q), (5, None)]
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in substrings.removal(documents(rows)).collect()}
    assert got == {1: [], 2: [(1, 81)], 3: [], 4: [(0, 96)], 5: []}


def test_texts_without_repeats(documents):
    p = "é" * 40
    rows = [(1, p), (2, "x" + p + "yé"), (3, None)]
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["kept"]) for r in substrings.without_repeats(documents(rows)).collect()}
    assert got == {1: (p, 40, "x"), 2: ("xyé", 3, "x"), 3: (None, None, "x")}


def test_a_common_line_is_split(documents, monkeypatch):
    """A line that stands between different texts in every document."""
    rnd = random.Random(7)
    noise = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(90))
    line = "a line that every document has, between other texts of its own. "
    rows = [(i, noise() + line + noise()) for i in range(300)]
    want = brute(rows)
    monkeypatch.setattr(substrings, "HOT_LEAST", 2000)
    assert digests(documents(rows)) == want


def test_clashing_names_and_ids(spark, documents):
    p = "passage " * 10
    rows = [(1, p), (2, "x" + p + "y")]
    df = documents(rows).withColumns({c: F.lit("z") for c in ("copies", "__spans", "Spans_", "places", "a b")})
    got = {r["doc_id"]: r.asDict() for r in substrings.without_repeats(df).collect()}
    assert got[2]["text"] == "xy" and all(got[i][c] == "z" for i in got for c in ("copies", "__spans", "Spans_", "places", "a b")) and set(got[1]) == set(df.columns)
    with pytest.raises(TypeError):
        substrings.removal(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))


def test_refinement_groups_equal_strings():
    rnd = random.Random(9)
    parts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 90))).encode() for _ in range(30)] + [b"a" * 80, b"ab" * 40]
    raw, offsets = np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    starts, bucket = substrings.refine(raw, offsets)
    data = raw.tobytes()
    by = {}
    for s, b in zip(starts.tolist(), bucket.tolist()):
        by.setdefault(b, set()).add(data[s : s + 50])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({data[s : s + 50] for s in starts.tolist()})
    assert len(starts) == sum(max(0, len(p) - 49) for p in parts)
    assert [len(x) for x in substrings.refine(np.empty(0, np.uint8), np.zeros(1, np.int64))] == [0, 0]
