import collections
import random
import re

import numpy as np
import pytest

from strider.llm import neardup
from strider.llm.shingles import shingle_sets


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed=5, clouds=5, size=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \t", "one two", "one two", "ONE\ttwo", "a b c d", "a b c d e", "É b c d e", "é b c d e"]
    for _ in range(clouds):
        base = rnd.choices(vocabulary, k=rnd.choice([6, 12, 40, 200, 240, 700]))
        texts += [" ".join(rnd.choice(vocabulary) if rnd.random() < p else w for w in base) for p in rnd.choices([0, 0.01, 0.02, 0.03, 0.05, 0.08], k=size)]
    texts += [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 30))) for _ in range(60)] + [" ".join(rnd.choices(vocabulary, k=30_000))] * 2
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("blocks", [(4 << 20, 1000, 16_000), (4_000, 25, 50)])
def test_against_brute_force(documents, monkeypatch, blocks):
    rows = corpus()
    for name, value in zip(("VERIFY", "OUTSIDERS", "OTHERS"), blocks):
        monkeypatch.setattr(neardup, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(documents(rows)).collect()}
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty(spark, documents):
    t = "a b c d e f g"
    df = spark.createDataFrame([(2, t), (2, t), (1, t), (None, t)], "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(2, 1, False), (2, 1, False), (1, 1, True), (None, None, True)], key=str)
    assert neardup.near_duplicates(documents([(1, "x")]).limit(0)).count() == 0


def test_estimate_is_close_and_registers_fit():
    rnd = np.random.default_rng(3)
    worst = []
    for n in (100, 220, 400, 3000):
        for j in (0.5, 0.75, 0.9):
            shared = int(round(2 * n * j / (1 + j)))
            a = np.unique(rnd.integers(0, 2**63, 2 * n, dtype=np.uint64))
            x, y = np.sort(a[:n]), np.sort(np.concatenate((a[:shared], a[n : 2 * n - shared])))
            h, at = np.concatenate((x, y)), np.array([0, n, 2 * n])
            si, sr, li, lr = neardup.sketches(h, at)
            for ids, regs in ((si, sr), (li, lr)):
                if len(ids) == 2:
                    worst.append(abs(neardup.estimate(regs[:1], regs[1:], np.array([n]), np.array([n]))[0] - len(np.intersect1d(x, y)) / len(np.union1d(x, y))))
            assert len(si) == 2 * (n <= neardup.SMALL_MAX) and len(li) == 2 * (n >= neardup.SMALL_MIN)
    assert max(worst) < neardup.MARGIN
    assert neardup.registers(np.array([2**64 - 1], np.uint64))[0] == 0xFFFF


def test_shingle_sets():
    rows = [t for _, t in corpus(clouds=2, size=10)]
    raw = [(t or "").encode() for t in rows]
    h, at = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in raw]))))
    assert np.diff(at).tolist() == [len(shingles(t)) for t in rows]
    seen = collections.defaultdict(set)
    for k, t in enumerate(rows):
        for s in shingles(t):
            seen[s].add(k)
    codes = collections.Counter(c for k in range(len(rows)) for c in set(h[at[k] : at[k + 1]].tolist()))
    assert sorted(codes.values()) == sorted(map(len, seen.values()))


def test_a_cloud_near_the_threshold(spark, documents, monkeypatch):
    """Documents of one blob, many of them not linked: results are exact and sets are copied once for every block."""
    rnd = random.Random(12)
    vocabulary = [f"w{i}" for i in range(500)]
    base = rnd.choices(vocabulary, k=120)
    rows = [(i, " ".join(rnd.choice(vocabulary) if rnd.random() < 0.035 else w for w in base)) for i in range(300)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(documents(rows)).collect()}
    assert got == brute(rows)
    copies = []
    for n in (100, 300):
        sets = neardup.shingled(documents(rows[:n]))
        blobs = spark.createDataFrame([(0, i, i) for i, _ in rows[:n]], "blob long, doc_id long, component long")
        plan = neardup.linked_within(blobs, sets)
        copies.append(plan.count())
        assert copies[-1] < n
    with pytest.raises(TypeError):
        neardup.near_duplicates(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
