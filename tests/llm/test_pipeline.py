import glob
import os
import random

import duckdb
import pytest

import corpus_pipeline as P
from strider.llm import queries

SF = "/root/testdata/sf0.001"
have = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@have
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = queries.queries()[name](spark, SF), c.execute(queries.oracle_sql()[name])
    names = sorted(got.columns)
    want = [dict(zip([d[0] for d in want.description], r)) for r in want.fetchall()]
    assert sorted(str([r[n] for n in names]) for r in got.collect()) == sorted(str([r[n] for n in names]) for r in want)


@have
def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert 0 < docs.count() <= n
    want = sorted(map(str, P.STAGES[-1][1](spark, docs, SF).collect()))
    assert sorted(map(str, P.run(spark, SF).collect())) == want


def test_planted_cases(spark, tmp_path):
    rnd = random.Random(2)
    words = [a + b + c for a in ("ba", "ki", "lo", "mer", "tan") for b in ("su", "ve", "no", "ri") for c in ("", "s", "ten", "da")]
    text = lambda n: " ".join(rnd.choices(words, k=n)).capitalize() + "."
    docs = {i: text(80) for i in range(40)}
    item, passage = text(30) + " " + text(8), text(60)
    copy = docs[1].split()
    copy[10] = "changed"
    docs |= {50: docs[0], 51: " ".join(copy), 52: text(40) + " " + item + " " + text(30), 53: text(50) + passage, 54: passage + " " + text(50), 55: "12 34 !!", 56: None, 57: ""}
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), "extra") for i, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, note string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        df = spark.createDataFrame(stage(spark, df, str(tmp_path)).collect(), df.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in df.collect()}
    clean = set(range(40)) | {53, 54}
    assert set(kept["language ID"]) == clean | {50, 51, 52}
    assert set(kept["MinHash near-dedup"]) == clean | {52}
    cut = kept["suffix-array dedup"]
    assert passage in cut[53] and passage not in cut[54] and all(cut[i] == docs[i] for i in range(40))
    assert set(kept["benchmark decontamination"]) == clean
    mixed = P.STAGES[-1][1](spark, df, str(tmp_path)).collect()
    assert {r["doc_id"] for r in mixed} == clean


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
