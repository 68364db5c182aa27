"""The stages against what plain Python makes of the same rows, and the chat query against its SQL."""

import numpy as np
import pyarrow as pa
from oracle_check import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from stationcast.llm import quality, simhash, toxicity
from stationcast.session import durable

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "simhash", "packing"]
    kept = {}
    frame = docs
    for name in list(stages)[:3]:
        frame = durable(stages[name](spark, frame, SF), name)
        assert frame.schema == docs.schema
        kept[name] = {r.doc_id: r.text for r in frame.collect()}
    rows = docs.collect()
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.in_training())
    clean = {r.doc_id: r.text for r, s in zip(rows, model.scores([r.text for r in rows]), strict=True) if s < 0.5}
    assert kept["toxicity"] == clean
    good = {i: t for (i, t), k in zip(clean.items(), quality.judge(pa.array(list(clean.values())))["kept"], strict=True) if k}
    assert kept["quality"] == good
    ids = sorted(good)
    mark = np.array([simhash.fingerprint(good[i].encode()) for i in ids], np.uint64)
    group = list(range(len(ids)))
    for i in range(len(ids)):  # smallest id reachable, by repeated merging
        for j in np.flatnonzero(np.bitwise_count(mark ^ mark[i]) <= 3):
            a, b = group[i], group[j]
            if a != b:
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert set(kept["simhash"]) == {ids[i] for i, g in enumerate(group) if g == i}
    packed = stages["packing"](spark, frame, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept["simhash"])
    total = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m"))
    assert total.filter("n <> m").count() == 0


def test_run_and_registration(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "sequence_id" in out.columns
    names = [q for q in entry.queries() if q.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))


def test_chat_like_sql(spark):
    for sf in ("/root/testdata/sf0.001", SF):
        problem, rows = compare(spark, connect(sf), sf, entry.queries()["op1_chat_snapshots"], entry.oracle_sql()["op1_chat_snapshots"])
        assert problem is None and rows > 0


def test_chat_plan_is_native(spark, sf):
    out = entry.queries()["op1_chat_snapshots"](spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
