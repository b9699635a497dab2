import numpy as np
from pyspark.sql import functions as F

from fuelgrid.llm import lm

from .test_llm import SF, docs  # noqa: F401


def test_no_task_of_a_score_holds_two_python_workers(spark, docs):  # noqa: F811
    """What is asked, and the spellings: one step each between two shuffles, so one worker a task."""
    plan = lm.score(docs, F.lit(True))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("InArrow") == 4


def test_spellings_reach_their_cells(spark, docs):  # noqa: F811
    counts = lm.token_counts(docs, F.lit(True)).cache()
    shared = spark.sparkContext.broadcast(lm.Sights(lm.predictor_counts(counts)))
    weights, bits, seed = lm.mixing_weights(counts, shared), 48, 3
    want = {lm.hash_of(bytes(r.token), bits, seed): np.float32(r.spelt) for r in lm.spelt_log2(counts, shared, weights).collect()}
    got = {}
    rows = lm.spelt_cells(counts, shared, weights, 5, bits, seed).collect()
    for r in rows:
        h, value = lm.unpacked(bytes(r.data))
        assert (r.block, r.kind) == (-1, 0) and {int(x) * 5 >> bits for x in h} == {r.cell}
        got |= dict(zip(h.tolist(), value.astype("<u4").view("<f4")))
    assert got == want and len(got) == counts.count()
