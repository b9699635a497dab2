"""Components of links: equal to brute force, and what a task holds is joined in it, not in rounds of shuffles."""

import random

import pytest

from fuelgrid.llm import simhash


def _roots(links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("chunk", [1 << 18, 5])
def test_components_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    draw = random.Random(3)
    links = [tuple(sorted(draw.sample(range(-60, 60), 2))) for _ in range(50)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 220)]
    got = simhash.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()
    assert {r.node: r.root for r in got} == _roots(links) and len(got) == len(_roots(links))


def test_components_of_structs_order_as_spark_does(spark):
    a, b, c = (False, "9", 1), (False, "é", -4), (True, None, 7)
    df = spark.createDataFrame([(a, b), (b, c)], "a struct<none:boolean,id:string,hash:long>, b struct<none:boolean,id:string,hash:long>")
    assert {tuple(r.node): tuple(r.root) for r in simhash.components(df).collect()} == {a: a, b: a, c: a}


def test_a_chain_in_one_task_takes_no_rounds(spark, monkeypatch):
    tables, written = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df: tables.append(df) or written(df))
    links = spark.range(0, 300, 1, 1).selectExpr("id a", "id + 1 b")
    assert {r.root for r in simhash.components(links).collect()} == {0}
    assert len(tables) == 3  # the links, hung on their least node, and the nodes; each round would write more
