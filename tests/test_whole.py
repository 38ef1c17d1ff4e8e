"""Queries on tables that are unlike the given ones: ids with gaps, repeats and nulls; brute force over all rows."""

from __future__ import annotations

import random
import threading

import duckdb
from pyspark.sql import functions as F

from marginalia.operators import graph, tagindex
from marginalia.plans import catalog


def test_order_check_with_gaps(spark, tmp_path):
    ids = [k for k in range(-40, 3000) if k % 7 not in (2, 3) and not 500 < k < 900]
    spark.createDataFrame([(k,) for k in reversed(ids)], "doc_id long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalog.QUERIES["order_check"](spark, str(tmp_path)).select("doc_id", "order_check").collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(catalog.ORACLES["order_check"]).fetchall()) and ("rising" in {x for k, x in got if k - 1 not in ids})


def test_prior_with_repeats_and_nulls(spark):
    rows = [(None, 5), *((k % 90, k) for k in range(400)), (None, None)]
    got = tagindex.with_prior(spark.createDataFrame(rows, "a long, b long").repartition(7), ["a", "b"], "b").collect()
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0))
    want = [(*r, before) for r, before in zip(rows, [None, *(r[1] for r in rows[:-1])], strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tagindex.with_prior(spark.createDataFrame([], "a long").withColumn("b", F.col("a")), ["a"], "b").count() == 0


def test_cycles_of_all_parts(spark, tmp_path):
    suppliers, lines = range(1, 12), [(p, (p * p) % 11 + 1 + k) for p in range(1, 60) for k in range(2)]
    spark.createDataFrame([(k,) for k in suppliers], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    up = {s + 10**6: {0: s + 10**6, 1: s + 10**6 + 1, 2: s + 10**6 - 1}.get(s % 5) for s in suppliers}
    up |= {p: min(s for q, s in lines if q == p) + 10**6 for p, _ in lines}
    want = set()
    for k in up:
        seen, at = {k}, up[k]
        while at in up and at not in seen:
            seen.add(at)
            at = up[at]
        want |= {(k, "cycle")} if at in seen else set()
    assert {k % 7 for k, _ in want if k < 60} == {*range(7)}
    assert {tuple(r) for r in catalog.QUERIES["cycle_depth_check"](spark, str(tmp_path)).collect()} == want


def test_closure_of_all_orders(spark, tmp_path):
    orders, lines = [*range(1, 90, 2)], [(o, o * 3 % 50, o % 9) for o in range(1, 100)]
    spark.createDataFrame([(k,) for k in orders], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, k % 4) for k in range(9)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(5)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    to = [(f"o{o}", f"p{p}") for o, p, _ in lines] + [(f"p{p}", f"s{s}") for _, p, s in lines] + [(f"s{k}", f"n{k % 4}") for k in range(9)] + [(f"n{k}", f"r{k % 2}") for k in range(5)]
    want, fresh = set(), {f"o{k}" for k in orders}
    while fresh:
        want |= fresh
        fresh = {b for a, b in to if a in fresh} - want
    got = [r[0] for r in catalog.QUERIES["reachable_closure"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and "o89" in want


def test_faults_of_more_walks_than_a_recursion_holds(spark):
    """More keys than a recursive CTE may have rows; keys with several rows, whose walks part; a key that is its own parent and has others."""
    chains = [(k, k // 3 + 100) for k in range(100)] + [(k, k * k % 37 + 110) for k in range(100, 150)] + [(k, k + 1) for k in range(110, 147, 2)]
    chains += [(200, 200), (200, 201), *((k, k + 1) for k in range(201, 206)), (206, None), (300, 300), (301, 300), *((k, k - 1) for k in range(401, 408)), (400, None)]
    want, limit = set(), 6
    walks = [(k, p, [k]) for k, p in chains if p is not None]
    while walks:
        met = [(k, q, [*seen, at]) for k, at, seen in walks for at_, q in chains if at_ == at]
        want |= {(k, "cycle") for k, q, seen in met if q in seen} | {(k, "depth") for k, q, seen in met if q not in seen and len(seen) > limit}
        walks = [(k, q, seen) for k, q, seen in met if q is not None and q not in seen and len(seen) <= limit]
    assert {(200, "cycle"), (200, "depth"), (301, "cycle"), (407, "depth")} <= want and not {(201, "depth"), (405, "depth")} & want
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        got = [tuple(r) for r in graph.chain_faults(spark.createDataFrame(chains, "id long, parent_id long"), limit=limit).collect()]
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert len(got) == len(set(got)) and set(got) == want


def test_faults_of_walks_that_double_with_every_layer(spark):
    """Two keys a layer, each other's parents: 80 keys have 194 million walks of 32 steps, too many to carry."""
    last = 39
    chains = [(k, k ^ 1) for k in range(2 * last + 2)] + [(k, k + 2) for k in range(2 * last)]
    late = threading.Timer(150, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = [tuple(r) for r in graph.chain_faults(spark.createDataFrame(chains, "id long, parent_id long")).collect()]
    finally:
        late.cancel()
    want = {(k, "cycle") for k in range(2 * last + 2)} | {(k, "depth") for k in range(2 * last + 2) if 2 * (last - k // 2) + 1 > 32}
    assert len(got) == len(set(got)) and set(got) == want and len(want) == 128


def test_faults_of_circles_of_any_length(spark, monkeypatch):
    """Triangles in layers, rings, tails into rings, several rows a key, mates; a few walks at first, so that some keys begin anew."""
    monkeypatch.setattr(graph, "WALKS", 1)
    r, limit, chains = random.Random(3), 8, [(None, 5), (None, None)]
    for base in range(0, 3000, 100):
        n = r.randint(3, 20)
        chains += [(base + a, base + a + 3) for a in range(n)] + [(base + a, base + a + (1 if a % 3 < 2 else -2)) for a in range(n)]
        chains += [(base + 30 + a, base + 30 + (a + 1) % n) for a in range(n)] + [(base + 30 + r.randrange(n), base + 30 + r.randrange(n)) for _ in range(2)]
        chains += [(base + 60 + a, base + 61 + a) for a in range(n)] + [(base + 60 + n, base + 61 + n - r.randint(1, 4))]
        chains += [(base + 85 + a, base + 85 + r.randrange(9)) for a in range(9) for _ in range(r.randint(0, 2))]
    up = {k: [p for k_, p in chains if k_ == k] for k, _ in chains}
    want, walks = set(), [(k, p, (k,)) for k, p in chains if p is not None]
    while walks:
        met = [(k, q, seen, at) for k, at, seen in walks for q in up.get(at, ())]
        bad = lambda q, seen, at: q is not None and (q in seen or q == at)
        want |= {(k, "cycle") for k, q, seen, at in met if bad(q, seen, at)} | {(k, "depth") for k, q, seen, at in met if not bad(q, seen, at) and len(seen) >= limit}
        walks = [(k, q, (*seen, at)) for k, q, seen, at in met if q is not None and not bad(q, seen, at) and len(seen) < limit]
    got = [tuple(x) for x in graph.chain_faults(spark.createDataFrame(chains, "id long, parent_id long"), limit=limit).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {f for _, f in want} == {"cycle", "depth"}
