"""Faults that a reviewer found in round 3."""

import tracemalloc

import numpy as np
import pyarrow as pa

from roleloom.llm import embeddings, queries


def _peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_routing_does_not_grow_with_the_splits():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    few, many = embeddings.Forest(x, 1500), embeddings.Forest(x, 8)
    assert many.leaves > 50 * few.leaves
    leaves = many.leaves_of(x[:3])
    assert all((np.diff(v) > 0).all() and len(v) >= embeddings.TREES for v in leaves)
    assert _peak(lambda: many.leaves_of(x)) < 4000 * many.leaves  # bytes; a matrix of projections has eight times as many


def test_comparison_does_not_grow_with_the_leaves():
    rng, n, each = np.random.default_rng(2), 400, 60
    v = rng.standard_normal((n, 8))
    v[n // 2 :] = v[: n // 2]  # pairs of copies
    lists = [np.sort(np.append(rng.choice(20_000, each, replace=False), 30_000)).astype(np.int32) for _ in range(n)]
    lists[n // 2][0] = lists[0][0] = 0  # this pair has an earlier leaf in common
    table = pa.table({
        "block": np.zeros(n, np.int32), "vec_id": np.arange(n), "v": pa.array(list(v)), "leaves": pa.array(lists),
    })
    key = tuple(pa.scalar(k) for k in (1, 8, 30_000, 0, 0))
    run, out = embeddings._compare(0.999), []
    peak = _peak(lambda: out.append(run(key, table)))
    earlier = {i for i in range(n // 2) if set(lists[i][:-1]) & set(lists[n // 2 + i][:-1])}
    got = {r["vec_id"]: r["links"] for r in out[0].to_pylist()}
    assert 0 in earlier and all(got.get(i, 0) == (i not in earlier) for i in range(n // 2))
    assert peak < 20_000_000


def test_op3_urls_judges_by_the_rules_of_its_contract(spark, tmp_path):
    told = [
        ("http://a.com/en/1", "com/en/", "block"), ("http://a.example.com/en/71", "example.com/en/7", "allow"), ("http://a.net/de/8", "net/de/", "allow"),
        ("http://example.net/de/7", "net/de/", "allow"), ("http://a.example.net/de/81", "example.net/de/8", "block"), ("http://a.org/es/1", "org/es/", "block"),
    ]
    rows = [(i, url, None) for i, (url, _, _) in enumerate(told)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op3_urls(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [(rule, verdict) for _, rule, verdict in told]
