import random

import pytest

pytest.importorskip("larkspur.llm")

from pyspark.sql.classic.dataframe import DataFrame  # noqa: E402

from larkspur.llm import topk  # noqa: E402


def brute(rows, k=5):
    import math

    good = []
    for at, (i, x) in enumerate(rows):
        if x and all(y is not None and math.isfinite(y) for y in x):
            good.append((at, i, [math.floor(256 * y) for y in x]))
    out = []
    for at, i, q in good:
        if i is not None and i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j if j is not None else 2**63) for o, j, v in good if o != at)[:k]
            out += [(i, r + 1, j if j < 2**63 else None, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 10 ** rng.uniform(-1, 1)) for _ in range(12)]) for i in range(700)]
    rows += [(1000 + i, [1.0] * 12) for i in range(40)]  # ties
    rows += [(2000, None), (2050, []), (2100, [None] * 12), (2150, [float("nan")] * 12), (2200, [float("inf")] + [0.0] * 11), (2250, [0.0] * 12), (2300, [3.0, -2.0])]
    rows += [(50, rows[50][1]), (None, [9.0] * 12)]
    monkeypatch.setattr(topk, "BLOCK", 100)
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], "vec_id bigint, embedding array<double>, row int").repartition(3)
    assert got(topk.top_products(df)) == brute(rows)


def test_small_tables(spark):
    shape = "vec_id bigint, embedding array<float>"
    assert topk.top_products(spark.createDataFrame([], shape)).count() == 0
    assert topk.top_products(spark.createDataFrame([(0, [1.0])], shape)).count() == 0
    assert got(topk.top_products(spark.createDataFrame([(0, [1.0]), (1, [-1.0])], shape))) == [(0, 1, 1, -65536)]


def test_components_of_any_finite_size(spark):
    """Large components are neither dropped nor rounded; what is beyond 64 bits is cut to them."""
    rows = [(0, [300000.0, 1.0]), (1, [1.0, 2.0]), (2, [2.0**40, 1 / 256]), (3, [-1e300, 0.0]), (50, [2.0**20, 3.0])]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    v = {i: [max(-(2**63) + 1024, int(256 * c // 1)) for c in x] for i, x in rows}
    fit = lambda x: max(-(2**63), min(2**63 - 1, x))
    want = []
    for q in (0, 50):
        best = sorted((-fit(sum(a * b for a, b in zip(v[q], v[c], strict=True))), c) for c in v if c != q)
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best[:5])]
    got = topk.top_products(docs).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_short_vectors_are_copied_to_few_queries(spark, monkeypatch):
    """Lengths fall by a power: nearly no group of short vectors meets a query, in a grid all would."""
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        x = [rng.gauss(0, 1) for _ in range(8)]
        rows.append((i, [c * 40 / (1 + i % 997) for c in x]))
    monkeypatch.setattr(topk, "BLOCK", 20)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    left, right, _, _ = topk.cells(df)
    blocks, groups = right.select("block").distinct().count(), left.select("cq").distinct().count()
    assert 0 < right.count() < 80
    assert groups == 1 and blocks < 80 < 4000 // 20
    monkeypatch.setattr(topk, "BOUNDS", 7)  # a coarser plan is still whole
    assert got(topk.top_products(df)) == brute(rows)


def test_any_number_of_partitions(spark, monkeypatch):
    """Groups are those of the plan, however many partitions the blocks were written from."""
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 10 ** rng.uniform(-1, 1)) for _ in range(6)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK", 10)
    plain = DataFrame.repartitionByRange
    for n in (1, 37):
        monkeypatch.setattr(DataFrame, "repartitionByRange", lambda d, _, *keys, n=n: plain(d, n, *keys))
        assert got(topk.top_products(df)) == brute(rows)


def test_vectors_of_other_lengths(spark, monkeypatch):
    """Many vectors longer than the most frequent length, some with what decides beyond it; ids beyond the bound of rotation."""
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(rng.choice((6, 6, 6, 9, 9, 14, 3)))]) for i in range(500)]
    rows += [(1000, [0.0] * 6 + [9.0] * 3), (1001, [0.0] * 8 + [7.0]), (1050, [1.0] * 300), (1100, [2.0**33] * 9), (1150, [-(2.0**45)] * 14)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    monkeypatch.setattr(topk, "BLOCK", 50)
    want = []
    v = {i: [int(256 * c // 1) for c in x] for i, x in rows}
    for q in [i for i in v if i % 50 == 0]:
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v[q], v[c])))), c) for c in v if c != q)[:5]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert got(topk.top_products(df)) == sorted(want, key=str)
    monkeypatch.setattr(topk, "ROTATED", 4)
    assert got(topk.top_products(df)) == sorted(want, key=str)
