import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

pytest.importorskip("larkspur.llm")

from larkspur.llm import codes  # noqa: E402


def plain(rows, entries=256, rounds=4, scale=1024):
    """Python's integers all the way: (vec_id, code, error, label_error), codebooks."""
    kept = [(i, [math.floor(min(max(scale * float(y), -codes.MOST), codes.MOST)) for y in x], label) for i, x, label in rows if x is not None and all(y is not None and math.isfinite(y) for y in x)]
    sizes = [len(x) for _, x, _ in kept]
    dims = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    width = -(-dims // 4)
    usual = sorted(((i, x + [0] * (4 * width - dims), label) for i, x, label in kept if len(x) == dims and dims), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[x[k * width : (k + 1) * width] for _, x, _ in usual] for k in range(4)]
    books = [c[:entries] for c in cut]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book)) for x in c] for c, book in zip(cut, books)]

    for _ in range(rounds):
        for k, found in enumerate(assign()):
            for j in {j for _, j in found}:
                own = [x for x, (_, f) in zip(cut[k], found) if f == j]
                books[k] = [*books[k][:j], [sum(c) // len(own) for c in zip(*own)], *books[k][j + 1 :]]
    out = [(r[0], "".join(f"{f[n][1]:02x}" for f in found), sum(f[n][0] for f in found), r[2]) for found in [assign()] for n, r in enumerate(usual)]
    out += [(i, None, None, label) for i, x, label in kept if len(x) != dims or not dims]
    totals = {label: sum(e for _, _, e, own in out if own == label and e is not None) if any(own == label and e is not None for _, _, e, own in out) else None for label in {r[3] for r in out}}
    cap = 2**63 - 1
    return sorted(str((i, c, e if e is None else min(e, cap), totals[label] if totals[label] is None else min(totals[label], cap))) for i, c, e, label in out), books


def run(spark, rows, tmp_path, parts=3):
    df = spark.createDataFrame([(label, x, i, 0, "a") for i, x, label in rows], "label int, embedding array<double>, vec_id bigint, part int, distance string").repartition(parts)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = codes.op12_vector_codes(spark, str(tmp_path)).collect()
    return sorted(str((r.vec_id, r.code, r.error, r.label_error)) for r in got), {r.codebooks_sha256 for r in got}


def digest(books):
    return hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def fixture(n=420, dims=8):
    rng = random.Random(12)
    return [(3 * k, [rng.gauss(0, 1) for _ in range(dims)], rng.choice([0, 1, 2, None])) for k in range(n)]


def test_against_plain_rounds_and_sql(spark, tmp_path):
    rows = fixture()
    rows += [(5000 + k, [0.25] * 8, 1) for k in range(200)]  # a hot part
    rows += [(9001, None, 0), (9002, [None] * 8, 0), (9003, [float("nan")] + [0.0] * 7, 0), (9004, [float("inf")] + [0.0] * 7, 0)]
    got, shas = run(spark, rows, tmp_path)
    want, books = plain(rows)
    assert got == want and shas == {digest(books)}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    sql = con.sql(codes.OP12_SQL + "").fetchall()
    assert sorted(str(r[:4]) for r in sql) == want and {r[4] for r in sql} == shas


def test_odd_rows(spark, tmp_path):
    """Ties, repeated and null ids, other lengths, huge components, a dimension not divisible by four."""
    rows = [(i, x[:6], label) for i, x, label in fixture(300)]
    rows += [(12, [1.0] * 6, 0), (12, [1.0] * 6, 0), (12, [-1.0] * 6, None), (None, [0.5] * 6, 9), (None, [0.5] * 6, 9)]
    rows += [(-7, [], 1), (-6, [1.0], 1), (-5, [1.0] * 9, 77), (15, [1e300, -1e300, 1e17, 3e9, 5e9, 0.0], 2), (16, [3e9] * 6, 2), (9000, [1e17, 1e17 + 64, 0.0, 0.0, 0.0, 0.0], 4)]
    got, shas = run(spark, rows, tmp_path)
    want, books = plain(rows)
    assert got == want and shas == {digest(books)}


def test_ties_of_ids_at_the_codebooks_edge(spark):
    rows = [(1, [float(k % 7), 0.0, 0.0, float(k)], None) for k in range(40)] + [(0, [9.0] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)
    coded, books = codes.compress(df, entries=16)
    want, plain_books = plain(rows, entries=16)
    assert [b.tolist() for b in books] == plain_books
    assert sorted(str((r.vec_id, "".join(f"{c:02x}" for c in r.codes), r.error)) for r in coded.collect()) == sorted(w.rsplit(",", 1)[0] + ")" for w in want)


def test_small_and_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    coded, books = codes.compress(empty)
    assert coded.count() == 0 and all(len(b) == 0 for b in books)
    got, shas = run(spark, [(5, [1.0, 2.0, 3.0, 4.0], None)], tmp_path, 1)
    assert got == ["(5, '00000000', 0, 0)"]


def test_packed_round_trip_and_nearest():
    rng = np.random.default_rng(1)
    m = np.concatenate([rng.integers(-(2**b), 2**b, (20, 5)) for b in (3, 10, 25, 60)])
    assert (codes.unpacked(codes.packed(m), 5) == m).all()
    assert len({len(b) for b in codes.packed(m)}) == 4
    x, book = rng.integers(-(2**40), 2**40, (50, 4)), rng.integers(-(2**40), 2**40, (9, 4))
    book[3] = book[1]
    x[0] = book[3]
    best, d = codes.nearest(x, book)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)), j) for j, e in enumerate(book)) for r in x]
    assert [(min(w, 2**63 - 1), j) for w, j in want] == list(zip(d.tolist(), best.tolist()))
