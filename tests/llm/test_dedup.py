import random
import re

import numpy as np
import pytest

pytest.importorskip("larkspur.llm")

from larkspur.llm import dedup, graph  # noqa: E402

SF = "/root/testdata/sf0.01"


def brute(rows, k, percent):
    """Components by all pairs of exact word-shingle sets."""
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    shared = {}
    for docs in where.values():
        for x, a in enumerate(docs):
            for b in docs[x + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs, 3, 85)
    got = dedup.op1_setsketch_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert sum(not r.kept for r in got) > 20


def test_chains_and_edges(spark):
    """Near copies in a chain, where the ends are no copies of each other, and odd rows."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows, now = [], words
    for i in range(12):
        rows.append((100 - i, " ".join(now)))
        now = now[:]
        for _ in range(2):
            now[rng.randrange(len(now))] = f"x{rng.random()}"
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "one two three"), (7, "z " * 5000), (8, "z " * 4000), (8, "z " * 4000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, n bigint")
    want = brute(rows, 3, 85)
    got = dedup.near_duplicates(docs, 3, 85).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
    odd = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (9, "a b c")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in dedup.near_duplicates(odd).collect()) == [(0, 9, False), (0, 9, False), (9, 9, True)]
    assert dedup.near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    rng = random.Random(2)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(300)]
    edited = lambda x: " ".join([*x[:150], "edit", *x[151:]])
    a, b = text(), text()
    rows = [(5, " ".join(a)), (5, " ".join(b)), (9, edited(a)), (10, edited(b)), (None, " ".join(b[:40])), (None, edited(b[:299]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in dedup.near_duplicates(docs, 3, 85).collect())
    assert got == [(0, 0, True), (0, 5, False), (5, 5, True), (5, 5, True), (9, 5, False), (10, 5, False)]
    left = {(r.doc_id, r.text) for r in dedup.deduplicated(docs, 3, 85).collect()}
    assert left == {rows[0], rows[1], rows[4]}


def test_filter_with_clashing_columns_and_repeated_rows(spark):
    taken = "rk nr cid n row regs comp _d_id key".split()
    rows = [(k, t, *range(9)) for k, t in ((3, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (None, "a b c d e F"), (7, None), (8, ""), (None, "x y"), (None, "x y"), (4, "z"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} int" for c in taken))
    got = dedup.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text) for r in got.collect()), key=str) == sorted([(2, "A b c d e f"), (7, None), (8, ""), (0, "x y"), (4, "z")], key=str)
    assert dedup.deduplicated(docs.limit(0)).count() == 0


def test_large_group_of_edited_copies_in_blocks(spark, monkeypatch):
    """Copies that are near the original, some of them below the threshold to each other and to it."""
    monkeypatch.setattr(dedup, "BLOCK", 64)
    monkeypatch.setattr(dedup, "PAIRS", 2000)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        own = base[:]
        for _ in range(rng.choice((1, 3, 5, 8, 12))):
            own[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows, 3, 85)
    assert 1 < len({c for _, c in want.values()}) < 400
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(docs, 3, 85).collect()} == want


def test_parities_bound_the_difference():
    rng = np.random.default_rng(4)
    for n, other in ((5, 5), (40, 44), (127, 130), (1000, 1100), (9000, 9500)):
        pool = rng.integers(0, 2**63, size=n + other, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[: n - n // 20], pool[n : n + other - (n - n // 20)]])
        regs = [dedup.SetSketcher(120).registers(x).tobytes() for x in (a, b)]
        odd = [dedup.parities(x) for x in (a, b)]
        test = dedup._Compared(np.array([n, other]), regs, odd, 120, 85)
        w = int(test.wide.min())
        differ = int(np.bitwise_count(test._parities(np.array([0]), w) ^ test._parities(np.array([1]), w)).sum())
        true = len(set(a.tolist()) ^ set(b.tolist()))
        assert 0.5 * true <= differ <= true


def test_likelihood_and_registers():
    rng = np.random.default_rng(1)
    sketcher = dedup.SetSketcher(400)
    for j in (0.3, 0.6, 0.9):
        n = 2000
        both = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 2**63, size=2 * n, dtype=np.uint64)
        a, b = pool[:n], pool[n - both : 2 * n - both]
        ra, rb = sketcher.registers(a), sketcher.registers(b)
        assert abs((ra == rb).mean() - j) < 0.1
        assert bool(dedup.likely([(ra > rb).sum()], [(ra < rb).sum()], np.array([n]), np.array([n]), 400, 85)[0]) == (j > 0.7)
        assert (sketcher.registers(np.concatenate([a, b])) == np.maximum(ra, rb)).all()  # merge


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(300)] + [(7, 7), (900, 901)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[200 + i] == 100 for i in range(300)) and got[901] == 900
