import re
import sys
from pathlib import Path

import pytest

pytest.importorskip("larkspur.llm")
duckdb = pytest.importorskip("duckdb")

sys.path.insert(0, str(Path(__file__).parent))
from test_dedup import brute as components  # noqa: E402
from test_packing import direct, gapless  # noqa: E402

import corpus_pipeline  # noqa: E402
from larkspur.llm import mixing, quality, scratch  # noqa: E402

SF = "/root/testdata/sf0.01"


def sql(text, docs):
    con = duckdb.connect()
    frame = docs.toPandas()
    con.register("documents", frame)
    return con.execute(text).fetch_df()


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.columns
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(scratch.materialize(stage(spark, steps[-1], SF), "step"))
    for step in steps[:-1]:
        assert step.columns == first
    texts = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in steps[:-1]]

    judged = sql(quality.OP3_SQL, docs)
    assert set(texts[1]) == set(judged.doc_id[judged.kept])
    assert all(texts[1][i] == texts[0][i] for i in texts[1])

    known = components(texts[1].items(), 5, 80)
    assert set(texts[2]) == {i for i, (_, c) in known.items() if c == i} and len(texts[2]) < len(texts[1])

    token = re.compile("(?<![A-Za-z0-9+/_.-])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{40}(?![A-Za-z0-9+/_.-])")
    assert texts[3] == {i: token.sub("[SECRET]", t) for i, t in texts[2].items()} and texts[3] != texts[2]

    taken = sql(mixing.OP8_SQL, steps[3])
    want = {i: int(n // s) for i, n, s in zip(taken.doc_id, taken.taken, taken["size"], strict=True) if n}
    got = {}
    for r in steps[4].select("doc_id").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want

    pieces = steps[5].collect()
    lengths = dict(zip(texts[4], map(len, direct(list(texts[4].values()))), strict=True))
    total = {}
    for r in pieces:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: n * want[i] for i, n in lengths.items()}
    gapless(pieces)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_odd_rows(spark):
    """Nulls in any column, repeated ids and rows, a foreign column of a helper's name, an empty table."""
    good = lambda k, n=200: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(None, good(1), "en", "only", 1, 0), (3, good(2), None, None, None, 0), (3, good(2), None, None, None, 0), (4, good(3), "en", "b", 1, 0), (4, good(4), "de", "b", 1, 0), (5, None, "en", "b", 1, 0), (6, "", None, "b", 1, 0), (7, "too short", "en", "c", 1, 0), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row int")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(scratch.materialize(stage(spark, steps[-1], SF), "odd"))
    texts = [{r.text for r in s.select("text").collect()} for s in steps[:-1]]
    wanted = {good(k) for k in (1, 2, 3, 4)}
    assert texts[1] == texts[2] == texts[3] == wanted and all(s.columns == docs.columns for s in steps[:-1])
    assert good(1) in texts[4], "a document without an id is mixed like others"
    assert {r.doc_id for r in steps[5].collect()} == {r.doc_id for r in steps[4].collect()}
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0
