import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

pytest.importorskip("larkspur.llm")

from larkspur.llm import middle  # noqa: E402


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(doc_id, text, rate=100, spm=50):
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def cases():
    rng = random.Random(13)
    texts = [None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "\r\n\x0b\x0c x\u0085y\nz", "😀é\n中文\n\U0001f600", "x<P>\ny", "x<S", "<", "<M\n<S\n<P\n", "<\nP>\n", "a" * 200_000 + "\n" + "b"]
    texts += ["".join(rng.choice("ab<>PSM\né😀 ") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [(7, "again\nand again\n")] * 3 + [(None, "no id\nat all\n"), (-5, "less\nthan\nzero")]


def test_against_plain_version_and_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(middle, "BATCH_BYTES", 500)
    rows = cases()
    df = spark.createDataFrame([(t, i, "x", 0) for i, t in rows], "text string, doc_id bigint, output string, n int").repartition(3)
    made = middle.fill_in_middle(df)
    got = made.withColumn("back", middle.restored()).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, (plain(i, t) for i, t in rows)))
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(middle.OP13_SQL)
    done = middle.op13_fill_in_middle(spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in done.collect())


def test_rate_and_shares(spark):
    rows = [(k, f"a{k}\nb\nc\n") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = middle.fill_in_middle(df, rate=60, spm=20).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain(i, t, 60, 20)) for i, t in rows)
    forms = [r.form for r in got]
    assert abs(forms.count("plain") - 800) < 100 and abs(forms.count("spm") - 240) < 60


def test_units():
    def cut(text, unit):
        ends = middle.boundaries(np.array([ord(c) for c in text], dtype="<u4"), unit)
        return [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    assert cut("ab  cd\ne", "word") == ["ab  ", "cd\n", "e"] and cut("  ab", "word") == ["  ", "ab"]
    assert cut("é😀", "char") == ["é", "😀"] and cut("", "char") == [] and cut("", "line") == []
    with pytest.raises(ValueError):
        cut("a", "page")


def test_bytes_that_are_no_utf8_and_string_ids(spark):
    df = spark.createDataFrame([("k", bytearray(b"\xff\xfea\n\xc3b\n"))], "doc_id string, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    row = middle.fill_in_middle(df).selectExpr("doc_id", "form", "cast(output as binary) as o", "n").first()
    out = bytes(row.o)
    for m in (b"<P>", b"<S>", b"<M>"):
        out = out.replace(m, b"")
    assert row.doc_id == "k" and row.n == 2 and sorted(out) == sorted(b"\xff\xfea\n\xc3b\n")


def test_empty_table(spark):
    assert middle.fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
