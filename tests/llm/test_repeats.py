import hashlib
import random

import pytest

pytest.importorskip("larkspur.llm")

from larkspur.llm import repeats  # noqa: E402

SF = "/root/testdata/sf0.01"


def brute(rows):
    """Every 100-byte string against a set of those before it."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = result(repeats.op4_prefix_free(spark, SF))
    want = brute(rows)
    assert got == want
    assert sum(x[1] > 0 for x in want.values()) > 50


def test_repetitive_texts(spark, monkeypatch):
    """Edited copies, periodic texts, shared passages, multi-byte characters, tiny pieces."""
    rng = random.Random(11)
    base = "".join(rng.choice("abcde fghé\n") for _ in range(1500))
    passage = "".join(rng.choice("xyz 王") for _ in range(160))
    rows = [(1, base), (2, base[:700] + "#" + base[701:]), (3, base[50:]), (4, "a" * 900), (5, "ab" * 300), (6, "a" * 99), (7, "a" * 100), (8, None), (9, ""), (10, base[:99])]
    for i in range(40):
        cut = rng.randrange(60)
        rows.append((20 + i, "".join(rng.choice("pqrst ") for _ in range(rng.randrange(200))) + passage[cut : cut + 80 + rng.randrange(100)] + f"{i} {rng.random()}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert result(repeats.repeated_strings(docs)) == brute(rows)
    monkeypatch.setattr(repeats, "ROWS", 50)  # holds in the driver only; pieces are cut in the workers
    assert result(repeats.repeated_strings(docs.repartition(3))) == brute(rows)


def test_pieces_of_a_long_text():
    import numpy as np

    data = np.frombuffer(("wörd " * 50 + "x" * 300).encode() * 3, dtype=np.uint8)
    with np.errstate(over="ignore"):
        h = repeats._Hashes(1)
        _, _, first, last, at = repeats.parsed(data, h)
    assert first[0] == 0 and last[-1] == len(data) - 100 and (first[1:] == last[:-1] + 1).all()
    assert ((at >= last) & (at - first <= 76)).all()


def test_odd_rows(spark):
    rng = random.Random(2)
    t = "".join(rng.choice("abcdef ") for _ in range(300))
    docs = spark.createDataFrame([(1, t, "x"), (1, t, "y"), (2, t, "z"), (None, t, None), (None, None, None)], "doc_id bigint, text string, data string")
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed) for r in repeats.repeated_strings(docs).collect())
    assert got == [(0, 0, 0), (0, 300, 300), (1, 300, 0), (1, 300, 0), (2, 300, 300)]
    assert repeats.repeated_strings(docs.limit(0)).count() == 0
