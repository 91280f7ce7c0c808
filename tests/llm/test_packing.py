import zlib

import numpy as np
import pytest

pytest.importorskip("larkspur.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from larkspur.llm import packing, tokens  # noqa: E402

SF = "/root/testdata/sf0.01"


def direct(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    return [np.array(e.ids + [1], dtype="<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def gapless(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by)


def test_query_against_direct_encoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = packing.op6_best_fit(spark, SF).collect()
    got = {(r.doc_id, r.piece): r for r in rows}
    n = 0
    for d, ids in zip(docs, direct([d.text or "" for d in docs]), strict=True):
        for k, at in enumerate(range(0, len(ids), 4096)):
            r, part = got[d.doc_id, k], ids[at : at + 4096]
            assert (r.start, r.length, r.ids_crc32) == (at, len(part), zlib.crc32(part.tobytes()))
            n += 1
    assert n == len(rows)
    used, least = gapless(rows), -(-sum(r.length for r in rows) // 4096)
    assert used <= least + max(2, least // 50)


def test_edges(spark):
    long = "tail " * 9000
    data = [(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z"), (4, long, None), (None, " \n", "q")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, length string")
    rows = packing.pack_documents(docs, tokens.tokenizer_path()).collect()
    assert sorted((r.doc_id, r.length) for r in rows if r.doc_id and r.doc_id < 4) == [(1, 1), (2, 1), (3, 3), (3, 3)]
    assert sum(r.length for r in rows if r.doc_id == 4) == 9001
    gapless(rows)
    assert packing.pack_documents(docs.limit(0), tokens.tokenizer_path()).count() == 0


def test_plan_matches_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 60, size=rng.integers(1, 300)).tolist()
        hist = {x: lengths.count(x) for x in set(lengths)}
        rows = packing.plan(hist, 64)
        used = {}
        for length, first, last, base, per, offset in rows:
            for r in range(last - first):
                used.setdefault(base + r // per, []).append((offset + r % per * length, length))
        assert sum(map(len, used.values())) == len(lengths)
        for slots in used.values():
            at = 0
            for o, n in sorted(slots):
                assert o == at
                at += n
            assert at <= 64
        room = []
        for x in sorted(lengths, reverse=True):
            fits = [r for r in room if r >= x]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - x)
            else:
                room.append(64 - x)
        assert len(used) <= len(room) + 1


def test_chunks_equal_whole_texts():
    odd = ["a <|endoftext|> b <|ENDOFTEXT|>", "It's the  END. of it", "é ́x ΣΣ oΣ", "a\x1cb\x85c", "你好 12345 #!?", "don't we'll I'M", "x" * 300 + " y"]
    encode = tokens.encoder(tokens.tokenizer_path()).encode
    assert [np.frombuffer(x, "<u2").tolist() for x in encode([t.encode() for t in odd])] == [x[:-1].tolist() for x in direct(odd)]
