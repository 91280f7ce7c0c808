import numpy as np
import pytest

pytest.importorskip("larkspur.llm")
pytest.importorskip("public_tokenizers")

from larkspur.llm import order, scratch, tokens  # noqa: E402


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_and_inverse(n):
    slots = order.feistel(np.arange(n), n, 9)
    assert sorted(slots.tolist()) == list(range(n))
    assert order.feistel(slots, n, 9, inverse=True).tolist() == list(range(n))
    if n > 50:
        assert slots.tolist() != order.feistel(np.arange(n), n, 10).tolist()


def plain(rows):
    """The stream by the tokenizer itself, in order of doc_id (None first; rows of one id have one text here)."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [x for r in ordered for x in [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]]


def stream_of(shards, got, stride):
    from pyarrow import fs

    files, by = {r.shard: r.path for r in shards.collect()}, {}
    for r in got:
        with fs.LocalFileSystem().open_input_file(files[r.shard] + ".bin") as f:
            by[r.sequence] = np.frombuffer(f.read_at(stride, r.offset), "<u2")
    return np.concatenate([by[k] for k in range(len(got))]).tolist()


ROWS = [(1, "one two three", 0), (2, None, 1), (3, "", 2), (4, "long " * 700, 3), (4, "long " * 700, 3), (None, "Ünïcode text!", 4), *[(k, f"text {k} " * (k % 9), 5) for k in range(10, 60)]]


def test_shards_hold_the_stream_of_the_plain_tokenizer_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(order, "PIECE", 100)  # sequences run over pieces and ranges
    want, names = plain(ROWS), set()
    for ranges in (1, 2, 7):
        docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, slot int").repartition(ranges)
        folder = scratch.new_path(spark, "order")
        shards = order.write_shards(docs, folder, tokens.tokenizer_path(), length=64, per_shard=4, ranges=ranges)
        got = order.read_shards(shards, folder, length=64).collect()
        n = len(got)
        assert n == -(-len(want) // 64) and sorted(r.slot for r in got) == list(range(n)) and sorted(r.sequence for r in got) == list(range(n))
        assert [int(order.feistel(np.array([r.sequence]), n, order.KEY)[0]) for r in got] == [r.slot for r in got]
        stream = stream_of(shards, got, 128)
        assert stream[: len(want)] == want and not any(stream[len(want) :])
        assert sum(r.n_ids for r in got) == len(want)
        names.add(tuple(sorted(r.path.rpartition("/")[2] for r in shards.collect())))
    assert len(names) == 1  # one order, one digest


def test_resume_keeps_whole_shards_of_this_input_and_key_only(spark):
    from pyarrow import fs

    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, slot int")
    folder, path = scratch.new_path(spark, "order"), tokens.tokenizer_path()
    first = {r.shard: r.path for r in order.write_shards(docs, folder, path, length=64, per_shard=4).collect()}
    local = fs.LocalFileSystem()
    with local.open_output_stream(first[0] + ".bin") as f:  # broken off
        f.write(b"x")
    before = local.get_file_info(first[1] + ".bin").mtime
    shards = order.write_shards(docs, folder, path, length=64, per_shard=4)
    assert {r.shard: r.path for r in shards.collect()} == first
    assert local.get_file_info(first[1] + ".bin").mtime == before
    assert stream_of(shards, order.read_shards(shards, folder, length=64).collect(), 128)[:5] == plain(ROWS)[:5]
    for other, key in ((docs, 5), (docs.withColumn("text", docs.text.substr(2, 99)), order.KEY)):
        assert not set(first.values()) & {r.path for r in order.write_shards(other, folder, path, key=key, length=64, per_shard=4).collect()}


def test_the_number_of_shards_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(order, "PER_SHARD", 2)
    monkeypatch.setattr(order, "SHARDS", 5)
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, slot int")
    folder = scratch.new_path(spark, "order")
    shards = order.write_shards(docs, folder, tokens.tokenizer_path(), length=64)
    got = order.read_shards(shards, folder, length=64).collect()
    n, per = len(got), -(-len(got) // 5)
    assert per > 2 and shards.count() == -(-n // per) and sorted(r.slot for r in got) == list(range(n))
    assert all((r.shard, r.offset) == (r.slot // per, r.slot % per * 128) for r in got)


def test_empty_table(spark):
    folder = scratch.new_path(spark, "order")
    docs = spark.createDataFrame([], "doc_id bigint, text string, slot int")
    assert order.read_shards(order.write_shards(docs, folder, tokens.tokenizer_path()), folder).count() == 0


def test_query_has_every_slot_once(spark):
    got = order.op10_order(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = plain([(r.doc_id, r.text) for r in docs])
    import zlib

    for r in got:
        ids = want[r.sequence * order.LENGTH : (r.sequence + 1) * order.LENGTH]
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids + [0] * (order.LENGTH - len(ids)), "<u2").tobytes()))
