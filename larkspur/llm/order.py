"""Training order on disk: a keyed permutation gives each sequence its slot in fixed-stride shards.

Documents stand in the order of their ids (of one id: of a hash of the text), whatever the
splits of the input. Their token ids form one stream, which is cut into sequences of
``length`` ids; the last is padded. A Feistel network over the next even number of bits,
walked until it falls into the range, permutes the sequences 0..n-1: each task computes
slots on its own, without a table, and the order can be computed again, or inverted, from
the key alone.

Texts are dealt by ranges of that order and tokenised range by range into a scratch table of
compressed pieces; the sums per range (one row of each, on the driver) tell where a range
begins in the stream. Pieces of sequences then go to ranges of slots: a task writes whole
shards front to back. A shard has one stride, so that slot s stands at byte
``(s - first_slot) * stride``; a reader resumes by seeking. Shards hold PER_SHARD sequences, and
more where that would make over SHARDS of them, so their number does not grow without end.

Shards are named after the key, the shape, the tokenizer and a digest of all ids, written
under a name of the attempt and then renamed. One that is already there with its full size
is kept, which makes a broken run resumable; other input or another key has other names.

Defined results: a null or empty text is the end token alone; long texts run over several
sequences; repeated rows are written again; a null id comes first; an empty table writes no
shard and gives an empty result; columns other than doc_id and text are not read. Ids take
16 bits where the vocabulary allows it, else 32.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .tokens import batches_of, encoder, tokenizer_path

LENGTH = 2048
END, PAD = 1, 0
PER_SHARD = 2048
SHARDS = 20_000
KEY = 20240607
FEISTEL_ROUNDS = 6
#: Ids of one piece of the stream in the scratch table.
PIECE = 1 << 14


def feistel(index, n: int, key: int, inverse: bool = False):
    """The place of each of ``index`` (uint64 array, below ``n``) in the keyed permutation of n."""
    import numpy as np

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)

    def mix(x, r):
        x = x + np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & mask

    def once(x):
        a, b = x >> shift, x & mask
        for r in reversed(range(FEISTEL_ROUNDS)) if inverse else range(FEISTEL_ROUNDS):
            a, b = (b ^ mix(a, r), a) if inverse else (b, a ^ mix(b, r))
        return a << shift | b

    with np.errstate(over="ignore"):
        out = once(np.asarray(index, dtype=np.uint64))
        while (outside := out >= np.uint64(n)).any():  # cycle walking
            out[outside] = once(out[outside])
    return out


def _pieces(batches, path: str, end: int) -> Iterator[tuple[int, int, bytes, list, list[int], int]]:
    """(nr, ids, their bytes, doc_ids, starts, mark) of the pieces of one range's stream: the documents
    that a piece holds, with their starts in it (the first may begin before), and the sum of
    hashes of those that begin in it."""
    import xxhash

    own = encoder(path)
    stop, size = int(end).to_bytes(own.width, "little"), PIECE * own.width
    held, docs, starts, mark, nr = bytearray(), [], [], 0, 0
    for batch in batches:
        doc_ids = iter(batch.column("doc_id").to_pylist())
        for texts in batches_of(x.as_py() for x in batch.column("text")):
            for ids in own.encode(texts):
                doc_id = next(doc_ids)
                docs.append(doc_id)
                starts.append(len(held) // own.width)
                mark += xxhash.xxh3_64_intdigest(ids, seed=(doc_id or 0) & (2**64 - 1))
                held += ids
                held += stop
                while len(held) >= size:
                    yield nr, PIECE, bytes(held[:size]), docs, starts, mark % 2**62
                    del held[:size]
                    more = bool(held)  # the last document goes on
                    docs, starts, mark, nr = docs[-1:] * more, [starts[-1] - PIECE] * more, 0, nr + 1
    if held:
        yield nr, len(held) // own.width, bytes(held), docs, starts, mark % 2**62


def write_shards(docs: DataFrame, folder: str, path: str, key: int = KEY, length: int = LENGTH, per_shard: int | None = None, end: int = END, pad: int = PAD, ranges: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) in training order below ``folder``; rows (shard, path, sequences, first_slot).

    ``ranges`` is the number of tasks that tokenise; it changes no byte.
    """
    import pyarrow as pa

    from .warc import _fs

    spark = docs.sparkSession
    width = encoder(path).width
    ranges = ranges or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("th"))
    ordered = source.repartitionByRange(ranges, "doc_id", "th").sortWithinPartitions("doc_id", "th")
    names = ["nr", "n", "ids", "docs", "starts", "mark"]
    types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in _pieces(batches, path, end):
            rows.append(row)
            if len(rows) == 64:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    shape = "nr bigint, n int, ids binary, docs array<bigint>, starts array<int>, mark bigint"
    stream = scratch.materialize(ordered.mapInArrow(cut, shape).withColumn("part", F.spark_partition_id()), "stream", compression="zstd")
    # One row per range, as the driver holds for its tasks anyway.
    base, total, digest = {}, 0, 0
    for part, n, mark in sorted(map(tuple, stream.groupBy("part").agg(F.sum("n"), F.sum(F.expr("cast(mark as decimal(38))"))).collect())):
        base[part] = total
        total += n
        digest += int(mark)
    sequences = -(-total // length)
    per_shard = per_shard or max(PER_SHARD, -(-sequences // SHARDS))
    tag = f"{zlib.crc32(repr((key, length, per_shard, end, pad, path.rpartition('/')[2], width, total)).encode()):08x}{digest % 2**64:016x}"

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The part of each sequence that a piece holds: (shard, slot, at, sequence, doc_id, n, ids)."""
        import bisect

        import numpy as np
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        fields = ["shard", "slot", "at", "sequence", "doc_id", "n", "ids"]
        rows: list[tuple] = []
        for batch in batches:
            for part, nr, n, ids, own, starts in zip(*(batch.column(c).to_pylist() for c in ("part", "nr", "n", "ids", "docs", "starts")), strict=True):
                begin = base[part] + nr * PIECE
                index = np.arange(begin // length, (begin + n - 1) // length + 1)
                for sequence, slot in zip(index.tolist(), feistel(index, sequences, key).tolist(), strict=True):
                    a, b = max(sequence * length, begin), min((sequence + 1) * length, begin + n)
                    doc_id = own[bisect.bisect_right(starts, a - begin) - 1]
                    rows.append((slot // per_shard, slot, a - sequence * length, sequence, doc_id, b - a, pack(ids[(a - begin) * width : (b - begin) * width])))
                if len(rows) >= 2048:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=fields)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=fields)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole shards, of rows in order of (slot, at)."""
        import zstandard

        fs, top = _fs(folder)
        done, unpack = [], zstandard.ZstdDecompressor().decompress
        out = None

        def close() -> None:
            out.close()
            done.append((out.shard, out.name, out.count, out.shard * per_shard))

        for batch in batches:
            for shard, slot, sequence, doc_id, n, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "sequence", "doc_id", "n", "ids")), strict=True):
                if out is None or out.shard != shard:
                    if out is not None:
                        close()
                    out = _Shard(fs, f"{top}/{tag}-{shard:09d}", shard, min(per_shard, sequences - shard * per_shard), length, width, pad)
                out.add(slot, sequence, doc_id, n, unpack(ids))
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["shard", "path", "sequences", "first_slot"])

    fs, top = _fs(folder)
    fs.create_dir(top, recursive=True)
    placed = stream.mapInArrow(dealt, "shard bigint, slot bigint, at int, sequence bigint, doc_id bigint, n int, ids binary")
    # A range of slots is a partition: known bounds need no sample.
    ranged = placed.repartitionById(max(1, -(-sequences // per_shard)), F.col("shard").cast("int")).sortWithinPartitions("slot", "at")
    return scratch.materialize(ranged.mapInArrow(write, "shard bigint, path string, sequences bigint, first_slot bigint"), "shards")


class _Shard:
    """One shard while it is written: ``<name>.bin`` with the ids, ``<name>.idx`` with what its slots hold."""

    def __init__(self, fs, name: str, shard: int, count: int, length: int, width: int, pad: int):
        self.fs, self.name, self.shard, self.count = fs, name, shard, count
        self.stride, self.width, self.pad = length * width, width, int(pad).to_bytes(width, "little")
        there = fs.get_file_info([f"{name}.bin", f"{name}.idx"])
        self.kept = there[0].is_file and there[0].size == count * self.stride and there[1].is_file
        self.rows: list[list[int | None]] = []
        self.own = f"{name}.{uuid.uuid4().hex}"
        self.out = None if self.kept else fs.open_output_stream(self.own)
        self.room = 0

    def add(self, slot: int, sequence: int, doc_id: int | None, n: int, ids: bytes) -> None:
        if self.kept:
            return
        if self.rows and self.rows[-1][0] == slot:
            self.rows[-1][3] += n
        else:
            self._fill()
            self.rows.append([slot, sequence, doc_id, n])
            self.room = self.stride
        self.out.write(ids)
        self.room -= len(ids)

    def _fill(self) -> None:
        if self.room:
            self.out.write(self.pad * (self.room // self.width))
            self.room = 0

    def close(self) -> None:
        if self.kept:
            return
        import pyarrow as pa
        import pyarrow.parquet as pq

        self._fill()
        self.out.close()
        if len(self.rows) != self.count:
            raise ValueError(f"{self.name} lacks a slot")
        index = pa.table([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["slot", "sequence", "doc_id", "n_ids"])
        with self.fs.open_output_stream(f"{self.own}.idx") as out:
            pq.write_table(index, out)
        self.fs.move(f"{self.own}.idx", f"{self.name}.idx")
        self.fs.move(self.own, f"{self.name}.bin")


def read_shards(shards: DataFrame, uri: str, length: int = LENGTH, width: int = 2) -> DataFrame:
    """One row per sequence of ``shards`` (shard, path, first_slot), read front to back:
    slot, sequence, doc_id (of its first id), n_ids, shard, offset (bytes), ids_crc32."""
    import pyarrow as pa

    from .warc import _fs

    stride = width * length

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        fs, _ = _fs(uri)
        for batch in batches:
            for shard, path, first in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "first_slot")), strict=True):
                with fs.open_input_file(f"{path}.idx") as file:
                    index = pq.read_table(file)
                slots, crc = index.column("slot").to_pylist(), []
                if slots != list(range(first, first + len(slots))):
                    raise ValueError(f"{path} lacks a slot")
                with fs.open_input_stream(f"{path}.bin", compression=None) as file:
                    for _slot in slots:
                        crc.append(zlib.crc32(file.read(stride)))
                columns = {c: index.column(c).combine_chunks() for c in index.column_names}
                columns |= {"shard": pa.array([shard] * len(slots), pa.int64()), "offset": pa.array([(s - first) * stride for s in slots], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    spread = shards.repartition(max(1, shards.count()), "path")
    return spread.mapInArrow(read, "slot bigint, sequence bigint, doc_id bigint, n_ids int, shard bigint, offset bigint, ids_crc32 bigint")


def op10_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(spark, "order")
    path = tokenizer_path()
    return read_shards(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, path), folder, width=encoder(path).width)
