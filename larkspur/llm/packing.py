"""Best-fit packing planned over a histogram of lengths.

Documents are cut into pieces of at most ``capacity`` tokens. The plan is made from counts
per length alone (at most ``capacity`` rows, whatever the input): from the longest length
down, each batch of equal pieces goes to the open sequences with the least room that
still takes it, as a batch, and new sequences are opened for the rest. Sequences with the same
filling are one group of the plan, so its size follows the number of lengths. A piece then
takes a slot by its rank within its length: the plan maps ranges of ranks to groups.

Defined results: a null or empty text is the end token alone; a text of several times the
capacity is cut into full pieces and a rest; repeated rows are packed each on its own;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranks, scratch
from .tokens import batches_of, encoder, tokenizer_path

CAPACITY = 4096
END = 1
#: Pieces of one length that a task sorts.
RANKED_ROWS = 100_000
PIECES = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32[, ids]) of each piece of ``docs`` (doc_id, text).

    ``row`` tells repeated rows of one id apart. Texts become ids batch by batch; ids are
    little-endian unsigned 32-bit.
    """
    import pyarrow as pa

    fields = [("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = encoder(path)
        stop = int(end).to_bytes(4, "little")
        for batch in batches:
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), strict=True)
            for texts in batches_of(x.as_py() for x in batch.column("text")):
                rows: list[tuple] = []
                for short in own.encode(texts):
                    doc_id, row = next(keys)
                    ids = (np.frombuffer(short, dtype="<u2").astype("<u4").tobytes() if own.width == 2 else short) + stop
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc_id, row, k, at // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    source = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts: rows (length, first_rank, last_rank, base, per, offset).

    Rank r of ``length`` with first_rank <= r < last_rank lies in sequence
    ``base + (r - first_rank) // per`` at ``offset + (r - first_rank) % per * length``.
    """
    groups: dict[int, list[list]] = {}  # room -> [first sequence, number of sequences]
    rows: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # rooms in use, ascending
    opened = 0
    import bisect

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append([first, n])

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                first, n, room = opened, None, capacity
            else:
                room = rooms[k]
                first, n = groups[room][-1]
            per = room // length
            whole = left // per if n is None else min(n, left // per)
            if whole == 0:  # the last, fewer pieces share one sequence
                per, whole = left, 1
            if n is None:
                opened += whole
            else:
                groups[room].pop()
                if n > whole:
                    groups[room].append([first + whole, n - whole])
                if not groups[room]:
                    del groups[room]
                    rooms.pop(k)
            rows.append((length, rank, rank + whole * per, first, per, capacity - room))
            put(room - per * length, first, whole)
            rank += whole * per
            left -= whole * per
    return rows


def packed(piece: DataFrame, capacity: int = CAPACITY, per_bucket: int = RANKED_ROWS) -> DataFrame:
    """``piece`` with sequence_id and offset. Only the histogram, at most ``capacity`` rows,
    comes to the driver, and only the plan, a few rows per length, is sent to the tasks. A
    length is ranked in as many buckets as leave ``per_bucket`` pieces or so to each."""
    spark = piece.sparkSession
    histogram = {r[0]: r[1] for r in piece.groupBy("length").count().collect()}
    slots = sorted(plan(histogram, capacity))
    keys = [r[0] << 40 | r[1] for r in slots]
    import pyarrow as pa

    names = [f.name for f in piece.schema.fields]
    buckets = max(1, -(-max(histogram.values(), default=1) // per_bucket))
    ranked = ranks.ranked(piece, "length", ["doc_id", "row", "piece"], buckets, "_p_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        first = np.array(keys, dtype=np.int64)
        table = np.array(slots, dtype=np.int64).reshape(-1, 6)
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_p_rank").to_numpy(zero_copy_only=False)
            found = table[np.searchsorted(first, length << 40 | rank, side="right") - 1]
            sequence = found[:, 3] + (rank - found[:, 1]) // found[:, 4]
            offset = found[:, 5] + (rank - found[:, 1]) % found[:, 4] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in piece.schema.fields)
    return ranked.select(*names, "_p_rank").mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    piece = scratch.materialize(pieces(docs, path, capacity, end), "pieces")
    return packed(piece, capacity).drop("row")


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
