"""Removal of byte strings that occur earlier in the corpus, by prefix-free parsing.

A rolling hash over GRAM bytes marks triggers: the least hash among the grams of any 100
bytes (the first, if several). So every 100-byte string holds its trigger at a place that
its content alone fixes, phrases between triggers are bounded, and equal strings are parsed
alike wherever they stand. A phrase with the 100-byte strings that start in it is a word of
the dictionary; the parse is the list of its occurrences.

* Occurrences are sorted by (trigger, word, document, start): the corpus order of the parse.
  All but the first of a word are removed as a whole; most repeats end here, at one row per
  phrase instead of one per byte.
* Words that share a trigger but differ can still share strings. Only these words, at
  their first occurrence, are cut into cells of CELL starts at fixed distances from the
  trigger, and cells are sorted by (core, cell, document, start), where the core is what all
  strings of a cell have in common: a core that occurs once ends the search.
* Cells that share a core but differ are sorted suffix by suffix, to a depth of 100 bytes, by
  (string, document, start); all but the first of equal neighbours are removed.

Corpus order is needed down to 100 bytes only and only to bring equal strings together, so
suffixes are sorted by fingerprints of these bytes (128 bits; words by 64 within their
trigger's 64) and not by the bytes: the suffix array of dictionary and parse is distributed
over range of fingerprints, no task holds the dictionary, and bytes are not shuffled.
Before each sort a task drops what it has itself seen earlier, so a string that is in a
third of all documents is a row per task and batch.

Defined results: a null text is empty; texts under 100 bytes lose nothing; rows with one id
and one text are one document and are judged alike; rows with one id and different texts
are documents of their own, in order of a hash; a null id comes last; an empty table gives
an empty result; other columns are not read. Long texts are parsed in pieces that overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

WIDTH = 100
GRAM = 24
CELL = 8
#: Bytes of one text that are parsed at once, and rows that a task sorts before it sends them.
PIECE, ROWS = 1 << 20, 150_000
_NO_ID = 2**63 - 1


class _Hashes:
    """Fingerprints of any substring from prefix sums: a random value per byte times powers
    of an odd base, modulo 2^64."""

    def __init__(self, seed: int):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, size=256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**61)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self._powers = self._inverses = np.ones(1, dtype=np.uint64)

    def _grown(self, n: int):
        import numpy as np

        if len(self._powers) < n:
            n = max(n, 1 << 14)
            with np.errstate(over="ignore"):
                self._powers, self._inverses = (np.cumprod(np.array([1] + [x] * (n - 1), dtype=np.uint64)) for x in (self.base, self.inverse))
        return self._powers, self._inverses

    def prefix(self, data):
        import numpy as np

        powers, _ = self._grown(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * powers[: len(data)], out=out[1:])
        return out

    def of(self, prefix, start, end):
        _, inverses = self._grown(len(prefix))
        return _mixed((prefix[end] - prefix[start]) * inverses[start])


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def parsed(data, hashes: _Hashes, width: int = WIDTH, gram: int = GRAM):
    """(trigger, word, first, last, at) of the phrases of ``data``: the starts first..last of
    strings of ``width`` bytes have one trigger, which stands at ``at``."""
    import numpy as np

    starts = len(data) - width + 1
    if starts <= 0:
        return tuple(np.empty(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    prefix = hashes.prefix(data)
    at = np.arange(len(data) - gram + 1)
    value = hashes.of(prefix, at, at + gram)
    least = (value & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    have, want = 1, width - gram + 1
    while have < want:  # minima over doubled windows, the last overlapping
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    trigger = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
    last = np.concatenate([first[1:], [starts]]) - 1
    trigger = trigger[first]
    word = hashes.of(prefix, first, last + width)
    word = _mixed(word + (trigger - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (last - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return value[trigger], word, first, last, trigger


def _documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(did, th, data), the order of the documents and their bytes: of all rows, and once for
    each document. Both are one table unless an id occurs twice."""
    ids = docs.select(F.expr(f"coalesce(doc_id, {_NO_ID}L) as did"))
    again = ids.groupBy("did").count().agg(F.max("count")).first()[0] or 0
    data = F.expr("cast(coalesce(text, '') as binary)")
    rows = docs.select(F.expr(f"coalesce(doc_id, {_NO_ID}L)").alias("did"), (F.xxhash64(data) if again > 1 else F.lit(0).cast("bigint")).alias("th"), data.alias("data"))
    return rows, rows.dropDuplicates(["did", "th"]) if again > 1 else rows


#: ``place`` holds, from its high bits, a first start, how many starts follow it (7 bits), the
#: trigger's distance from the first (7 bits) and what is known (2 bits): it sorts by start.
_ROW = "k1 bigint, k2 bigint, did bigint, th bigint, place bigint"
_NAMES = ("k1", "k2", "did", "th", "place")
SEEN, FIRST = 1, 2


def _placed(first, last, distance, kind: int):
    return first << 16 | (last - first) << 9 | distance << 2 | kind


def _ranges(place):
    """(first, last, distance) of packed places."""
    first = place >> 16
    return first, first + (place >> 9 & 127), place >> 2 & 127


def _presorted(parts: list[tuple]):
    """A batch of (k1, k2, did, th, place): the first of equal keys as it is, and the others as
    SEEN, under keys that deal them out evenly."""
    import numpy as np
    import pyarrow as pa

    k1, k2, did, th, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, th, did, k2, k1))
    k1, k2, did, th, place = (x[order] for x in (k1, k2, did, th, place))
    seen = np.concatenate([[False], (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])])
    k1[seen] = _mixed((did[seen] + place[seen]).astype(np.uint64)).astype(np.int64)
    place[seen] ^= SEEN ^ FIRST
    k2[seen] = 0
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, did, th, place)], names=list(_NAMES))


def _phrases(batches: Iterator) -> Iterator:
    """Dictionary words at their occurrences; rows (did, th, data)."""
    import numpy as np

    hashes = _Hashes(1)
    parts, held = [], 0
    with np.errstate(over="ignore"):
        for batch in batches:
            for did, th, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = np.frombuffer(data.as_buffer(), dtype=np.uint8)
                for at in range(0, max(0, len(data) - WIDTH + 1), PIECE):
                    trigger, word, first, last, where = parsed(data[at : at + PIECE + WIDTH - 1], hashes)
                    n = len(first)
                    parts.append((trigger.astype(np.int64), word.astype(np.int64), np.full(n, did), np.full(n, th), _placed(first + at, last + at, where - first, FIRST)))
                    held += n
                    if held >= ROWS:
                        yield _presorted(parts)
                        parts, held = [], 0
        if parts:
            yield _presorted(parts)


def _pieces(batches: Iterator) -> Iterator[tuple]:
    """(did, th, start of the piece, its bytes, first, last, distance) of the listed ranges, of
    rows (did, th, data, places); a piece reaches far enough for all strings of its ranges."""
    import numpy as np

    for batch in batches:
        for did, th, data, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            data = np.frombuffer(data.as_buffer(), dtype=np.uint8)
            first, last, distance = _ranges(np.sort(places.values.to_numpy(zero_copy_only=False)))
            for at in range(0, len(data), PIECE):
                lo, hi = np.searchsorted(first, [at, at + PIECE])
                if hi > lo:
                    yield did, th, at, data[at : at + PIECE + 3 * WIDTH], first[lo:hi] - at, last[lo:hi] - at, distance[lo:hi]


def _spread(start, n):
    """For each i, start[i], start[i] + 1, ... (n[i] of them), and i itself."""
    import numpy as np

    owner = np.repeat(np.arange(len(n)), n)
    return start[owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner], owner


def _cells(batches: Iterator) -> Iterator:
    import numpy as np

    one, two = _Hashes(2), _Hashes(3)
    parts, held = [], 0
    with np.errstate(over="ignore"):
        for did, th, at, data, first, last, distance in _pieces(batches):
            trigger = first + distance
            near, far = (trigger - last) // CELL, distance // CELL
            cell, owner = _spread(near, far - near + 1)
            trigger, first, last = trigger[owner], first[owner], last[owner]
            lo, hi = np.maximum(first, trigger - CELL * cell - CELL + 1), np.minimum(last, trigger - CELL * cell)
            core = one.of(one.prefix(data), trigger - CELL * cell, trigger - CELL * cell - CELL + 1 + WIDTH)
            whole = _mixed(two.of(two.prefix(data), lo, hi + WIDTH) + ((trigger - lo) << 7 | (hi - lo)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            n = len(lo)
            parts.append((core.astype(np.int64), whole.astype(np.int64), np.full(n, did), np.full(n, th), _placed(lo + at, hi + at, np.zeros(n, dtype=np.int64), FIRST)))
            held += n
            if held >= ROWS:
                yield _presorted(parts)
                parts, held = [], 0
        if parts:
            yield _presorted(parts)


def _suffixes(batches: Iterator) -> Iterator:
    import numpy as np

    one, two = _Hashes(4), _Hashes(5)
    parts, held = [], 0
    with np.errstate(over="ignore"):
        for did, th, at, data, first, last, _ in _pieces(batches):
            start, _ = _spread(first, last - first + 1)
            x, y = (h.of(h.prefix(data), start, start + WIDTH) for h in (one, two))
            n = len(start)
            parts.append((x.astype(np.int64), y.astype(np.int64), np.full(n, did), np.full(n, th), _placed(start + at, start + at, np.zeros(n, dtype=np.int64), FIRST)))
            held += n
            if held >= ROWS:
                yield _presorted(parts)
                parts, held = [], 0
        if parts:
            yield _presorted(parts)


def _marked(batches: Iterator, shared: bool) -> Iterator:
    """Rows in order of (k1, k2, did, th, place): SEEN for all but the first of (k1, k2), and,
    if ``shared``, the first ones of a k1 that has several k2 as they are."""
    import numpy as np
    import pyarrow as pa

    previous, waiting = None, None  # keys of the last row; the last first row, if alone in its k1 so far

    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, did, th, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in _NAMES)
        known = (place & 3) == SEEN
        parts = [(did[known], th[known], place[known])]
        k1, k2, did, th, place = (x[~known] for x in (k1, k2, did, th, place))
        if len(k1):
            p1, p2 = (np.concatenate([[x], y[:-1]]) for x, y in zip(previous or (0, 0), (k1, k2), strict=True))
            new1, new2 = k1 != p1, (k1 != p1) | (k2 != p2)
            if previous is None:
                new1[0] = new2[0] = True
            previous = (k1[-1], k2[-1])
            parts.append((did[~new2], th[~new2], place[~new2] ^ (SEEN ^ FIRST)))
            heads = np.flatnonzero(new2)
            if shared and len(heads):
                alone = new1[heads]
                if waiting is not None and not alone[0]:
                    parts.append(waiting)
                several = ~alone
                several[:-1] |= alone[:-1] & ~alone[1:]
                parts.append(tuple(x[heads[several]] for x in (did, th, place)))
                waiting = tuple(x[heads[-1:]] for x in (did, th, place)) if alone[-1] else None
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["did", "th", "place"])


def _removal(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    for batch in batches:
        rows = []
        for did, data, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            data = np.frombuffer(data.as_buffer(), dtype=np.uint8)
            step = np.zeros(len(data) + 1, dtype=np.int64)
            if places.is_valid:
                first, last, _ = _ranges(places.values.to_numpy(zero_copy_only=False))
                np.add.at(step, first, 1)
                np.add.at(step, last + WIDTH, -1)
            gone = np.cumsum(step[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
            rows.append((None if did == _NO_ID else did, len(data), int(gone.sum()), len(spans), hashlib.sha256(data[~gone].tobytes()).hexdigest(), spans))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def repeated_strings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each document.

    Texts are shuffled once, by document, for all three joins; the shuffled rows of a sort are
    read again rather than kept where two steps need them.
    """
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every, data = _documents(docs)

    def marks(rows: DataFrame, shared: bool) -> DataFrame:
        dealt = rows.repartition(parts, "k1").sortWithinPartitions(*_NAMES)
        return dealt.mapInArrow(lambda it: _marked(it, shared), "did bigint, th bigint, place bigint")

    def listed(found: DataFrame) -> DataFrame:
        return found.groupBy("did", "th").agg(F.collect_list("place").alias("places"))

    def undecided(found: DataFrame) -> DataFrame:
        return data.join(listed(found.where(f"place & 3 = {FIRST}")), ["did", "th"]).select("did", "th", "data", "places")

    words = scratch.materialize(marks(data.mapInArrow(_phrases, _ROW), True), "words")
    cells = marks(undecided(words).mapInArrow(_cells, _ROW), True)
    suffixes = marks(undecided(cells).mapInArrow(_suffixes, _ROW), False)
    seen = words.unionByName(cells).where(f"place & 3 = {SEEN}").unionByName(suffixes)
    return every.join(listed(seen), ["did", "th"], "left").select("did", "data", "places").mapInArrow(
        _removal, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>"
    )


def op4_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
