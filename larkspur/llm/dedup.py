"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and verification.

1. A document's set of word shingles (64-bit hashes) becomes m SetSketch registers: the
   minimum of an exponential variate per register, kept as a truncated exponent of base
   1.02. Registers of a union are the maxima, so sketches merge; equal registers are about
   as likely as the similarity.
2. Documents with one set (by a 128-bit hash) are one class, which one of its rows stands for.
3. Bands of five registers are bucket keys. The number of bands leaves a pair at the
   threshold out of all buckets with a chance of 10^-6 at most.
4. Classes that share a bucket get their full sets, once, in a table that is bucketed by
   class: whatever joins it moves pairs, not sets.
5. In each bucket, classes are first offered to the smallest one only. Pairs whose joint
   likelihood, from the registers that are greater, less and equal and both set sizes, all
   but rules out the threshold (by 15 in its logarithm) are dropped; so are those of which
   the parities of the set hashes by cell prove that too many shingles differ. The others are
   verified on their full sets, and linked ones joined into components.
6. Then buckets that still hold several components are compared between these, block by
   block: of the pairs that pass both tests, a block offers those of a spanning forest, those
   with most equal registers first. What is offered is verified, what fails is not offered
   again, and blocks where something failed have another round, with more forests. So a
   large group of near copies costs a few links each, no pair that is not a link is
   written but the few that the tests let through, and no link between components is lost.

Defined results: a text with fewer words than a shingle is one shingle; a null or wordless
one has an empty set and is linked with nothing; repeated rows are copies; rows that share
an id but not a text are judged each by its own text; a null id is never kept before a copy
that has one, and of a component without any id ``near_duplicates`` keeps all rows,
``deduplicated`` one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, names, scratch

ROWS = 5
BASE = 1.02
MISS = 1e-6
SLACK = 15.0
#: Classes of one bucket that are compared at once, and pairs that are held at once.
BLOCK, PAIRS = 4096, 1 << 17
#: Cells of a parity sketch for each shingle of the set, and the most of all.
CELLS, MOST_CELLS = 8, 1 << 15


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def shingle_set(text: bytes | None, k: int):
    """Sorted distinct 64-bit hashes of the k-word shingles of a UTF-8 text; A-Z is lower-cased."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < k:
        grams = {b" ".join(words)}
    else:
        grams = set(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))
    digest = xxhash.xxh3_64_intdigest
    return np.sort(np.fromiter(map(digest, grams), dtype=np.uint64, count=len(grams)))


def _set_key(hashes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


class SetSketcher:
    """Registers of sets of 64-bit hashes; uint16 exponents."""

    def __init__(self, m: int, base: float = BASE, seed: int = 7):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.m, self.base = m, base
        self._a = (rng.integers(0, 2**63, size=(m, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self._b = rng.integers(0, 2**64, size=(m, 1), dtype=np.uint64)

    def registers(self, hashes):
        import numpy as np

        least = np.full(self.m, 2**64 - 1, dtype=np.uint64)
        for at in range(0, len(hashes), 1024):
            v = self._a * hashes[None, at : at + 1024]
            v += self._b
            np.minimum(least, v.min(axis=1), out=least)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2**-52))
        return np.clip(np.floor(1 - np.log(x) / math.log(self.base)) + 64, 0, 65535).astype("<u2")


def likely(more, less, n_a, n_b, m: int, percent: int, base: float = BASE, slack: float = SLACK):
    """Whether the joint likelihood leaves room for a similarity of ``percent`` or more.

    ``more`` and ``less`` count registers of a above and below those of b (arrays). The
    likelihood has one peak: where it still rises at the threshold, the estimate is beyond;
    else the threshold itself is held against what fits the counts best.
    """
    import numpy as np

    more, less = np.asarray(more, float), np.asarray(less, float)
    n_a, n_b = np.asarray(n_a, float), np.asarray(n_b, float)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    same = m - more - less

    def p(x):
        return -np.log(np.maximum(1 - np.maximum(x, 0) * (base - 1) / base, 1e-300)) / math.log(base)

    def log_l(j):
        up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    best = sum(x * np.log(np.maximum(x, 1) / m) for x in (more, less, same))
    here = log_l(percent / 100)
    possible = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return possible & ((log_l(percent / 100 + 1e-4) >= here) | (best - here <= slack))


def cells_of(n: int) -> int:
    """Cells of the parity sketch of a set of ``n``: a power of two."""
    return min(MOST_CELLS, max(64, 1 << (CELLS * n - 1).bit_length()))


def parities(hashes) -> bytes:
    """Whether an odd number of ``hashes`` falls into a cell, one bit each. Where two sets differ
    in their parities, they differ in a member: a bound that no link can break."""
    import numpy as np

    cells = cells_of(len(hashes))
    count = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


class _Compared:
    """Tests of pairs among rows with n, registers and parities."""

    def __init__(self, n, regs, odd, m: int, percent: int):
        import numpy as np

        self.n, self.m, self.percent = n, m, percent
        self.regs = np.frombuffer(b"".join(regs), dtype="<u2").reshape(-1, m)
        self.wide = np.array([len(x) // 8 for x in odd], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.wide)[:-1]]) if len(odd) else self.wide
        self.odd = np.frombuffer(b"".join(odd), dtype="<u8")

    def _parities(self, rows, wide: int):
        """Parities of ``rows`` in ``wide`` words; twice as many are folded."""
        import numpy as np

        own = self.at[rows, None] + np.arange(wide)
        first = self.odd[own]
        double = self.wide[rows] > wide
        if double.any():
            first[double] ^= self.odd[own[double] + wide]
        return first

    def passing(self, i, j):
        """(which of the pairs pass both tests, number of their registers that differ)."""
        import numpy as np

        a, b = self.regs[i], self.regs[j]
        more, less = np.count_nonzero(a > b, axis=1), np.count_nonzero(a < b, axis=1)
        keep = np.flatnonzero(likely(more, less, self.n[i], self.n[j], self.m, self.percent))
        i, j = i[keep], j[keep]
        wide, ok = np.minimum(self.wide[i], self.wide[j]), np.zeros(len(keep), dtype=bool)
        for w in np.unique(wide):
            for at in range(0, len(x := np.flatnonzero(wide == w)), 1 << 14):
                y = x[at : at + (1 << 14)]
                differ = np.bitwise_count(self._parities(i[y], w) ^ self._parities(j[y], w)).sum(axis=1, dtype=np.int64)
                ok[y] = differ * (100 + self.percent) <= (self.n[i[y]] + self.n[j[y]]) * (100 - self.percent)
        return keep[ok], (more + less)[keep[ok]]


def sketched(docs: DataFrame, k: int, m: int) -> DataFrame:
    """(doc_id, rk, n, k1, k2, regs) of each row: a hash of id and text, set size, 128-bit set
    hash, and registers, which a task gives once for each set."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sketcher, seen = SetSketcher(m), set()
        for batch in batches:
            n, key, regs = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                key.append(own := _set_key(s))
                regs.append(None if own in seen or not len(s) else sketcher.registers(s).tobytes())
                seen.add(own)
            keys = np.frombuffer(b"".join(key), dtype="<i8").reshape(-1, 2)
            columns = [batch.column("doc_id"), batch.column("rk"), pa.array(n, pa.int64()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rk", "n", "k1", "k2", "regs"])

    return _rows(docs).mapInArrow(work, "doc_id bigint, rk bigint, n bigint, k1 bigint, k2 bigint, regs binary")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), F.col("text").cast("binary").alias("text"))


class _Sets:
    """The full sets of classes (cid, n, regs, odd, s) in a table bucketed by cid."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, parts: int):
        import pyarrow as pa

        self.spark, self.parts = docs.sparkSession, parts
        self.name = f"larkspur_sets_{uuid.uuid4().hex}"

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            seen = set()
            for batch in batches:
                rows = []
                for cid, n, k1, k2, regs, text in zip(*(batch.column(c) for c in ("cid", "n", "k1", "k2", "regs", "text")), strict=True):
                    if cid.as_py() in seen:
                        continue
                    s = shingle_set(text.as_py(), k)
                    if np.frombuffer(_set_key(s), dtype="<i8").tolist() == [k1.as_py(), k2.as_py()]:  # else another row of that hash
                        seen.add(cid.as_py())
                        rows.append((cid.as_py(), n.as_py(), regs.as_py(), parities(s), s.tobytes()))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["cid", "n", "regs", "odd", "s"])

        found = _rows(docs).drop("doc_id").join(classes, "rk").mapInArrow(work, "cid bigint, n bigint, regs binary, odd binary, s binary")
        once = found.repartition(parts, "cid").withColumn("nr", F.expr("row_number() over (partition by cid order by n)")).where("nr = 1").drop("nr")
        scratch.release(self.spark)
        once.write.bucketBy(parts, "cid").sortBy("cid").option("path", scratch.new_path(self.spark, "sets")).saveAsTable(self.name)

    def of(self, side: str, *columns: str) -> DataFrame:
        """(side, column_side, ...) of all classes."""
        return self.spark.table(self.name).selectExpr(f"cid as {side}", *[f"{c} as {c}_{side}" for c in columns])

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")  # its files stay with the scratch folder


def _star(pairs: DataFrame, sets: _Sets, m: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) that pass the tests."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            k = batch.num_rows
            if k:
                n, regs, odd = (np.concatenate([batch.column(f"{c}_{x}").to_numpy(zero_copy_only=False) for x in "ab"]) for c in ("n", "regs", "odd"))
                keep, _ = _Compared(n, regs, odd, m, percent).passing(np.arange(k), np.arange(k, 2 * k))
                yield batch.select(["a", "b"]).take(pa.array(keep))

    both = pairs.join(sets.of("a", "n", "regs", "odd"), "a").join(sets.of("b", "n", "regs", "odd"), "b")
    return both.mapInArrow(work, "a bigint, b bigint")


def _offers(batches, m: int, rows: int, percent: int, forests: int) -> Iterator:
    """(key, lo, hi, a, b): pairs that a block offers, of rows sorted by (key, lo, hi), of which those
    without registers name pairs that failed before."""
    import numpy as np
    import pyarrow as pa

    names = ["key", "lo", "hi", "a", "b"]

    def whole(t) -> pa.RecordBatch:
        """What the blocks in ``t`` offer, all of them complete."""
        key, lo, hi = (t.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lo", "hi"))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        group = np.cumsum(new) - 1
        real = t.column("regs").is_valid().to_numpy(zero_copy_only=False)
        cid, comp, block, band = (t.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "comp", "block", "band"))
        failed = set(zip(group[~real].tolist(), cid[~real].tolist(), comp[~real].tolist(), strict=True))
        at = np.flatnonzero(real)
        if not len(at):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], names=names)
        group, cid, comp, block, band, cross = group[at], cid[at], comp[at], block[at], band[at], (lo != hi)[at]
        t = t.take(pa.array(at))
        n = t.column("n").to_numpy(zero_copy_only=False)
        test = _Compared(n, t.column("regs").to_pylist(), t.column("odd").to_pylist(), m, percent)
        keys = np.ascontiguousarray(test.regs).reshape(len(at), -1, rows)
        keys = (keys.astype(np.uint64) * np.array([0x9E3779B97F4A7C15 ** (x + 1) % 2**64 for x in range(rows)], dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
        _, node = np.unique(np.stack([group, comp]), axis=1, return_inverse=True)
        node = node.ravel()
        trees = [np.arange(node.max(initial=-1) + 1) for _ in range(forests)]

        def top(tree, x: int) -> int:
            while tree[x] != x:
                tree[x] = x = tree[tree[x]]
            return x

        after = np.searchsorted(group, group, side="right") - np.arange(len(at)) - 1  # rows of the block behind each
        upto, found, start = np.cumsum(after), [], 0
        while start < len(at):
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, side="right")))
            i = np.repeat(np.arange(start, end), after[start:end])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[start:end]) - after[start:end], after[start:end])
            start, last = end, trees[-1]
            while (last[last] != last).any():
                last = last[last]
            ok = (last[node[i]] != last[node[j]]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (~cross[i] | (block[i] != block[j]))
            i, j = i[ok], j[ok]
            ok = (keys[i] == keys[j]).argmax(axis=1) == band[i]  # in the first band that they share
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            keep, differ = test.passing(i, j)
            order = np.argsort(differ, kind="stable")
            for x, y in zip(i[keep][order].tolist(), j[keep][order].tolist(), strict=True):
                a, b = sorted((int(cid[x]), int(cid[y])))
                if (group[x], a, b) in failed:
                    continue
                for tree in trees:
                    p, q = top(tree, node[x]), top(tree, node[y])
                    if p != q:
                        tree[max(p, q)] = min(p, q)
                        found.append((x, a, b))
                        break
        k = at[[x for x, _, _ in found]] if found else np.empty(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key[k]), pa.array(lo[k]), pa.array(hi[k]), pa.array([a for _, a, _ in found], pa.int64()), pa.array([b for _, _, b in found], pa.int64())], names=names)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        key, lo, hi = (held.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lo", "hi"))
        edge = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
        if len(edge):
            yield whole(held.slice(0, edge[-1] + 1))
            held = held.slice(edge[-1] + 1)
    if held is not None:
        yield whole(held)


def _verified(pairs: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """``pairs`` (…, a, b) with ``ok``: whether the full sets have the similarity."""
    import pyarrow as pa

    keep = pairs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            ok = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(ok, pa.bool_())], names=[*keep, "ok"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    both = pairs.join(sets.of("a", "s"), "a").join(sets.of("b", "s"), "b")
    return scratch.materialize(both.mapInArrow(work, f"{shape}, ok boolean"), "verified")


def _linked(docs: DataFrame, classes: DataFrame, bands: int, k: int, percent: int) -> DataFrame:
    """(node, component) of the classes (cid, rk, n, k1, k2, regs) that are linked."""
    m = bands * ROWS
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    banded = classes.select("cid", F.posexplode(F.expr(f"transform(sequence(0, {bands - 1}), b -> xxhash64(b, substring(regs, b * {2 * ROWS} + 1, {2 * ROWS})))")).alias("band", "key"))
    centres = banded.groupBy("key").agg(F.min("cid").alias("centre"), F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = scratch.materialize(banded.join(centres, "key"), "shared")
    sets = _Sets(docs, classes.join(shared.select("cid").distinct(), "cid", "left_semi"), k, parts)

    # First round: to the smallest class of each bucket.
    star = scratch.materialize(_star(shared.where("cid != centre").selectExpr("centre as a", "cid as b").distinct(), sets, m, percent), "pairs")
    links = _verified(star, sets, percent).where("ok").select("a", "b")
    known, failed, todo, forests = graph.components(links), None, None, 1

    # Further rounds: buckets that hold several components, between these. A block is done when all
    # that it offered are links: what it did not offer lies within a component then.
    while True:
        open_ = shared if todo is None else shared.join(todo.select("key").distinct(), "key", "left_semi")
        own = scratch.materialize(open_.join(known.withColumnRenamed("node", "cid"), "cid", "left").selectExpr("key", "band", "cid", "coalesce(component, cid) as comp", "c"), "own")
        several = own.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least != most").select("key")
        blocks = (
            own.join(several, "key").join(sets.of("cid", "n", "regs", "odd"), "cid")
            .selectExpr("*", f"cast(ceil(c / {BLOCK}D) as int) as blocks")
            .selectExpr("*", "cast(pmod(xxhash64(cid), blocks) as int) as block")
            .selectExpr("*", "explode(sequence(0, blocks - 1)) as other")
            .selectExpr("key", "least(block, other) as lo", "greatest(block, other) as hi", "band", "block", "cid", "comp", "n_cid as n", "regs_cid as regs", "odd_cid as odd")
        )
        if todo is not None:
            blocks = blocks.join(todo, ["key", "lo", "hi"], "left_semi").unionByName(failed.join(todo, ["key", "lo", "hi"], "left_semi").selectExpr("key", "lo", "hi", "0 as band", "0 as block", "a as cid", "b as comp", "0L as n", "cast(null as binary) as regs", "cast(null as binary) as odd"))
        spread = blocks.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        offered = scratch.materialize(spread.mapInArrow(lambda it, f=forests: _offers(it, m, ROWS, percent, f), "key bigint, lo int, hi int, a bigint, b bigint"), "offered")
        if offered.isEmpty():
            break
        tried = _verified(offered, sets, percent)
        links = links.unionByName(tried.where("ok").select("a", "b"))
        known, forests = graph.components(links), min(64, forests * 4)
        fresh = tried.where("not ok").drop("ok")
        failed = fresh if failed is None else failed.unionByName(fresh)
        todo = scratch.materialize(fresh.select("key", "lo", "hi").distinct(), "todo")
        if todo.isEmpty():
            break
    sets.drop()
    return known


def _components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(row, doc_id, rk, n, component, component_id) of each row of ``docs``; component is null for
    empty sets."""
    bands = bands_for(percent)
    sketch = scratch.materialize(sketched(docs, k, bands * ROWS).withColumn("row", F.monotonically_increasing_id()), "sketch")
    # The smallest row of a class is the first of its task, so it has the registers.
    reps = scratch.materialize(sketch.where("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("cid"), F.min("doc_id").alias("least")), "reps")
    classes = scratch.materialize(sketch.where("regs is not null").join(reps.select("cid"), F.expr("row = cid")).select("cid", "rk", "n", "k1", "k2", "regs"), "classes")
    known = _linked(docs, classes, bands, k, percent).withColumnRenamed("node", "cid")
    named = scratch.materialize(reps.join(known, "cid", "left").selectExpr("k1", "k2", "coalesce(component, cid) as component", "least"), "named")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return sketch.drop("regs").join(named.join(ids, "component").select("k1", "k2", "component", "component_id"), ["k1", "k2"], "left").select("row", "doc_id", "rk", "n", "component", "component_id")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text).

    Documents are linked whose sets of ``k``-word shingles have a similarity of ``percent``
    or more; component_id is the smallest id that is reachable.
    """
    return _components(docs, k, percent).selectExpr(
        "doc_id", "n as n_shingles", "if(n > 0, component_id, doc_id) as component_id",
        "coalesce(doc_id = if(n > 0, component_id, doc_id), n = 0 or component_id is null) as kept",
    )


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest id, and all rows with empty sets.
    Rows meet the keys of those that stay in one join by a hash of id and text."""
    found = scratch.materialize(_components(docs, k, percent), "components")
    first = found.where("n > 0").groupBy("component").agg(F.min_by("rk", F.struct(F.expr("doc_id is null"), "doc_id", "row")).alias("rk")).select("rk")
    (rk, nr), own = names.free(docs.columns, "rk", "nr"), [F.col(f"`{c}`") for c in docs.columns]
    empty = F.expr("not coalesce(text, '') rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    keyed = docs.where(~empty).withColumn(rk, F.xxhash64("doc_id", "text"))
    rows = keyed.join(first.withColumnRenamed("rk", rk), rk, "left_semi")
    again = scratch.materialize(found.where("n > 0").join(first, "rk", "left_semi").groupBy("rk").count().where("count > 1").select("rk"), "again")
    if not again.isEmpty():  # repeated rows: one of each
        twice = rows.join(again.withColumnRenamed("rk", rk), rk, "left_semi")
        rows = rows.join(again.withColumnRenamed("rk", rk), rk, "left_anti").unionByName(twice.dropDuplicates([rk, "text"]))
    return rows.select(*own).unionByName(docs.where(empty))


def op1_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)
