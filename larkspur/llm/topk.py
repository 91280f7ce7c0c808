"""Exact top-k inner products: vectors by descending length, rotated partial sums, bounds.

* All vectors are summed into one matrix of second moments; its eigenvectors (the right
  singular vectors of the data) rotate vectors so that their first coordinates carry most.
  It has as many coordinates as most vectors, ROTATED at most; what a longer vector has
  beyond them counts to its residual.
* Vectors are sorted by length and cut into groups of blocks. The longest ones give each query a first
  threshold: the k-th best score so far. By that and by its own length it tells how long a vector
  must be to reach it (Cauchy-Schwarz), and queries are sorted by this and cut into groups as well.
* Groups of queries meet groups of vectors in cells of bounded size, but only where the longest vector
  reaches the lowest query: both are sorted, so each group of vectors is copied to a first few
  groups of queries, and the short ones to none.
* In a cell the same bound is applied by block and query; then the
  first rotated coordinates are multiplied, and only vectors for which this partial sum and
  the product of the residual lengths reach the threshold get an exact product. Thresholds
  rise as blocks go by, from long vectors to short ones.

Bounds are loosened by far more than rounding, and scores are exact integers, so the result
is that of comparing everything, ties included.

Defined results: a vector that is null, empty, or has a null or non-finite component takes no
part, as query or candidate; components and scores beyond 64 bits become the largest or
smallest that fits; vectors of any length take part, shorter ones as if padded by zeros; each row is a vector of its own, so rows that repeat an id are
candidates of each other and each a query; a null id is no query and comes last among ties;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

SCALE = 256
BLOCK = 4096
#: Blocks of queries and of candidates in a cell, more or less, and the share of coordinates in partial sums.
CELL = 4
SHARE = 4
#: Coordinates that are rotated, at most, and bounds of groups that come to the driver, at most.
ROTATED, BOUNDS = 1024, 1000
_NO_ID = 2**63 - 1
#: The largest component: a double below 2^63.
MOST = 2.0**63 - 1024


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v, norm2): integer vectors that take part; v is little-endian int64."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows = []
            for row, vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not x or None in x:
                    continue
                x = np.array(x, dtype=np.float64)
                if np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        v = np.floor(np.clip(scale * x, -MOST, MOST))
                    rows.append((row, _NO_ID if vec_id is None else vec_id, v.astype("<i8").tobytes(), float((v**2).sum()), len(v)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.int32()), strict=True)], names=["row", "vec_id", "v", "norm2", "dims"])

    source = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").cast("array<double>"))
    return scratch.materialize(source.mapInArrow(work, "row bigint, vec_id bigint, v binary, norm2 double, dims int"), "vectors")


def _matrix(blobs, dims: int):
    """The first ``dims`` components of each vector, zeros where it is shorter."""
    import numpy as np

    if all(len(b) == 8 * dims for b in blobs):
        return np.frombuffer(b"".join(blobs), dtype="<i8").reshape(-1, dims)
    out = np.zeros((len(blobs), dims), dtype="<i8")
    for i, b in enumerate(blobs):
        n = min(len(b) // 8, dims)
        out[i, :n] = np.frombuffer(b, dtype="<i8", count=n)
    return out


def _tails(blobs, dims: int) -> dict:
    """What vectors have beyond ``dims`` components: for each length (places, matrix)."""
    import numpy as np

    by: dict[int, list[int]] = {}
    for i, b in enumerate(blobs):
        if len(b) > 8 * dims:
            by.setdefault(len(b) // 8 - dims, []).append(i)
    return {n: (np.array(at), np.stack([np.frombuffer(blobs[i], dtype="<i8", offset=8 * dims) for i in at])) for n, at in by.items()}


def rotation(vectors: DataFrame, dims: int):
    """The strongest of the data's right singular vectors, as columns, over the first ``dims`` components. Tasks send
    their sums of products by entry; dims * dims numbers, ROTATED * ROTATED at most, come to the driver."""
    import numpy as np
    import pyarrow as pa

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("v").to_pylist(), dims).astype(np.float64)
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], names=["at", "x"])

    total = np.zeros(dims * dims)
    for r in vectors.select("v").mapInArrow(moments, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        total[r.at] = r.x
    values, axes = np.linalg.eigh(total.reshape(dims, dims))
    return np.ascontiguousarray(axes[:, np.argsort(values)[::-1][: max(1, dims // SHARE)]])


def _packed(rows: DataFrame, bound: str) -> DataFrame:
    """Blocks of up to BLOCK vectors in the order of each partition: (block, cell, rows, ids, vs, bounds),
    the last with a number of each row. ``cell`` is the number of the partition."""
    import pyarrow as pa

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])

        def out(n: int) -> pa.RecordBatch:
            part = [x[:n] for x in held]
            for x in held:
                del x[:n]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(t)) for x, t in zip(part, (pa.int64(), pa.int64(), pa.binary(), pa.float64()), strict=True)], names=["rows", "ids", "vs", "bounds"])

        for batch in batches:
            for x, c in zip(held, ("row", "vec_id", "v", bound), strict=True):
                x.extend(batch.column(c).to_pylist())
            while len(held[0]) >= BLOCK:
                yield out(BLOCK)
        if held[0]:
            yield out(len(held[0]))

    blocks = rows.select("row", "vec_id", "v", bound).mapInArrow(pack, "rows array<bigint>, ids array<bigint>, vs array<binary>, bounds array<double>")
    return blocks.select(F.monotonically_increasing_id().alias("block"), F.spark_partition_id().cast("bigint").alias("cell"), "*")


class _Block:
    def __init__(self, rows, ids, vs, dims: int, axes):
        import numpy as np

        self.rows, self.ids = np.asarray(rows, dtype=np.int64), np.asarray(ids, dtype=np.int64)
        self.exact, self.tails = _matrix(vs, dims), _tails(vs, dims)
        plain = self.exact.astype(np.float64)
        self.head = plain @ axes
        square = (plain**2).sum(axis=1)
        for at, m in self.tails.values():
            square[at] += (m.astype(np.float64) ** 2).sum(axis=1)
        self.norm = np.sqrt(square)
        self.rest = np.sqrt(np.maximum(square - (self.head**2).sum(axis=1), 0)) + 1e-6 * (1 + self.norm)

    def part(self, at):
        """(components, tails) of some rows."""
        import numpy as np

        place = np.full(len(self.ids), -1)
        place[at] = np.arange(len(at))
        return self.exact[at], {n: (place[i[place[i] >= 0]], m[place[i] >= 0]) for n, (i, m) in self.tails.items()}


def _reach(q, c) -> float:
    import numpy as np

    return float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * min(q.shape[1], c.shape[1])


def _fits(q, q_tails: dict, c, c_tails: dict):
    """The narrowest arithmetic that holds all products: doubles, 64-bit or Python's integers."""
    import numpy as np

    reach = _reach(q, c) + max((_reach(a, b) for _, a in q_tails.values() for _, b in c_tails.values()), default=0.0)
    return np.float64 if reach < 2**53 else np.int64 if reach < 2**62 else object


def _fitted(x):
    """Python integers as 64-bit ones."""
    import numpy as np

    return np.clip(x, -(2**63), 2**63 - 1).astype(np.int64)


def _products(q, q_tails: dict, c, c_tails: dict):
    """Exact products of all rows with all rows."""
    import numpy as np

    t = _fits(q, q_tails, c, c_tails)
    out = q.astype(t) @ c.astype(t).T
    for i, a in q_tails.values():
        for j, b in c_tails.values():
            n = min(a.shape[1], b.shape[1])
            out[np.ix_(i, j)] += a[:, :n].astype(t) @ b[:, :n].astype(t).T
    return _fitted(out) if t is object else out.astype(np.int64)


def _row_products(q: _Block, c: _Block, i, j):
    """Exact products of the rows ``i`` with the rows ``j``, one by one."""
    import numpy as np

    t = _fits(q.exact, q.tails, c.exact, c.tails)
    out = (q.exact[i].astype(t) * c.exact[j].astype(t)).sum(axis=1)
    for at, a in q.tails.values():
        for to, b in c.tails.values():
            n = min(a.shape[1], b.shape[1])
            x, y = np.full(len(q.ids), -1), np.full(len(c.ids), -1)
            x[at], y[to] = np.arange(len(at)), np.arange(len(to))
            both = np.flatnonzero((x[i] >= 0) & (y[j] >= 0))
            for p in both:
                out[p] += (a[x[i[p]], :n].astype(t) * b[y[j[p]], :n].astype(t)).sum()
    return _fitted(out) if t is object else out.astype(np.int64)


class _Best:
    """The k best (score, id, row) of each query of a block."""

    def __init__(self, q: _Block, k: int, floor):
        import numpy as np

        self.q, self.k = q, k
        self.floor = np.asarray(floor, dtype=np.float64).copy()
        self.found: list[list] = [[] for _ in q.ids]

    def meet(self, c: _Block) -> None:
        import numpy as np

        q = self.q
        active = np.flatnonzero(q.norm * c.norm.max() * (1 + 1e-9) + 1e-3 >= self.floor)
        if not len(active):
            return
        bound = q.head[active] @ c.head.T
        bound += q.rest[active, None] * c.rest[None, :]
        bound += 1e-3 + 1e-9 * q.norm[active, None] * c.norm[None, :]
        mask = bound >= self.floor[active, None]
        if mask.mean() > 0.02:
            score = _products(*q.part(active), c.exact, c.tails)
            mask &= score >= self.floor[active, None]
            i, j = np.nonzero(mask)
            s = score[i, j]
        else:
            i, j = np.nonzero(mask)
            s = np.concatenate([_row_products(q, c, active[i[x : x + 65536]], j[x : x + 65536]) for x in range(0, max(len(i), 1), 65536)])
        keep = (q.rows[active[i]] != c.rows[j]) & (s >= self.floor[active[i]])
        i, j, s = active[i[keep]], j[keep], s[keep]
        order = np.lexsort((c.rows[j], c.ids[j], ~s, i))  # ~s falls as s rises, without overflow
        i, j, s = i[order], j[order], s[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        for x in np.flatnonzero(place < self.k):
            self.found[i[x]].append((-int(s[x]), int(c.ids[j[x]]), int(c.rows[j[x]])))
        for x in np.unique(i):
            best = sorted(self.found[x])[: self.k]
            self.found[x] = best
            if len(best) == self.k:
                self.floor[x] = max(self.floor[x], np.nextafter(float(-best[-1][0]), -np.inf))


def _grouped(blocks: DataFrame, groups: int) -> DataFrame:
    """``blocks`` with the number of a group as ``cell``, in the same order: a cluster may deal them to more or
    fewer partitions than were asked for."""
    last = blocks.agg(F.max("cell")).first()[0] or 0
    return blocks.withColumn("cell", F.expr(f"cell * {groups}L div {last + 1}L"))


def _bounds(blocks: DataFrame, cells: int, lowest: bool) -> tuple[int, list[float]]:
    """(stride, bounds): for each ``stride`` cells in a row their lowest or highest bound, BOUNDS numbers at most.
    Bounds of cells rise if ``lowest``, else fall; a cell without blocks has the bound of the one before."""
    stride = -(-cells // BOUNDS)
    value = F.min(F.array_min("bounds")) if lowest else F.max(F.array_max("bounds"))
    found = {r.at: r.b for r in blocks.groupBy(F.expr(f"cell div {stride}").alias("at")).agg(value.alias("b")).collect()}
    out: list[float] = []
    for at in range(-(-cells // stride)):
        out.append(found.get(at, out[-1] if out else float("-inf" if lowest else "inf")))
    return stride, out


def _dealt(asked: DataFrame, blocks: DataFrame, gq: int, gc: int) -> tuple[DataFrame, DataFrame]:
    """Queries and candidates at each cell (cq, cc) in which the longest candidate reaches the lowest query."""
    asked, blocks = _grouped(asked, gq), _grouped(blocks, gc)
    sq, least = _bounds(asked, gq, True)
    sc, most = _bounds(blocks, gc, False)

    def upto(there: list[bool], stride: int, groups: int) -> int:
        return min(sum(there) * stride, groups)

    left = [upto([m >= t for m in most], sc, gc) for t in least]
    right = [upto([m >= t for t in least], sq, gq) for m in most]

    def copies(counts: list[int], stride: int) -> Column:
        n = f"array({', '.join(f'{x}L' for x in counts)})[cast(cell div {stride} as int)]"
        return F.explode(F.expr(f"if({n} > 0, sequence(0L, {n} - 1), array())"))

    return (
        asked.select(F.col("cell").alias("cq"), copies(left, sq).alias("cc"), "rows", "ids", "vs", "bounds"),
        blocks.select(copies(right, sc).alias("cq"), F.col("cell").alias("cc"), "block", "rows", "ids", "vs"),
    )


def _groups(n: int) -> int:
    return max(1, -(-n // (CELL * BLOCK)))


def cells(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = SCALE):
    """(queries, candidates, dims, axes): blocks of both at the cells (cq, cc) in which they meet, the components that are
    rotated and their axes; None without vectors. ``need`` is the length below which no vector reaches a query's threshold."""
    import numpy as np
    import pyarrow as pa

    ready = scaled(vectors, scale)
    common = ready.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return None
    dims = min(common.dims, ROTATED)
    axes = rotation(ready, dims)
    gc = _groups(ready.count())
    long_first = ready.withColumn("norm", F.sqrt("norm2")).repartitionByRange(gc, F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row")
    blocks = scratch.materialize(_packed(long_first, "norm"), "blocks")
    top = ready.orderBy(F.desc("norm2"), "row").limit(BLOCK).select("row", "vec_id", "v").collect()  # a block
    first = ([r.row for r in top], [r.vec_id for r in top], [bytes(r.v) for r in top])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = _Block(*first, dims, axes)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows, ids, vs = (batch.column(c)[at : at + BLOCK] for c in ("row", "vec_id", "v"))
                best = _Best(_Block(rows.to_pylist(), ids.to_pylist(), vs.to_pylist(), dims, axes), k, np.full(len(ids), -np.inf))
                best.meet(head)
                low, norm = best.floor - 1e-3, best.q.norm
                need = np.where(norm > 0, low / np.where(norm > 0, norm, 1), np.where(low <= 0, -np.inf, np.inf))
                need -= np.where(np.isfinite(need), 1e-8 * np.abs(np.where(np.isfinite(need), need, 0)), 0)
                yield pa.RecordBatch.from_arrays([rows, ids, vs, pa.array(need)], names=["row", "vec_id", "v", "need"])

    query = scratch.materialize(ready.where(f"vec_id % {every} = 0 and vec_id != {_NO_ID}").select("row", "vec_id", "v").mapInArrow(begin, "row bigint, vec_id bigint, v binary, need double"), "queries")
    gq = _groups(query.count())
    asked = scratch.materialize(_packed(query.repartitionByRange(gq, "need", "row").sortWithinPartitions("need", "row"), "need"), "asked")
    return *_dealt(asked, blocks, gq, gc), dims, axes


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) whose id
    is divisible by ``every``, the ``k`` other rows with the highest products."""
    import numpy as np
    import pyarrow as pa

    found = cells(vectors, every, k, scale)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    left, right, dims, axes = found

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64())] * 5, names=["query_row", "query_id", "vec_id", "row", "score"])
        b = b.sort_by("block")  # longest first
        candidates = [_Block(*(b.column(c)[x].as_py() for c in ("rows", "ids", "vs")), dims, axes) for x in range(b.num_rows)]
        out = []
        for x in range(a.num_rows):
            block = _Block(*(a.column(c)[x].as_py() for c in ("rows", "ids", "vs")), dims, axes)
            need = np.array(a.column("bounds")[x].as_py())
            best = _Best(block, k, np.where(np.isfinite(need), np.where(np.isfinite(need), need, 0) * block.norm, -np.inf))
            for c in candidates:
                best.meet(c)
            for row, vec_id, hits in zip(best.q.rows.tolist(), best.q.ids.tolist(), best.found, strict=True):
                out += [(row, vec_id, other, at, -s) for s, other, at in hits]
        return pa.table([pa.array([r[x] for r in out], pa.int64()) for x in range(5)], names=["query_row", "query_id", "vec_id", "row", "score"])

    result = "query_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint"
    hits = left.groupBy("cq", "cc").cogroup(right.groupBy("cq", "cc")).applyInArrow(cell, result)
    ranked = hits.withColumn("rank", F.expr("row_number() over (partition by query_row order by score desc, vec_id, row)")).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.expr(f"nullif(vec_id, {_NO_ID}L)").alias("vec_id"), "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
           where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
      from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
