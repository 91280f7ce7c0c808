"""Vector code compression: codebooks by weighted Lloyd rounds over distinct integer parts.

Components become integers and vectors are cut into equal consecutive parts. Per position,
equal parts are counted into weighted distinct rows, so a part that millions of vectors share is
compared once. Each round assigns every distinct part to the nearest entry of its position's
codebook and replaces entries by weighted means; tasks add up their own parts first, and only
sums per position and entry travel. At the end codes and errors of the distinct parts are joined
back to the vectors.

Distances are exact: in floating point where all numbers stay below 2^53, else the candidates
that rounding leaves open are compared in Python's integers.

What the driver holds is the codebooks: ``entries`` numbers for each dimension.

Defined results: a vector that is null or holds null or non-finite components is left out. The
dimension is the most frequent length (ties: the greater); vectors of another length stay, with
null code and error, and train nothing. A dimension that ``parts`` does not divide is
padded by zeros. A label without errors has a null sum. Scaled components beyond 64 bits are cut to 64 bits, so are errors and sums of
errors. Rows that repeat an id are vectors of their own; a null id sorts last, rows of one id sort by
their components; null labels are one label; a codebook has fewer entries if there are fewer
vectors; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: The largest component: a double below 2^63.
MOST = 2.0**63 - 1024
_LONG = 2**63 - 1


def integer_parts(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """(row, vec_id, label, dims, parts) of all vectors without null or non-finite components.
    A part is a blob of little-endian integers of the least width that holds all of its own."""
    import pyarrow as pa

    label = vectors.schema["label"].dataType.simpleString()
    vec_id = vectors.schema["vec_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            column = batch.column("embedding")
            starts, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(starts)
            blobs: list = [None] * batch.num_rows
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                width = -(-int(dims) // parts)
                m = np.zeros((len(at), width * parts), dtype=np.int64)
                with np.errstate(over="ignore"):
                    m[:, :dims] = np.floor(np.clip(scale * flat[starts[at][:, None] + np.arange(dims)], -MOST, MOST)).astype(np.int64)
                cut = [packed(m[:, k * width : (k + 1) * width]) for k in range(parts)]
                for x, row in zip(at.tolist(), zip(*cut, strict=True), strict=True):
                    blobs[x] = row
            arrays = [batch.column(c) for c in ("row", "vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lengths, pa.int32()), pa.array(blobs, pa.list_(pa.binary()))], names=["row", "vec_id", "label", "dims", "parts"])

    sound = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    source = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(sound)
    return scratch.materialize(source.mapInArrow(work, f"row bigint, vec_id {vec_id}, label {label}, dims int, parts array<binary>"), "parts")


def packed(m) -> list[bytes]:
    """Rows of an int64 matrix as blobs, each of the least width of 1, 2, 4 or 8 bytes."""
    import numpy as np

    out: list[bytes] = [b""] * len(m)
    low, high = m.min(axis=1, initial=0), m.max(axis=1, initial=0)
    todo = np.ones(len(m), dtype=bool)
    for kind in ("<i1", "<i2", "<i4", "<i8"):
        span = np.iinfo(kind)
        fits = todo & (low >= span.min) & (high <= span.max)
        todo &= ~fits
        data, step = m[fits].astype(kind).tobytes(), m.shape[1] * span.bits // 8
        for k, x in enumerate(np.flatnonzero(fits).tolist()):
            out[x] = data[k * step : (k + 1) * step]
    return out


def unpacked(blobs: list[bytes], width: int):
    """The int64 matrix behind ``packed`` blobs of ``width`` components."""
    import numpy as np

    sizes = np.array([len(b) for b in blobs], dtype=np.int64)
    out = np.zeros((len(blobs), width), dtype=np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        if size:
            out[at] = np.frombuffer(b"".join(blobs[x] for x in at), dtype=f"<i{size // width}").reshape(-1, width)
    return out


def nearest(x, book):
    """Index of the nearest row of ``book`` (ties to the lower one) and the squared distance, up to 2^63 - 1, for each row of ``x``."""
    import numpy as np

    fx, fb = x.astype(np.float64), book.astype(np.float64)
    xx, bb = (fx**2).sum(axis=1), (fb**2).sum(axis=1)
    reach = np.abs(fx).max(initial=0) + np.abs(fb).max(initial=0)
    d = xx[:, None] - 2 * (fx @ fb.T) + bb[None, :]
    best = d.argmin(axis=1)
    if x.shape[1] * reach**2 < 2**52:  # all numbers above are exact integers
        return best, d[np.arange(len(x)), best].astype(np.int64)
    slack = (1e-14 * (x.shape[1] + 4)) * (xx[:, None] + bb[None, :])
    open_ = d - slack <= (d + slack).min(axis=1)[:, None]
    found = np.zeros(len(x), dtype=np.int64)
    exact_book = [[int(v) for v in row] for row in book]
    for i in range(len(x)):
        own = [int(v) for v in x[i]]
        dist, best[i] = min((sum((a - b) ** 2 for a, b in zip(own, exact_book[j], strict=True)), j) for j in np.flatnonzero(open_[i]).tolist())
        found[i] = min(dist, _LONG)
    return best, found


def sums_by_entry(x, weight, entry) -> list[tuple[int, int, list[int]]]:
    """(entry, count, sums of the components) of weighted rows."""
    import numpy as np

    order = np.argsort(entry, kind="stable")
    x, weight, entry = x[order], weight[order], entry[order]
    first = np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))
    if np.abs(x.astype(np.float64)).max(initial=0) * float(weight.sum()) >= 2**62:
        x, weight = x.astype(object), weight.astype(object)
    total = np.add.reduceat(x * weight[:, None], first, axis=0)
    count = np.add.reduceat(weight, first)
    return [(int(e), int(n), [int(v) for v in s]) for e, n, s in zip(entry[first], count, total, strict=True)]


def _by_position(batch, width: int):
    """(position, row numbers, matrix) of a batch of distinct parts."""
    import numpy as np

    position, blobs = batch.column("pos").to_numpy(), batch.column("part").to_pylist()
    for pos in np.unique(position).tolist():
        at = np.flatnonzero(position == pos)
        yield pos, at, unpacked([blobs[x] for x in at.tolist()], width)


def lloyd_round(distinct: DataFrame, books: list, width: int) -> list:
    """The codebooks after one round; at most an entry's row for each position comes to the driver."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("pos", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for pos, at, x in _by_position(batch, width):
                for e, n, s in sums_by_entry(x, weight[at], nearest(x, books[pos])[0]):
                    old = held.get((pos, e))
                    held[pos, e] = [n, s] if old is None else [old[0] + n, [a + b for a, b in zip(old[1], s, strict=True)]]
        rows = [(pos, e, n, [Decimal(v) for v in s]) for (pos, e), (n, s) in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    part = distinct.mapInArrow(work, "pos int, entry int, n bigint, sums array<decimal(38,0)>")
    total = part.groupBy("pos", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums"))
    new = [b.copy() for b in books]
    for r in total.collect():
        new[r.pos][r.entry] = np.array([int(s) // r.n for s in r.sums], dtype=np.int64)
    return new


def assigned(distinct: DataFrame, books: list, width: int) -> DataFrame:
    """``distinct`` (pos, part) with the nearest entry and the squared distance."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            code, error = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows, dtype=np.int64)
            for pos, at, x in _by_position(batch, width):
                code[at], error[at] = nearest(x, books[pos])
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("part"), pa.array(code), pa.array(error)], names=["pos", "part", "entry", "distance"])

    return distinct.select("pos", "part").mapInArrow(work, "pos int, part binary, entry int, distance bigint")


def _total(column: str) -> F.Column:
    """An exact sum of longs that are not negative, cut to 64 bits; null if all are null."""
    exact = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.when(exact > _LONG, F.lit(_LONG)).otherwise(exact.cast("bigint"))


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list]:
    """((vec_id, label, codes, error) of ``vectors`` (vec_id, embedding, label), codebooks).

    ``codes`` holds an entry for each part, in order; a codebook is a matrix of integers.
    """
    import numpy as np

    ready = integer_parts(vectors, scale, parts)
    mode = ready.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = mode.dims if mode else 0
    width = -(-dims // parts)
    usual = ready.where((F.col("dims") == dims) & (F.col("dims") > 0))
    # A vector's components decide among rows of one id; arrays of blobs do not sort by them, so ties are settled here.
    last = usual.orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).select("vec_id").collect()
    books = [np.zeros((0, width), dtype=np.int64)] * parts
    if last:
        bound = last[-1].vec_id
        below = usual.where(F.col("vec_id") < bound) if bound is not None else usual.where("vec_id is not null")
        rows = [(r.vec_id, r.parts) for r in below.select("vec_id", "parts").collect()]  # fewer than ``entries``
        ties = usual.where(F.col("vec_id").eqNullSafe(F.lit(bound)))
        ties = _smallest(ties, entries - len(rows), width)
        first = [np.concatenate([unpacked([p[k] for _, p in rows], width), np.array([t[k * width : (k + 1) * width] for t in ties], dtype=np.int64).reshape(-1, width)]) for k in range(parts)]
        whole = np.concatenate(first, axis=1)
        ids = [r[0] for r in rows] + [bound] * len(ties)
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0, whole[k].tolist()))
        books = [f[order] for f in first]
    exploded = usual.select("row", F.posexplode("parts").alias("pos", "part"))
    distinct = scratch.materialize(exploded.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("weight")), "distinct")
    if last:
        for _ in range(rounds):
            books = lloyd_round(distinct, books, width)
    coded = exploded.join(assigned(distinct, books, width), ["pos", "part"])
    by_row = coded.groupBy("row").agg(F.array(*[F.max(F.when(F.col("pos") == k, F.col("entry"))) for k in range(parts)]).alias("codes"), _total("distance").alias("error"))
    return ready.select("row", "vec_id", "label").join(by_row, "row", "left").drop("row"), books


def _smallest(rows: DataFrame, n: int, width: int) -> list[list[int]]:
    """The ``n`` first of ``rows`` by their components; each task sends its own ``n``."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import heapq

        best: list[list[int]] = []
        for batch in batches:
            own = [[v for p in unpacked(parts, width).tolist() for v in p] for parts in batch.column("parts").to_pylist()]
            best = heapq.nsmallest(n, best + own)
        yield pa.RecordBatch.from_arrays([pa.array(best, pa.list_(pa.int64()))], names=["x"])

    return [r.x for r in rows.select("parts").mapInArrow(work, "x array<bigint>").orderBy("x").limit(n).collect()] if n else []


def codebooks_digest(books: list) -> str:
    numbers = (str(v) for book in books for entry in book.tolist() for v in entry)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the sum of ``error`` over all rows of its label."""
    kept = scratch.materialize(coded, "coded")
    totals = kept.groupBy(F.col("label").alias("_c_label")).agg(_total("error").alias("label_error"))
    return kept.join(totals, kept["label"].eqNullSafe(totals["_c_label"])).drop("_c_label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.expr("array_join(transform(codes, c -> lower(lpad(hex(c), 2, '0'))), '')")
    return with_label_error(coded).select("vec_id", F.when(F.col("codes").isNotNull(), code).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Plain rounds over all vectors; floors go down as floor() of exact quotients."""
    ctes = [
        """v as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as x, row_number() over (order by vec_id) as nr from embeddings
  where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))))""",
        "p as (select nr, k as pos, list_slice(x, k * len(x) // 4 + 1, (k + 1) * len(x) // 4) as part from v cross join (select unnest(range(4)) as k))",
        "b0 as (select pos, nr - 1 as entry, part from p where nr <= 256)",
    ]
    for n in range(ROUNDS + 1):
        ctes.append(
            f"""a{n} as materialized (select p.nr, p.pos, p.part, min(struct_pack(d := list_sum(list_transform(list_zip(p.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, e := b.entry)) as best
  from p join b{n} b on p.pos = b.pos group by all)"""
        )
        if n < ROUNDS:
            ctes.append(
                f"""s{n} as (select pos, best.e as entry, i, sum(part[i])::hugeint as s, count(*) as c from (select *, unnest(range(1, len(part) + 1)) as i from a{n}) group by all),
m{n} as (select pos, entry, list((s - ((s % c) + c) % c) // c order by i)::bigint[] as part from s{n} group by all),
b{n + 1} as materialized (select b.pos, b.entry, coalesce(m.part, b.part) as part from b{n} b left join m{n} m on b.pos = m.pos and b.entry = m.entry)"""
            )
    ctes.append(f"f as (select nr, string_agg(printf('%02x', best.e), '' order by pos) as code, sum(best.d)::bigint as error from a{ROUNDS} group by nr)")
    ctes.append(f"h as (select sha256(string_agg(array_to_string(part, ','), ',' order by pos, entry)) as codebooks_sha256 from b{ROUNDS})")
    return "with " + ",\n".join(ctes) + "\nselect vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from v join f using (nr), h"


OP12_SQL = _sql()
