"""Direct quantile forecasts by gradient-boosted trees whose histograms Spark adds up.

All fits (an origin and a quantile each) grow together. A pass sends the trees so far to the
tasks; each task adds its rows to the counts of (fit, node, input, bin), Spark sums these, and the
driver picks the splits of one level from the sums. A last pass of a round counts residuals
by leaf and bucket, and a leaf steps to the quantile of its residuals. Whatever the input's size, what comes
to the driver is one row for each cell. Counts are integers, so results do not depend on
how rows are dealt out, and no row is left out of a fit.

A training row belongs to every origin that is not before its target's day. Bins and codes come from
the rows of the first origin, so nothing after an origin is used but known covariates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.dialect import Dialect
from larkspur.plans.steps import Step, checkpointed

from .features import FEATURES, build_origin_frame, multi_horizon
from .forecasting import COLUMNS
from .lifecycle import REGIMES
from .ranks import dictionary, encode

NUMERIC = ["date_idx", "horizon", "future_dow", "future_price", "future_promo", *FEATURES, *[f"drat_{r}" for r in REGIMES], "drat_entropy", "drat_velocity", "drat_progress", "recovery_uncertainty", "recovery_confidence"]
CODED = ["category", "store"]
INPUTS = [*NUMERIC, *[f"{c}_code" for c in CODED]]
QUANTILES = (0.1, 0.5, 0.9)
MODEL = "quantile_gbm"
BINS = 32
LEAST_ROWS = 100
#: Rounds after which the rows' forecasts so far are written again.
REFRESH = 5
#: Residuals are counted by sign and by logarithm, 32 buckets to a doubling, between 2^-30 and 2^40.
_PER_DOUBLING, _LOW, _HIGH = 32, -30, 40
_SIDE = (_HIGH - _LOW) * _PER_DOUBLING + 1
_BUCKETS = 2 * _SIDE + 1

_EXTRA = [f"drat_{r}" for r in REGIMES] + ["drat_entropy", "drat_velocity", "drat_progress"]


def _inputs(d: Dialect) -> str:
    drat = ", ".join(f"r.{c}" for c in _EXTRA)
    return f"""
    select f.*, {drat}, v.recovery_uncertainty, v.recovery_confidence from {{featured}} f
    join {{regimes}} r on r.series_id = f.series_id and r.date_idx = f.date_idx join {{recovered}} v on v.series_id = f.series_id and v.date_idx = f.date_idx"""


#: Time features, regimes and recovery of each day: all that a direct forecaster learns from.
DIRECT_INPUTS = Step(("featured", "regimes", "recovered"), _inputs)


@dataclass
class Trees:
    """Trees of one fit: for each, the inputs and bins at which its inner nodes part, and its leaves.
    A node without a split sends all rows to the left."""

    start: float = 0.0
    splits: list = field(default_factory=list)
    leaves: list = field(default_factory=list)


def node_of(bins, split, depth: int):
    """The node at ``depth`` that each row of ``bins`` comes to; nodes of a level count from 0."""
    import numpy as np

    at, row = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    for level in range(depth):
        inputs, cuts = split[level]
        at = 2 * at + (bins[row, inputs[at]] > cuts[at])
    return at


def bucket_of(x):
    import numpy as np

    size = np.abs(x)
    with np.errstate(divide="ignore"):
        b = np.clip(np.rint(np.log2(size) * _PER_DOUBLING), _LOW * _PER_DOUBLING, _HIGH * _PER_DOUBLING).astype(np.int64) - _LOW * _PER_DOUBLING + 1
    return np.where(size < 2.0**_LOW, _SIDE, np.where(x > 0, _SIDE + b, _SIDE - b))


def value_of(bucket: int) -> float:
    side = bucket - _SIDE
    return 0.0 if side == 0 else (1 if side > 0 else -1) * 2.0 ** ((abs(side) - 1) / _PER_DOUBLING + _LOW)


@dataclass
class Boosting:
    """Trees of all fits over rows (row_hash, day, target, bins). ``fits`` are (origin, quantile)."""

    fits: list[tuple[int, float]]
    rounds: int = 30
    rate: float = 0.06
    depth: int = 3
    leaf: int = 12
    share: float = 0.85
    seed: int = 42
    bins: int = BINS

    def fit(self, rows: DataFrame, inputs: int) -> list[Trees]:
        import numpy as np

        trees = [Trees() for _ in self.fits]
        done = [0]
        rows = rows.withColumn("now", F.lit(None).cast("binary"))
        counts = self._pass(rows, trees, done, inputs, None, 0, None)
        total = counts.sum(axis=(1, 2))
        if total.min() < LEAST_ROWS:
            raise ValueError(f"not enough direct-training rows: {int(total.min())}")
        for k, (_, q) in enumerate(self.fits):
            trees[k].start = self._quantile(counts[k, 0], q)
        for n in range(self.rounds):
            growing: list = [[] for _ in self.fits]
            for level in range(self.depth):
                found = self._pass(rows, trees, done, inputs, growing, level, n)
                for k in range(len(self.fits)):
                    growing[k].append(self._splits(found[k], self.fits[k][1]))
            left = self._pass(rows, trees, done, inputs, growing, self.depth, n)
            for k, (_, q) in enumerate(self.fits):
                trees[k].splits.append(growing[k])
                trees[k].leaves.append(np.array([self._quantile(c, q) for c in left[k]]))
            if (n + 1) % REFRESH == 0 and n + 1 < self.rounds:
                rows = self._refreshed(rows, trees, done[0])
                done = [n + 1]
        return trees

    def _quantile(self, counts, q: float) -> float:
        import numpy as np

        n = counts.sum()
        return value_of(int(np.searchsorted(np.cumsum(counts), max(1, np.ceil(q * n))))) if n else 0.0

    def _splits(self, found, q: float):
        """(inputs, cuts) of the nodes of a level from ``found`` [node, input, bin, (rows, positive)]."""
        import numpy as np

        n, up = np.cumsum(found[..., 0], axis=2), np.cumsum(found[..., 1], axis=2)
        gradient = up - (1 - q) * n
        all_n, all_g = n[:, :, -1:], gradient[:, :, -1:]
        ok = (n >= self.leaf) & (all_n - n >= self.leaf)
        gain = np.where(ok, gradient**2 / np.maximum(n, 1) + (all_g - gradient) ** 2 / np.maximum(all_n - n, 1) - all_g**2 / np.maximum(all_n, 1), 0.0)
        flat = gain.reshape(len(gain), -1)
        best = flat.argmax(axis=1)
        none = flat[np.arange(len(flat)), best] <= 1e-12
        inputs, cuts = best // found.shape[2], best % found.shape[2]
        return np.where(none, 0, inputs), np.where(none, self.bins, cuts)

    def _now(self, batch, bins, trees: list[Trees], first: int):
        """The forecasts so far, a column for each fit: those written, and the trees from ``first`` on."""
        import numpy as np

        if first:
            now = np.frombuffer(b"".join(batch.column("now").to_pylist()), dtype="<f8").reshape(-1, len(trees)).copy()
        else:
            now = np.tile([t.start for t in trees], (len(bins), 1))
        for k, t in enumerate(trees):
            for split, leaves in zip(t.splits[first:], t.leaves[first:], strict=True):
                now[:, k] += self.rate * leaves[node_of(bins, split, self.depth)]
        return now

    def _pass(self, rows: DataFrame, trees: list[Trees], done: list[int], inputs: int, growing, level: int, n: int | None):
        """Sums over all rows. For a level: [fit][node, input, bin, (rows, residuals above 0)]; at
        full depth, or before the first round: [fit, leaf, bucket]."""
        import numpy as np
        import pyarrow as pa

        leaves = n is None or level == self.depth
        width = _BUCKETS if leaves else inputs * self.bins
        nodes = 1 if n is None else 2**level
        first, state = done[0], self

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((2, len(state.fits) * nodes * width), dtype=np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, inputs)
                day, target = batch.column("day").to_numpy(), batch.column("target").to_numpy()
                rest = target[:, None] - (state._now(batch, bins, trees, first) if n is not None else 0.0)
                drawn = np.ones(len(bins), dtype=bool) if n is None else state._drawn(batch.column("row_hash").to_numpy(), n)
                cells = None if leaves else bins + state.bins * np.arange(inputs, dtype=np.int64)
                for k, (origin, _) in enumerate(state.fits):
                    use = np.flatnonzero(drawn & (day <= origin))
                    if not len(use):
                        continue
                    node = np.zeros(len(use), dtype=np.int64) if n is None else node_of(bins[use], growing[k], level)
                    size, own = nodes * width, rest[use, k] if n is not None else rest[use, 0]
                    sums = held[:, k * size : (k + 1) * size]  # those of the fit alone
                    if leaves:
                        sums[0] += np.bincount(node * width + bucket_of(own), minlength=size)
                    else:
                        at = node[:, None] * width + cells[use]
                        sums[0] += np.bincount(at.ravel(), minlength=size)
                        sums[1] += np.bincount(at[own > 0].ravel(), minlength=size)
            full = np.flatnonzero(held[0])
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(held[0][full]), pa.array(held[1][full])], names=["cell", "n", "up"])

        parts = rows.select("row_hash", "day", "target", "bins", "now").mapInArrow(work, "cell bigint, n bigint, up bigint")
        found = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("up").alias("up")).toArrow()
        out = np.zeros((len(self.fits) * nodes * width, 2), dtype=np.int64)
        out[found.column("cell").to_numpy()] = np.stack([found.column("n").to_numpy(), found.column("up").to_numpy()], axis=1)
        if leaves:
            return out[:, 0].reshape(len(self.fits), nodes, width)
        return out.reshape(len(self.fits), nodes, inputs, self.bins, 2)

    def _drawn(self, row_hash, n: int):
        """Whether a row takes part in round ``n``: a hash of row and round."""
        import numpy as np

        with np.errstate(over="ignore"):
            x = row_hash.astype(np.uint64) ^ (np.uint64(n + 1) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed))
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(33)).astype(np.float64) < self.share * 2.0**31

    def _refreshed(self, rows: DataFrame, trees: list[Trees], first: int) -> DataFrame:
        import numpy as np
        import pyarrow as pa

        state = self

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8)
                now = state._now(batch, bins.reshape(batch.num_rows, -1), trees, first).astype("<f8")
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_hash", "day", "target", "bins")), pa.array([r.tobytes() for r in now], pa.binary())], names=["row_hash", "day", "target", "bins", "now"])

        return checkpointed(rows.select("row_hash", "day", "target", "bins", "now").mapInArrow(work, "row_hash bigint, day int, target double, bins binary, now binary"))


def edges_of(frame: DataFrame, columns: list[str], bins: int = BINS) -> list:
    """Per column, up to ``bins`` - 1 ascending values at which bins begin, from mergeable sketches."""
    import numpy as np

    at = [k / bins for k in range(1, bins)]
    row = frame.agg(*[F.percentile_approx(_finite(c), at, 10_000).alias(c) for c in columns]).first()
    return [np.unique(np.array(row[c] or [0.0], dtype=np.float64)) for c in columns]


def _finite(column: str) -> F.Column:
    """The column as double; null, NaN and infinite values count as 0."""
    return F.expr(f"if(cast({column} as double) is null or isnan(cast({column} as double)) or abs(cast({column} as double)) = double('infinity'), 0D, cast({column} as double))")


def binned(frame: DataFrame, columns: list[str], edges: list, keep: list[str]) -> DataFrame:
    """(``keep``, bins) of ``frame``: a byte for each of ``columns``."""
    import numpy as np
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(columns)), dtype=np.uint8)
            for k in range(len(columns)):
                out[:, k] = np.searchsorted(edges[k], batch.column(f"_x{k}").to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([r.tobytes() for r in out], pa.binary())], names=[*keep, "bins"])

    source = frame.select(*keep, *[_finite(c).alias(f"_x{k}") for k, c in enumerate(columns)])
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in keep)
    return source.mapInArrow(work, f"{shape}, bins binary")


def scored(frame: DataFrame, fits: list[tuple[int, float]], trees: list[Trees], rate: float, depth: int) -> DataFrame:
    """Rows (series_id, origin, date_idx, horizon, bins) with a column of forecasts for each quantile:
    trees go to the tasks in which the rows are."""
    import numpy as np
    import pyarrow as pa

    quantiles = sorted({q for _, q in fits})
    names = [f"q{round(100 * q)}" for q in quantiles]
    keep = ["series_id", "origin", "date_idx", "horizon"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((len(quantiles), batch.num_rows))
            if batch.num_rows:
                bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                origin = batch.column("origin").to_numpy()
                for (o, q), t in zip(fits, trees, strict=True):
                    at = np.flatnonzero(origin == o)
                    out[quantiles.index(q), at] = t.start + rate * sum(leaves[node_of(bins[at], split, depth)] for split, leaves in zip(t.splits, t.leaves, strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x) for x in out)], names=[*keep, *names])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields if f.name in keep)
    return frame.select(*keep, "bins").mapInArrow(work, shape + "".join(f", {n} double" for n in names))


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores: what they are dealt by before is the series, and small partitions of it are joined to one, which each
    pass would read in one task."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "row_hash")


def direct_quantile_forecast(inputs: DataFrame, origins: tuple[int, ...], horizon: int, **params) -> DataFrame:
    """(series_id, origin, date_idx, horizon, q10, q50, q90, model) at all ``origins``, from the rows of
    DIRECT_INPUTS. Every training row counts. Bounds are repaired to enclose the median."""
    origins = tuple(sorted(origins))
    fits = [(o, q) for o in origins for q in QUANTILES]
    known = inputs.where(F.col("date_idx") <= origins[-1])
    train = multi_horizon(known, horizon).where(F.col("target_day") <= origins[-1])
    early = inputs.where(F.col("date_idx") <= origins[0])
    codes = {c: checkpointed(dictionary(early, c)) for c in CODED}
    ask = None
    for o in origins:
        one = build_origin_frame(inputs.select([c for c in inputs.columns if c not in _EXTRA and not c.startswith("recovery_")]), o, horizon)
        base = inputs.where(F.col("date_idx") == o).select("series_id", *_EXTRA, "recovery_uncertainty", "recovery_confidence")
        one = one.join(base, "series_id").withColumn("origin", F.lit(o))
        ask = one if ask is None else ask.unionByName(one)
    for c in CODED:
        train, ask = (encode(x, c, codes[c], f"{c}_code") for x in (train, ask))
    first = train.where(F.col("target_day") <= origins[0])
    edges = edges_of(first, INPUTS)
    rows = binned(train.selectExpr("xxhash64(series_id, date_idx, horizon) as row_hash", "cast(target_day as int) as day", "cast(target as double) as target", *INPUTS), INPUTS, edges, ["row_hash", "day", "target"])
    boosting = Boosting(fits, **params)
    trees = boosting.fit(checkpointed(spread(rows)), len(INPUTS))
    out = scored(binned(ask, INPUTS, edges, ["series_id", "origin", "date_idx", "horizon"]), fits, trees, boosting.rate, boosting.depth)
    out = out.select("series_id", "origin", "date_idx", "horizon", *[F.greatest(f"q{round(100 * q)}", F.lit(0.0)).alias(f"q{round(100 * q)}") for q in QUANTILES])
    return out.select("series_id", "origin", "date_idx", "horizon", F.least("q10", "q50").alias("q10"), "q50", F.greatest("q90", "q50").alias("q90"), F.lit(MODEL).alias("model"))


def direct_step(origins: tuple[int, ...], horizon: int, **params) -> Step:
    """Forecasts of all origins; without SQL."""
    return Step(("inputs",), None, lambda inputs: direct_quantile_forecast(inputs, origins, horizon, **params).selectExpr(*COLUMNS.split(", ")))
