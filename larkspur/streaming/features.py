"""Past-only features as a stream: a state for each series keeps the last 28 days, no more.

Days of a series may come late and out of order: a day waits until one that is ``lateness`` days
later has come, then all days up to it are worked off in order. A row without a value tells that a day
is over and brings nothing else. A day that comes again is the same day; the first row counts. A day that
comes after its turn is passed on with ``late`` = 1 and without features, so that nothing is lost silently.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from larkspur.operators.features import FEATURES, time_features_step
from larkspur.plans.steps import Step, shared_folder

RING = 28
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "series_id string, date_idx int, late int, " + ", ".join(f"{f} double" for f in FEATURES)
_STATE = "age bigint, last_day int, clock int, price double, ring array<double>, days array<int>, values array<double>, prices array<double>"


def features_of(ring: list[float], age: int, price: float | None, last_price: float | None) -> list[float]:
    """FEATURES of a day from the values of the days before it, latest last."""
    from statistics import fmean, stdev

    lag = [ring[-k] if len(ring) >= k else 0.0 for k in (1, 7, 14, 28)]
    rolls = []
    for w in (7, 14, 28):
        own = ring[-w:]
        rolls += [fmean(own), stdev(own)] if len(own) >= 2 else [0.0, 0.0]
    zeros = sum(v == 0 for v in ring[-14:]) / min(age + 1, 14) if age else 0.0
    change = (price - last_price) / last_price if price is not None and last_price else 0.0
    return [*lag, *rolls, zeros, change, float(age)]


class PastOnly(StatefulProcessor):
    """A series' state: its ring of values, how many days it has had, the last price, and the days that wait."""

    def __init__(self, lateness: int):
        self.lateness = lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", _STATE)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        age, last_day, clock, price, ring, days, values, prices = self.state.get() if self.state.exists() else (0, None, None, None, [], [], [], [])
        ring, waiting, out = list(ring), {d: (v, p) for d, v, p in zip(days, values, prices, strict=True)}, []
        for pdf in rows:
            for day, value, cost in zip(pdf["date_idx"].tolist(), pdf["value"].tolist(), pdf["price"].tolist(), strict=True):
                clock = day if clock is None else max(clock, day)
                if value is None or value != value:
                    continue
                if last_day is not None and day <= last_day:
                    if day in self._worked_off(last_day, age):
                        continue
                    out.append([key[0], day, 1, *[None] * len(FEATURES)])
                    continue
                waiting.setdefault(day, (value, None if cost is None or cost != cost else cost))
        for day in sorted(d for d in waiting if d <= clock - self.lateness):
            value, cost = waiting.pop(day)
            out.append([key[0], day, 0, *features_of(ring, age, cost, price)])
            ring, age, last_day, price = [*ring, float(value)][-RING:], age + 1, day, cost
        held = sorted(waiting)
        self.state.update((age, last_day, clock, price, ring, held, [float(waiting[d][0]) for d in held], [waiting[d][1] for d in held]))
        yield pd.DataFrame(out, columns=["series_id", "date_idx", "late", *FEATURES]).astype({"date_idx": "int32", "late": "int32"})

    @staticmethod
    def _worked_off(last_day: int, age: int) -> range:
        """Days of a gapless series that have had their turn."""
        return range(last_day - age + 1, last_day + 1)

    def close(self) -> None:
        pass


def stream_features(days: DataFrame, value: str = "sales", lateness: int = 0) -> DataFrame:
    """A stream of OUTPUT rows from a stream of ``days`` (series_id, date_idx, ``value``, price)."""
    rows = days.selectExpr("series_id", "cast(date_idx as int) as date_idx", f"cast({value} as double) as value", "cast(price as double) as price")
    return rows.groupBy("series_id").transformWithStateInPandas(PastOnly(lateness), OUTPUT, "Append", "None")


def streamed_step(parts: int, days: int) -> Step:
    """The features of a panel that comes in ``parts`` of equal numbers of its ``days``; the SELECT
    over the whole panel is the oracle."""

    def build(panel: DataFrame) -> DataFrame:
        spark, folder = panel.sparkSession, f"{shared_folder(panel.sparkSession)}/features-{uuid.uuid4().hex}"
        own = panel.select("series_id", "date_idx", "sales", "price")
        for k in range(parts):
            own.where(f"date_idx >= {k * days // parts} and date_idx < {(k + 1) * days // parts}").write.parquet(f"{folder}/in/part={k}")
        before = spark.conf.get(PROVIDER)
        spark.conf.set(PROVIDER, ROCKSDB)
        try:
            stream = spark.readStream.schema(own.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
            sink = stream_features(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
            sink.trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.set(PROVIDER, before)
        return spark.read.parquet(f"{folder}/out").where("late = 0")

    return Step(("panel",), time_features_step().sql, build)
