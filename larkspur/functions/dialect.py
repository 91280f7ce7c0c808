"""The few spellings in which Spark SQL and DuckDB differ, so that a plan step is stated once."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def quantile(self, x: str, p: float = 0.5) -> str:
        """Exact quantile with linear interpolation; also over a frame."""
        return f"percentile({x}, {p})" if self.spark else f"quantile_cont({x}, {p})"

    def uniform(self, *key: str) -> str:
        """A number in [0, 1) that depends on the key's text alone: rows may come in any order."""
        k = "concat_ws('|', " + ", ".join(f"cast({x} as string)" for x in key) + ")"
        if self.spark:
            return f"(cast(conv(substr(md5({k}), 1, 13), 16, 10) as double) / 4503599627370496e0)"
        return f"(concat('0x', substr(md5({k}), 1, 13))::bigint::double / 4503599627370496e0)"

    def normal(self, *key: str) -> str:
        """A standard normal variate of the key (Box-Muller)."""
        return f"(sqrt(-2e0 * ln(1e0 - {self.uniform(*key, chr(39) + 'a' + chr(39))})) * cos(6.283185307179586e0 * {self.uniform(*key, chr(39) + 'b' + chr(39))}))"

    def series(self, first: str | int, last: str | int) -> str:
        return f"explode(sequence({first}, {last}))" if self.spark else f"unnest(range({first}, {last} + 1))"

    def last_known(self, x: str, over: str) -> str:
        return f"last_value({x}) ignore nulls over ({over})" if self.spark else f"last_value({x} ignore nulls) over ({over})"

    def days_since(self, date: str, ts: str) -> str:
        return f"datediff({ts}, date'{date}')" if self.spark else f"date_diff('day', date '{date}', {ts})::int"

    def best(self, x: str, *order: str) -> str:
        """``x`` of the first row in ``order`` (all ascending)."""
        return f"min_by({x}, struct({', '.join(order)}))" if self.spark else f"arg_min({x}, row({', '.join(order)}))"

    def integer(self, x: str) -> str:
        return f"cast({x} as int)"

    def at_most(self, a: str, b: str) -> str:
        """Whether ``a`` is ``b`` or less, for sums of doubles: they differ by some units in the last place as their rows come. In Spark, a
        difference within 1e-12 of the sum is none, however large sums grow; nine digits, as the oracle takes, hide it in small ones alone."""
        return f"{a} <= {b} + greatest(1e-9, 1e-12 * abs({b}))" if self.spark else f"round({a}, 9) <= round({b}, 9)"

    def refuse(self, broken: str, value: str, what: str, *key: str) -> str:
        """``value``; where ``broken`` holds, the query fails and names ``what`` and the key."""
        message = f"concat_ws(' ', '{what}'" + "".join(f", cast({k} as string)" for k in key) + ")"
        return f"case when {broken} then {'raise_error' if self.spark else 'error'}({message}) else {value} end"

    def unpivot(self, pairs: dict[str, str]) -> str:
        """Select item: rows (dimension, slice_value) of ``pairs`` name -> column."""
        if self.spark:
            return "stack({}, {}) as (dimension, slice_value)".format(len(pairs), ", ".join(f"'{k}', cast({v} as string)" for k, v in pairs.items()))
        names = ", ".join(f"'{k}'" for k in pairs)
        return f"unnest([{names}]) as dimension, unnest([{', '.join(f'{v}::varchar' for v in pairs.values())}]) as slice_value"


SPARK, DUCK = Dialect(True), Dialect(False)
