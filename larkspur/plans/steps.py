"""Plan steps: named SQL over named relations, run by Catalyst or composed for an oracle."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from larkspur.functions.dialect import DUCK, SPARK, Dialect

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@dataclass(frozen=True)
class Step:
    """``sql`` gives one SELECT for a dialect; ``{name}`` in it stands for a relation of ``inputs``.
    Where Spark takes another way than the plain statement, ``build`` makes its frame from the inputs,
    and the SELECT is the oracle's alone; without one, nothing that follows has an oracle."""

    inputs: tuple[str, ...]
    sql: Callable[[Dialect], str] | None
    build: Callable[..., DataFrame] | None = None

    def run(self, **frames: DataFrame) -> DataFrame:
        """The lazy result over ``frames``, one for each input."""
        if self.build:
            return self.build(**{k: frames[k] for k in self.inputs})
        spark = next(iter(frames.values())).sparkSession if frames else SparkSession.active()
        return spark.sql(self.sql(SPARK), **{k: frames[k] for k in self.inputs})

    def recipe(self) -> str:
        """What the rows follow from: the SELECT, and the code and parameters of ``build``."""
        said = self.sql(SPARK) if self.sql else ""
        if self.build:
            cells = [c.cell_contents for c in self.build.__closure__ or ()]
            code = self.build.__code__
            said += f"{self.build.__module__}.{self.build.__qualname__}|{code.co_code.hex()}|{[c for c in code.co_consts if isinstance(c, (str, int, float))]}|{[c for c in cells if not callable(c)]}"
        return said

    def text(self, **names: str) -> str:
        return self.sql(DUCK).format(**{k: names.get(k, k) for k in self.inputs})


@dataclass(frozen=True)
class Node:
    """A step with the graph's nodes that feed its inputs. ``keep``: several nodes need it, so
    that it is computed once and its lineage cut."""

    step: Step
    feeds: dict[str, str]
    keep: bool = False


#: What this session has found or made: key -> frame.
_KEPT: dict[tuple[str, str], DataFrame] = {}


def resolve(graph: dict[str, Node], name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The DataFrame of a node. Nodes marked ``keep`` are Parquet under a digest of their step, of
    the steps they need and of the input files: what is there and finished is read, so a changed
    input or step makes anew what depends on it, and nothing else."""
    return _resolve(graph, name, spark, sf_dir, {})


def _resolve(graph: dict[str, Node], name: str, spark: SparkSession, sf_dir: str, keys: dict[str, str]) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    node = graph[name]
    held = (spark.sparkContext.applicationId, key_of(graph, name, spark, sf_dir, keys)) if node.keep else None
    if held in _KEPT:
        return _KEPT[held]
    path = f"{shared_folder(spark)}/nodes/{held[1]}" if held else ""
    if held and exists(spark, f"{path}/_SUCCESS"):
        _KEPT[held] = spark.read.parquet(path)
        return _KEPT[held]
    out = node.step.run(**{k: _resolve(graph, v, spark, sf_dir, keys) for k, v in node.feeds.items()})
    if held:
        out.write.mode("overwrite").parquet(path)
        out = _KEPT[held] = spark.read.schema(out.schema).parquet(path)
    return out


def key_of(graph: dict[str, Node], name: str, spark: SparkSession, sf_dir: str, keys: dict[str, str] | None = None) -> str:
    """A digest of what a node's rows follow from: the library's code, steps, and path, size and time of
    each input file."""
    keys = {} if keys is None else keys
    if name not in keys:
        if name in TABLES:
            said = "|".join(_files(spark, f"{sf_dir}/{name}.parquet"))
        else:
            said = _code() + graph[name].step.recipe() + "".join(f"|{k}={key_of(graph, v, spark, sf_dir, keys)}" for k, v in sorted(graph[name].feeds.items()))
        keys[name] = hashlib.sha256(said.encode()).hexdigest()[:40]
    return keys[name]


@cache
def _code() -> str:
    """A digest of the modules that steps can call: what an older version has kept is not read."""
    out, top = hashlib.sha256(), Path(__file__).parents[1]
    for part in ("functions", "operators", "plans", "streaming"):
        for file in sorted((top / part).glob("*.py")):
            out.update(file.read_bytes())
    return out.hexdigest()


def drop(graph: dict[str, Node], name: str, spark: SparkSession, sf_dir: str) -> None:
    """Remove what is kept of a node."""
    key = key_of(graph, name, spark, sf_dir)
    _KEPT.pop((spark.sparkContext.applicationId, key), None)
    path = _path(spark, f"{shared_folder(spark)}/nodes/{key}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def exists(spark: SparkSession, name: str) -> bool:
    path = _path(spark, name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _files(spark: SparkSession, name: str) -> list[str]:
    """Path, size and time of the files of a table, through Hadoop's file system."""
    path = _path(spark, name)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [fs.getFileStatus(path)]
    if found[0].isDirectory():
        found = [f for f in fs.listStatus(path) if f.isFile()]
    return sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in found)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one where none is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not _OWN:
            folder = tempfile.TemporaryDirectory(prefix="larkspur-", ignore_cleanup_errors=True)
            atexit.register(folder.cleanup)
            _OWN.append(f"file://{folder.name}")
        named = _OWN[0]
    return named.rstrip("/")


_OWN: list[str] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: no lineage, and columns that nobody wants are not read."""
    path = f"{shared_folder(df.sparkSession)}/steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def expressible(graph: dict[str, Node], name: str) -> bool:
    """Whether SQL can state the node and all that it needs."""
    return name in TABLES or graph[name].step.sql is not None and all(expressible(graph, v) for v in graph[name].feeds.values())


def oracle(graph: dict[str, Node], name: str, final: str) -> str:
    """DuckDB SQL of ``final`` over node ``name``, with all it needs as common table expressions."""
    done: dict[str, str] = {}

    def add(n: str) -> None:
        if n in TABLES or n in done:
            return
        node = graph[n]
        for v in node.feeds.values():
            add(v)
        done[n] = node.step.text(**{k: v if v in TABLES else f"n_{v}" for k, v in node.feeds.items()})

    add(name)
    return "with recursive " + ",\n".join(f"n_{n} as materialized ({text})" for n, text in done.items()) + f"\n{final}"
