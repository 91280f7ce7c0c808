"""Runs that are published whole: tables below a run's own folder, a manifest, and one pointer.

A run writes its tables under a name of its own, then a manifest with size and digest of each file, taken
by tasks, and at last the pointer ``CURRENT`` is replaced in one step through Hadoop's file system. Whoever
reads by the pointer sees the old run or the new one; what a killed run has left is never pointed
at. The pointer can go back to any finished run. Where the store has no atomic rename (plain object
stores), use one that a committer or table format provides.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"
_BLOCK = 4 << 20


def _hadoop(spark: SparkSession, name: str):
    """(path, file system, hadoop package) of ``name``."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), fs


def _write_text(spark: SparkSession, name: str, text: str) -> None:
    """Replace ``name`` in one step: readers find the old text or the new."""
    sc = spark.sparkContext
    path, fs, package = _hadoop(spark, name)
    own = package.Path(f"{name}.{uuid.uuid4().hex}")
    out = fs.create(own, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    overwrite = getattr(package, "Options$Rename").OVERWRITE
    options = sc._gateway.new_array(getattr(package, "Options$Rename"), 1)
    options[0] = overwrite
    package.FileContext.getFileContext(path.toUri(), sc._jsc.hadoopConfiguration()).rename(own, path, options)


def _read_text(spark: SparkSession, name: str) -> str | None:
    path, fs, _ = _hadoop(spark, name)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256) of each file; tasks read them block by block."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyarrow import fs

        for batch in batches:
            rows = []
            for uri in batch.column("path").to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                out, size = hashlib.sha256(), 0
                with store.open_input_stream(path, compression=None) as stream:
                    while block := stream.read(_BLOCK):
                        out.update(block)
                        size += len(block)
                rows.append((uri, size, out.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["path", "bytes", "sha256"])

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(max(1, min(len(paths), 1000)), "path").mapInArrow(work, "path string, bytes bigint, sha256 string")


def publish_run(spark: SparkSession, root: str, tables: dict[str, DataFrame], document: dict | None = None, allowed: DataFrame | None = None) -> str:
    """Write ``tables`` as a run below ``root`` and point at it; its name. ``allowed`` (agrees boolean, ...),
    if given, must hold in every row, or nothing is pointed at. Tables are written in their own order."""
    run = uuid.uuid4().hex
    at = f"{root}/runs/{run}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{at}/tables/{name}")
    if allowed is not None:
        broken = allowed.where("not coalesce(agrees, false)").limit(5).collect()
        if broken:
            raise ValueError(f"the run is not published: {[r.asDict() for r in broken]}")
    paths = [f for name in tables for f in spark.read.parquet(f"{at}/tables/{name}").inputFiles()]
    file_digests(spark, paths).withColumn("path", F.expr(f"substring(path, instr(path, '/runs/{run}/'))")).coalesce(1).write.parquet(f"{at}/manifest")
    said = {"run": run, "previous": current(spark, root), "tables": list(tables), "document": document or {}}
    _write_text(spark, f"{at}/run.json", json.dumps(said, sort_keys=True, allow_nan=False))
    _write_text(spark, f"{root}/{POINTER}", run)
    return run


def current(spark: SparkSession, root: str) -> str | None:
    """The run that is pointed at."""
    return _read_text(spark, f"{root}/{POINTER}")


def describe(spark: SparkSession, root: str, run: str | None = None) -> dict:
    """What a finished run says of itself; a run that was not finished is refused."""
    run = run or current(spark, root)
    said = _read_text(spark, f"{root}/runs/{run}/run.json") if run else None
    if said is None:
        raise ValueError(f"no finished run: {run}")
    return json.loads(said)


def read_table(spark: SparkSession, root: str, name: str, run: str | None = None) -> DataFrame:
    """A table of a finished run, of the current one by default."""
    said = describe(spark, root, run)
    if name not in said["tables"]:
        raise ValueError(f"run {said['run']} has no table {name}")
    return spark.read.parquet(f"{root}/runs/{said['run']}/tables/{name}")


def verify(spark: SparkSession, root: str, run: str | None = None) -> DataFrame:
    """(path, expected, found) of files that are missing, new or changed since the run was published."""
    said = describe(spark, root, run)
    at = f"{root}/runs/{said['run']}"
    there = [f for name in said["tables"] for f in spark.read.parquet(f"{at}/tables/{name}").inputFiles()]
    own = file_digests(spark, there).select(F.expr(f"substring(path, instr(path, '/runs/{said['run']}/'))").alias("path"), F.col("sha256").alias("found"))
    kept = spark.read.parquet(f"{at}/manifest").select("path", F.col("sha256").alias("expected"))
    return kept.join(own, "path", "full_outer").where("not (expected <=> found)").select("path", "expected", "found")


def rollback(spark: SparkSession, root: str, run: str | None = None) -> str:
    """Point at ``run``, by default at the one before the current; its name."""
    run = run or describe(spark, root)["previous"]
    describe(spark, root, run)
    _write_text(spark, f"{root}/{POINTER}", run)
    return run


def publish_marts(spark: SparkSession, root: str, marts: dict[str, tuple[str, list[str]]], run: str | None = None) -> str:
    """Marts over the tables of a finished run, as a run of their own beside it: name -> (SELECT over the run's
    tables, order of the rows). The run's files must be those that were published."""
    said = describe(spark, root, run)
    changed = verify(spark, root, said["run"]).limit(3).collect()
    if changed:
        raise ValueError(f"run {said['run']} has changed: {[r.path for r in changed]}")
    frames = {t: read_table(spark, root, t, said["run"]) for t in said["tables"]}
    made = {}
    for name, (sql, order) in marts.items():
        made[name] = spark.sql(sql, **{t: f for t, f in frames.items() if "{" + t + "}" in sql}).orderBy(*order)
    counts = {name: df.count() for name, df in made.items()}
    return publish_run(spark, f"{root}/marts", made, {"of_run": said["run"], "rows": counts})
