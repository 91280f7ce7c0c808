"""Sinks that publish whole results or none."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame


def write_text(path: str | Path, text: str) -> None:
    """Replace ``path`` in one step."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    own = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    own.write_text(text, encoding="utf-8")
    os.replace(own, path)


def write_json(path: str | Path, document: dict) -> None:
    write_text(path, json.dumps(document, sort_keys=True, indent=2, allow_nan=False) + "\n")


def publish(staged: str | Path, target: str | Path) -> None:
    """Put the folder ``staged`` in the place of ``target``; what stood there returns if that fails."""
    staged, target = Path(staged), Path(target)
    if not staged.is_dir():
        raise FileNotFoundError(staged)
    backup = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    if target.exists():
        target.rename(backup)
    try:
        staged.rename(target)
    except OSError:
        if backup.exists():
            backup.rename(target)
        raise
    shutil.rmtree(backup, ignore_errors=True)


def write_table(df: DataFrame, target: str | Path, form: str = "parquet") -> None:
    """Write ``df`` beside ``target`` and publish it."""
    staged = Path(target).with_name(f".{Path(target).name}.{uuid.uuid4().hex}")
    try:
        df.write.mode("errorifexists").format(form).option("header", True).save(f"file://{staged.absolute()}")
        publish(staged, target)
    finally:
        shutil.rmtree(staged, ignore_errors=True)


def sha256_of(folder: str | Path) -> str:
    """One digest of the data files in ``folder``, by name."""
    out = hashlib.sha256()
    for p in sorted(Path(folder).rglob("part-*")):
        out.update(p.read_bytes())
    return out.hexdigest()
