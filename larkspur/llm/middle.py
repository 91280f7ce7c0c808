"""Fill-in-middle transformation: texts cut at code point boundaries and put in another order.

Each text becomes an array of UTF-32 code points. Neighbouring points of different classes have a
boundary between them, ``flatnonzero`` finds all of them at once, and two of the boundaries, drawn
by a hash of the document's id, cut the text into prefix, middle and suffix. The pieces are
encoded again behind their marks, as prefix, suffix, middle (psm) or suffix, prefix, middle (spm).

Defined results: a null text is empty; an empty text, or one that contains a mark, stays as it is
(plain); bytes that are no UTF-8 survive; a null id is hashed as no digits; rows are worked on
one by one, so repeated rows give repeated results; an empty table gives an empty result; other
columns are not read. Texts are never cut short; a task holds one of them at a time as points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of output gathered in one Arrow batch.
BATCH_BYTES = 8 << 20
_SPACES = (9, 10, 11, 12, 13, 32)


def boundaries(points, unit: str = "line"):
    """Ends of all units in an array of code points, ascending; the last one is its length.

    ``line``: up to and with a line feed; ``word``: a run of other characters with the white
    space behind it; ``char``: each point.
    """
    import numpy as np

    if not len(points):
        return np.zeros(0, dtype=np.int64)
    if unit == "line":
        last = points[:-1] == 10
    elif unit == "word":
        space = np.isin(points, _SPACES)
        last = space[:-1] & ~space[1:]
    elif unit == "char":
        last = np.ones(len(points) - 1, dtype=bool)
    else:
        raise ValueError(f"no such unit: {unit}")
    return np.append(np.flatnonzero(last) + 1, len(points))


def draws(doc_id: object, salt: str) -> list[int]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``salt:doc_id``."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def rearranged(text: bytes, doc_id: object, unit: str, rate: int, spm: int, salt: str) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, points of the prefix, points of the middle, output) of one text."""
    import numpy as np

    points = np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = boundaries(points, unit)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, salt)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not n or h3 % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, second))
    prefix, middle, suffix = (x.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape") for x in (points[:a], points[a:b], points[b:]))
    p, s, m = marks
    if h4 % 100 < spm:
        return n, "spm", a, b - a, s + suffix + p + prefix + m + middle
    return n, "psm", a, b - a, p + prefix + s + suffix + m + middle


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, salt: str = "7") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of ``docs`` (doc_id, text).

    ``rate`` of 100 texts are rearranged, ``spm`` of 100 of these with the suffix in front.
    """
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            begin, size, rows = 0, 0, []
            for k in range(batch.num_rows):
                rows.append(rearranged(texts[k].as_py() or b"", ids[k].as_py(), unit, rate, spm, salt))
                size += len(rows[-1][-1])
                if size >= BATCH_BYTES or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([ids.slice(begin, len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)
                    begin, size, rows = k + 1, 0, []

    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    out = source.mapInArrow(work, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: str = "output", form: str = "form") -> F.Column:
    """The text behind an ``output``, from its marks: pieces hold none, so the first of each kind counts."""

    def split(rest: str, mark: str) -> tuple[str, str]:
        head = f"substring_index({rest}, '{mark}', 1)"
        return head, f"substr({rest}, length({head}) + {len(mark) + 1})"

    def pieces(first: str, second: str) -> tuple[str, str, str]:
        x, rest = split(f"substr({output}, {len(first) + 1})", second)
        y, z = split(rest, MIDDLE)
        return x, y, z

    prefix, suffix, middle = pieces(PREFIX, SUFFIX)
    psm = f"concat({prefix}, {middle}, {suffix})"
    suffix, prefix, middle = pieces(SUFFIX, PREFIX)
    spm = f"concat({prefix}, {middle}, {suffix})"
    return F.expr(f"case {form} when 'psm' then {psm} when 'spm' then {spm} else {output} end")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP13_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as ls, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select doc_id, t, ls, len(ls)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[25:32])::bigint as h4,
             t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') as plain from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from u),
p as (select doc_id, t, n, case when plain then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form,
             array_to_string(ls[1:a], '') as prefix, array_to_string(ls[a + 1:b], '') as middle, array_to_string(ls[b + 1:n], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""
