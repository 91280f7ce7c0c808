"""CSV members of ZIP archives as a Spark data source: ranges of a member are partitions.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("csv_archive").schema("id string, d_1 double").option("member", "sales.csv").load("file:///data/a.zip")

The schema names the columns that are parsed; without one all columns of the header come, as strings.
A partition is a range of the member's inflated bytes; it takes the lines that begin in it. A stored member
is entered at its range; a deflated one is inflated up to it, which costs less than parsing. Fields hold no
line breaks. Nothing is unpacked to disk. An archive with members of one name, or with names that are absolute or climb
out of their folder, is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SPLIT_BYTES = 64 << 20
_BLOCK = 1 << 20


def _open(uri: str):
    """A seekable stream of the archive, from any store that pyarrow reaches."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return store.open_input_file(path)


def member_of(archive, wanted: str):
    """The one member of that name; the whole archive is judged first."""
    seen: dict[str, object] = {}
    for info in archive.infolist():
        name = info.filename.replace("\\", "/")
        if name.startswith("/") or (len(name) > 1 and name[1] == ":") or ".." in name.split("/"):
            raise ValueError(f"the archive has a name that leaves its folder: {info.filename}")
        if info.is_dir():
            continue
        base = name.rsplit("/", 1)[-1]
        if base in seen:
            raise ValueError(f"the archive has several members named {base}")
        seen[base] = info
    if wanted not in seen:
        raise FileNotFoundError(f"the archive has no {wanted}")
    return seen[wanted]


@dataclass
class Range(InputPartition):
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.member, self.split = options["path"], options["member"], int(options.get("splitBytes", SPLIT_BYTES))
        self.columns = [f.name for f in schema.fields]
        self.schema = schema

    def partitions(self) -> list[Range]:
        import zipfile

        with _open(self.path) as stream, zipfile.ZipFile(stream) as archive:
            size = member_of(archive, self.member).file_size
        return [Range(k, min(k + self.split, size)) for k in range(0, max(size, 1), self.split)]

    def read(self, partition: Range) -> Iterator:
        import io
        import zipfile

        import pyarrow as pa
        from pyarrow import csv
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.schema)
        with _open(self.path) as stream, zipfile.ZipFile(stream) as archive, archive.open(member_of(archive, self.member)) as member:
            header = member.readline()
            names = next(__import__("csv").reader([header.decode("utf-8-sig").rstrip("\r\n")]))
            missing = [c for c in self.columns if c not in names]
            if missing:
                raise ValueError(f"{self.member} has no columns {missing}")
            # The header is no line of the data; a line belongs to the range in which it begins.
            at = max(partition.start, len(header))
            if partition.start >= len(header):
                member.seek(partition.start - 1)
                at = partition.start - 1 + len(member.readline())
            options = {"convert_options": csv.ConvertOptions(include_columns=self.columns, column_types={f.name: f.type for f in wanted}, strings_can_be_null=True), "read_options": csv.ReadOptions(column_names=names)}
            while at < partition.end:
                lines = member.read(min(_BLOCK * 8, partition.end - at))
                if not lines.endswith(b"\n"):  # to the end of the line that the block has begun
                    lines += member.readline()
                if not lines:
                    break
                at += len(lines)
                if not lines.strip():
                    continue
                for batch in csv.read_csv(io.BytesIO(lines), **options).cast(wanted).to_batches():
                    yield pa.RecordBatch.from_arrays(batch.columns, schema=wanted)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csv_archive"

    def schema(self) -> str:
        import csv
        import zipfile

        with _open(self.options["path"]) as stream, zipfile.ZipFile(stream) as archive, archive.open(member_of(archive, self.options["member"])) as member:
            names = next(csv.reader([member.readline().decode("utf-8-sig").rstrip("\r\n")]))
        return ", ".join(f"`{n}` string" for n in names)

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options, schema)
