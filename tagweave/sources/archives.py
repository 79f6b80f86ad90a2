"""Archives as a partitioned data source: members of zip, tar and compressed tar files as lines.

    spark.dataSource.register(ArchiveLines)
    spark.read.format("archive_lines").option("members", "a*.tsv").load("/data/ngrams-*.zip")

Only directories of archives are read while planning. Members are dealt to
partitions by their stored bytes, a task seeks to its members and reads them as
streams, so neither an archive nor a member is ever one value. A compressed tar
file can only be read from its beginning and is one partition, as a stream.
The option ``members``, a pattern of names, decides which members, and so which
tasks, there are. It is an option and not a pushed filter, since Spark 4.1 keeps
a reader with the filters of its first use for all uses of a DataFrame.
"""

from __future__ import annotations

import fnmatch
import glob
import io
import os
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Stored bytes of the members of a partition, lines of a batch, and bytes read at a time.
PART_BYTES, BATCH_LINES, READ_BYTES = 64 << 20, 20_000, 1 << 20
_LOCAL_HEADER = struct.Struct("<4s5H3I2H")


def _local(path: str) -> str | None:
    """The path for ``open``, or None if another store holds the file."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def open_binary(path: str):
    """A seekable file of the local or shared file system, or of any store that Arrow knows by its URI."""
    at = _local(path)
    if at is not None:
        return open(at, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def expand(path: str) -> list[str]:
    """Files that a path, folder or pattern names, sorted; hidden and temporary ones are left out."""
    shown = lambda f: not os.path.basename(f).startswith(("_", "."))
    at = _local(path)
    if at is not None:
        found = [f for p in (sorted(glob.glob(at)) or []) for f in ([os.path.join(p, x) for x in sorted(os.listdir(p))] if os.path.isdir(p) else [p])]
        found = [f for f in found if os.path.isfile(f) and shown(f)]
    else:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        scheme = path.split("://")[0]
        folder = inner if store.get_file_info(inner).type == fs.FileType.Directory else os.path.dirname(inner)
        every = store.get_file_info(fs.FileSelector(folder))
        found = [f"{scheme}://{f.path}" for f in sorted(every, key=lambda f: f.path) if f.is_file and shown(f.path) and (folder == inner or fnmatch.fnmatch(f.path, inner))]
    if not found:
        raise FileNotFoundError(path)
    return found


@dataclass
class Members(InputPartition):
    """Members (name, offset, stored bytes, method) of one archive; None: all of a compressed tar file that match."""

    path: str
    kind: str
    members: list | None

    def __init__(self, path: str, kind: str, members: list | None):
        self.path, self.kind, self.members = path, kind, members


def directory(path: str) -> tuple[str, list | None]:
    """(kind, members) of an archive; a zip file names its members at its end, a tar file before each."""
    with open_binary(path) as f:
        head = f.read(4)
        f.seek(0)
        if head[:2] == b"PK":
            with zipfile.ZipFile(f) as z:
                return "zip", [(m.filename, m.header_offset, m.compress_size, m.compress_type + (1000 if m.flag_bits & 1 else 0)) for m in z.infolist() if not m.is_dir()]
        if head[:2] == b"\x1f\x8b" or head[:3] == b"BZh" or head == b"\xfd7zX":
            return "stream", None
        with tarfile.open(fileobj=f, mode="r:") as t:
            return "tar", [(m.name, m.offset_data, m.size, 0) for m in t if m.isfile()]


class Inflated(io.RawIOBase):
    """A stored or deflated range of a file as a stream."""

    def __init__(self, f, size: int, deflated: bool):
        self.f, self.left, self.ready = f, size, b""
        self.inflate = zlib.decompressobj(-15) if deflated else None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.ready:
            if self.inflate is not None and self.inflate.unconsumed_tail:
                self.ready = self.inflate.decompress(self.inflate.unconsumed_tail, READ_BYTES)
                continue
            raw = self.f.read(min(self.left, READ_BYTES))
            self.left -= len(raw)
            if not raw:
                self.ready = self.inflate.flush() if self.inflate is not None else b""
                self.inflate = None
                break
            self.ready = self.inflate.decompress(raw, READ_BYTES) if self.inflate is not None else raw
        n = min(len(into), len(self.ready))
        into[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def member_stream(f, kind: str, offset: int, size: int, method: int):
    f.seek(offset)
    if kind == "zip":
        if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError("members must be stored or deflated, and not encrypted")
        header = _LOCAL_HEADER.unpack(f.read(_LOCAL_HEADER.size))
        f.seek(offset + _LOCAL_HEADER.size + header[9] + header[10])  # the name and extra fields come first
    return io.BufferedReader(Inflated(f, size, method == zipfile.ZIP_DEFLATED), READ_BYTES)


def _batches(archive: str, name: str, lines) -> Iterator[pa.RecordBatch]:
    part: list[str] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([archive] * len(part)), pa.array([name] * len(part)), pa.array(part, pa.string())], ["archive", "member", "value"])

    for line in lines:
        part.append(line.decode("utf-8", "replace").rstrip("\r\n"))
        if len(part) == BATCH_LINES:
            yield batch()
            part = []
    if part:
        yield batch()


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int = PART_BYTES, members: str = "*"):
        self.path, self.part_bytes, self.pattern = path, part_bytes, members

    def _wanted(self, name: str) -> bool:
        return fnmatch.fnmatchcase(name, self.pattern)

    def partitions(self) -> list[Members]:
        out = []
        for path in expand(self.path):
            kind, members = directory(path)
            if members is None:
                out.append(Members(path, kind, None))
                continue
            own, size = [], 0
            for m in members:
                if not self._wanted(m[0]):
                    continue
                if own and size + m[2] > self.part_bytes:
                    out.append(Members(path, kind, own))
                    own, size = [], 0
                own.append(m)
                size += m[2]
            if own:
                out.append(Members(path, kind, own))
        return out or [Members("", "none", [])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if partition.kind == "none":
            return
        with open_binary(partition.path) as f:
            if partition.members is None:
                with tarfile.open(fileobj=f, mode="r|*") as t:
                    for m in t:
                        if m.isfile() and self._wanted(m.name):
                            yield from _batches(partition.path, m.name, t.extractfile(m))
                return
            for name, offset, size, method in partition.members:
                yield from _batches(partition.path, name, member_stream(f, partition.kind, offset, size, method))


class ArchiveLines(DataSource):
    """(archive, member, value): lines of the members of zip, tar and compressed tar files."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return "archive string, member string, value string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("partbytes", PART_BYTES)), self.options.get("members", "*"))


def archive_lines(spark, path: str, members: str = "*", part_bytes: int = PART_BYTES):
    """(archive, member, value) of the archives that a path, folder or pattern names, of the members whose names match ``members``."""
    spark.dataSource.register(ArchiveLines)
    return spark.read.format("archive_lines").option("partbytes", str(part_bytes)).option("members", members).load(path)
