"""Members of a ZIP archive as rows.

``spark.dataSource.register(ArchiveSource)``, then
``spark.read.format("archive_members").option("path", p).load()``. The archive
must lie where all executors can open it, such as a shared file system. Members
are dealt to tasks by size, and each task reads only its own.

Options: ``prefix`` (comma-separated starts of member names), ``suffixes``
(``.phh,.phhs``), ``segment`` (a folder that must be on the way to a member),
``limit`` (members, in the order of the directory), ``header_bytes`` (read no
more of each member), ``max_member_bytes`` (a larger member is an error row),
``partition_bytes``.  The directory is read once, on the driver; a task gets
the places of its members.

With the option ``push_filters`` (and ``spark.sql.python.filterPushdown.enabled``,
without which Spark refuses such a source) comparisons of names, sizes and
places with literals go to the directory, so members that a query doesn't want
aren't opened.  ``archive_directory`` has the directory alone and opens none.
As a stream, the offset is the number of entries read: a query that goes on
from its checkpoint reads what has been appended since and nothing twice.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

DIRECTORY = "member string, position bigint, compressed_size bigint, uncompressed_size bigint, crc32 string"
SCHEMA = f"{DIRECTORY}, content string, bytes_read bigint, error string"
#: What a filter that can be pushed asks of a value of the directory, which is never null.
TESTS = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
    StringContains: lambda x, v: v in x,
}


@dataclass
class Member:
    """An entry of the directory: what it takes to read a member without the directory."""

    position: int
    name: str
    offset: int
    method: int
    encrypted: bool
    compressed: int
    size: int
    crc: int


@dataclass
class Members(InputPartition):
    members: list[Member]


#: The fixed part of the header before a member's data, and where in it the lengths of name and extra field stand.
HEADER, LENGTHS = 30, 26


def read_member(file, m: Member, most: int) -> bytes:
    """The first ``most`` bytes of a member; checked by its CRC if that is all of it."""
    file.seek(m.offset)
    head = file.read(HEADER)
    if len(head) < HEADER or head[:4] != b"PK\x03\x04":
        raise ValueError("no header where the directory points to")
    name, extra = struct.unpack_from("<HH", head, LENGTHS)
    file.seek(m.offset + HEADER + name + extra)
    if m.encrypted or m.method not in (0, 8):
        raise ValueError("encrypted, or packed in another way than by deflation")
    if m.method == 0:
        raw = file.read(min(m.compressed, most))
    else:
        unpack, raw, left = zlib.decompressobj(-15), b"", m.compressed
        while left and len(raw) < most:
            block = file.read(min(left, 1 << 16))
            if not block:
                raise ValueError("the archive ends inside a member")
            left -= len(block)
            raw += unpack.decompress(block, most - len(raw))
    if len(raw) == m.size and zlib.crc32(raw) != m.crc:
        raise ValueError("the checksum differs")
    return raw


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.prefixes = tuple(x for x in options.get("prefix", "").split(",") if x)
        self.suffixes = tuple(options.get("suffixes", ".phh,.phhs").lower().split(","))
        self.segment = options.get("segment", "").lower().strip("/")
        self.limit = int(options.get("limit", 0))
        self.header = int(options.get("header_bytes", 0))
        self.most = int(options.get("max_member_bytes", 64 << 20))
        self.share = int(options.get("partition_bytes", 32 << 20))
        self.pushed: list[tuple[type, str, object]] = []

    def asked(self, m: Member) -> bool:
        value = {"member": m.name, "position": m.position, "compressed_size": m.compressed, "uncompressed_size": m.size}
        return all(TESTS[kind](value[column], v) for kind, column, v in self.pushed)

    def wanted(self, name: str) -> bool:
        low = name.lower()
        return low.endswith(self.suffixes) and (not self.prefixes or name.startswith(self.prefixes)) and (not self.segment or f"/{self.segment}/" in f"/{low.lstrip('/')}")

    def partitions(self, first: int = 0, end: int | None = None) -> list[Members]:
        """The members from one place of the directory to another, by size."""
        import zipfile

        parts, room, n = [], 0, 0
        with zipfile.ZipFile(self.path) as archive:
            for position, info in enumerate(archive.infolist()[:end]):
                m = Member(position, info.filename, info.header_offset, info.compress_type, bool(info.flag_bits & 1), info.compress_size, info.file_size, info.CRC)
                if position < first or info.is_dir() or not self.wanted(info.filename) or not self.asked(m):
                    continue
                n += 1
                if self.limit and n > self.limit:
                    break
                cost = 4096 + (min(info.file_size, self.header) if self.header else info.file_size)
                if not parts or cost > room:
                    parts.append(Members([]))
                    room = self.share
                parts[-1].members.append(m)
                room -= cost
        return parts or [Members([])]

    def read(self, partition: Members) -> Iterator[tuple]:
        if not partition.members:
            return
        with open(self.path, "rb") as file:
            for m in partition.members:
                text, size, error = None, 0, None
                try:
                    if m.size == 0:
                        error = "empty_member"
                    elif not self.header and m.size > self.most:
                        error = "member_too_large"
                    else:
                        raw = read_member(file, m, self.header or self.most + 1)
                        size = len(raw)
                        if not self.header and size > self.most:
                            error = "member_too_large"
                        else:
                            text = raw.decode("utf-8", "replace" if self.header else "strict").removeprefix("\ufeff")
                except (OSError, ValueError, zlib.error) as e:
                    error = f"read_error:{type(e).__name__}"
                yield m.name, m.position, m.compressed, m.size, f"{m.crc:08x}", text, size, error


class Pushing:
    """What a reader of the directory takes of a query's filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            ordered = not isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or column != "member"  # names aren't ordered alike
            if self.limit or column not in ("member", "position", "compressed_size", "uncompressed_size"):
                yield f  # a limit counts members before they are filtered
            elif type(f) in TESTS and ordered and f.value is not None:
                self.pushed.append((type(f), column, f.value))
            elif not isinstance(f, IsNotNull):
                yield f


class DirectoryReader(ArchiveReader):
    def read(self, partition: Members) -> Iterator[tuple]:
        for m in partition.members:
            yield m.name, m.position, m.compressed, m.size, f"{m.crc:08x}"


class PushedReader(Pushing, ArchiveReader):
    pass


class PushedDirectoryReader(Pushing, DirectoryReader):
    pass


class ArchiveStream(DataSourceStreamReader):
    """New members of an archive that grows at its end, as a rewritten directory keeps the order of earlier entries."""

    def __init__(self, options: dict[str, str]):
        self.reader = ArchiveReader(options)

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        import zipfile

        with zipfile.ZipFile(self.reader.path) as archive:
            return {"entries": len(archive.infolist())}

    def partitions(self, start: dict, end: dict) -> list[Members]:
        return self.reader.partitions(start["entries"], end["entries"])

    def read(self, partition: Members) -> Iterator[tuple]:
        return self.reader.read(partition)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return PushedReader(self.options) if self.options.get("push_filters", "false").lower() == "true" else ArchiveReader(self.options)

    def streamReader(self, schema) -> ArchiveStream:
        return ArchiveStream(self.options)


class ArchiveDirectory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_directory"

    def schema(self) -> str:
        return DIRECTORY

    def reader(self, schema) -> DirectoryReader:
        return PushedDirectoryReader(self.options) if self.options.get("push_filters", "false").lower() == "true" else DirectoryReader(self.options)
