"""Media in archives: bytes as grey pictures in ZIP files, written and read by a data source of our own.

A picture is an 8-bit greyscale PNG, WIDTH samples wide. Archives hold them as stored members; their
central directories say where. A read is planned over ranges of the archives' bytes: the driver lists archives
and sizes only, each task looks up which members begin in its range, reads them in large pieces, and reads a member that
comes damaged again by its own offset.
"""

from __future__ import annotations

import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from docveil.shared import new_path

WIDTH = 64
_MAGIC = b"\x89PNG\r\n\x1a\n"
#: The file that lists what archives a folder has; those without a line in it belong to no finished write.
LISTED = "_archives"
#: Bytes of an archive, of a range that one task reads, of one read, and of media in a batch.
ARCHIVE_BYTES, SPLIT_BYTES, READ_BYTES, BATCH_BYTES = 128 << 20, 32 << 20, 4 << 20, 8 << 20
RETRIES = 3


# --- pictures ----------------------------------------------------------


def padded(data: bytes) -> bytes:
    """data with zeros up to a positive multiple of WIDTH bytes."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_picture(data: bytes) -> bytes:
    """A PNG whose samples are the padded data; a text chunk keeps the number of bytes before padding."""
    samples = padded(data)
    rows = len(samples) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0" + str(len(data)).encode()) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_picture(media: bytes) -> tuple[int, bytes]:
    """The number of bytes before padding, and the samples. Raises ValueError for other pictures and damaged ones."""
    if not media.startswith(_MAGIC):
        raise ValueError("not a PNG")
    at, found, packed = len(_MAGIC), {}, []
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IDAT":
            packed.append(body)
        found[kind] = body
        at += 12 + n
    width, rows, *form = struct.unpack(">IIBBBBB", found[b"IHDR"])
    if form != [8, 0, 0, 0, 0]:
        raise ValueError("not an 8-bit greyscale picture")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(rows, width + 1)
    if lines[:, 0].any():
        raise ValueError("lines are filtered")
    samples = lines[:, 1:].tobytes()
    note = found.get(b"tEXt", b"").partition(b"\0")
    return int(note[2]) if note[0] == b"bytes" else len(samples), samples


def features(samples: bytes) -> str:
    """Mean and spread of the samples in hundredths, how many neighbours along a line differ by over 32, and a hash of 64 bits: which of 65 parts is darker than the next."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    edges = int((np.abs(np.diff(x.reshape(-1, WIDTH), axis=1)) > 32).sum())
    cuts = np.arange(66) * n // 65
    sums = np.concatenate(([0], np.cumsum(x)))
    part, size = sums[cuts[1:]] - sums[cuts[:-1]], np.maximum(np.diff(cuts), 1)
    dark = part[:-1] * size[1:] < part[1:] * size[:-1]
    return f"{total * 100 // n}:{(squares * n - total * total) * 100 // (n * n)}:{edges}:{int(''.join('01'[b] for b in dark.tolist()), 2):016x}"


# --- archives ----------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: names and sizes of archives, and the members in all."""

    archives: list[tuple[str, int]]
    members: int


@dataclass
class ByteRange(InputPartition):
    archive: str
    low: int
    high: int


class _Out:
    """Where a ZIP file is written to: only forwards, as stores take it."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def write(self, data) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass

    def seekable(self) -> bool:
        return False


class ArchiveWriter(DataSourceArrowWriter):
    """Writes (member, media) into a folder of this write. Names of archives are new in each attempt of a task; commit() lists those of the attempts that count, abort() deletes the folder."""

    def __init__(self, options: dict):
        self.store, self.path = fs.FileSystem.from_uri(options["path"])
        self.own = uuid.uuid4().hex
        self.most = int(options.get("archivebytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        self.store.create_dir(f"{self.path}/{self.own}", recursive=True)
        done, count, out, held = [], 0, None, None
        try:
            for batch in iterator:
                for member, media in zip(batch.column("member"), batch.column("media"), strict=True):
                    if held is None:
                        name = f"{self.own}/{uuid.uuid4().hex}.zip"
                        out = _Out(self.store.open_output_stream(f"{self.path}/{name}"))
                        held = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    held.writestr(zipfile.ZipInfo(member.as_py()), media.as_py())
                    count += 1
                    if out.tell() >= self.most:
                        held = self._closed(held, out, name, done)
            if held is not None:
                held = self._closed(held, out, name, done)
        except BaseException:
            if out is not None:
                out.stream.close()
            for name in [x for x, _ in done] + ([name] if held is not None else []):
                with suppress(OSError):
                    self.store.delete_file(f"{self.path}/{name}")
            raise
        return Written(done, count)

    @staticmethod
    def _closed(held: zipfile.ZipFile, out: _Out, name: str, done: list[tuple[str, int]]) -> None:
        held.close()
        out.stream.close()
        done.append((name, out.tell()))

    def commit(self, messages: list[Written | None]) -> None:
        listed = self.path + "/" + LISTED
        before = self.store.open_input_file(listed).read() if self.store.get_file_info(listed).is_file else b""
        lines = [f"{name}\t{n}\n" for m in messages if m is not None for name, n in m.archives]
        self.store.create_dir(self.path, recursive=True)
        with self.store.open_output_stream(listed) as out:
            out.write(before + "".join(lines).encode())

    def abort(self, messages: list[Written | None]) -> None:
        with suppress(OSError):
            self.store.delete_dir(f"{self.path}/{self.own}")


class Members:
    """The members of an archive that begin within a range of its bytes, read forwards in large pieces.

    open gives a file to seek and read in; it is called again for each retry.
    """

    def __init__(self, open: Callable[[], object], low: int, high: int, retries: int = RETRIES, wait: float = 0.1):
        self.open, self.low, self.high, self.retries, self.wait = open, low, high, retries, wait
        self.file, self.at, self.piece = None, 0, b""

    def _bytes(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.piece):
            self.file.seek(at)
            self.at, self.piece = at, self.file.read(max(n, READ_BYTES))
        return bytes(self.piece[at - self.at : at - self.at + n])

    def _again(self, read: Callable[[], object]):
        """What read gives, after opening the file anew as often as is allowed."""
        for k in range(self.retries + 1):
            try:
                if self.file is None:
                    self.file, self.piece = self.open(), b""
                return read()
            except (OSError, ValueError, zipfile.BadZipFile, struct.error):
                self.close()
                if k == self.retries:
                    raise
                time.sleep(self.wait * 2**k)

    def close(self) -> None:
        if self.file is not None:
            with suppress(OSError):
                self.file.close()
        self.file, self.piece = None, b""

    def _member(self, found: zipfile.ZipInfo) -> bytes:
        head = self._bytes(found.header_offset, 30)
        mark, name, extra = struct.unpack("<4s22xHH", head)
        if mark != b"PK\x03\x04":
            raise zipfile.BadZipFile("no member here")
        data = self._bytes(found.header_offset + 30 + name + extra, found.compress_size)
        if len(data) != found.compress_size or zlib.crc32(data) != found.CRC:
            raise zipfile.BadZipFile("damaged member")
        return data

    def __iter__(self) -> Iterator[tuple[str, int, bytes | None, str | None]]:
        """(member, offset, media, error): of media and error one is null."""
        directory = self._again(lambda: zipfile.ZipFile(self.file).infolist())
        for found in sorted((x for x in directory if self.low <= x.header_offset < self.high), key=lambda x: x.header_offset):
            try:
                media, error = self._again(lambda: self._member(found)), None  # noqa: B023
            except (OSError, ValueError, zipfile.BadZipFile, struct.error) as e:
                media, error = None, f"{type(e).__name__}: {e}"
            yield found.filename, found.header_offset, media, error
        self.close()


_COLUMNS = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("member", pa.string()), ("media", pa.binary()), ("error", pa.string())])


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.retries, self.skip = int(options.get("retries", RETRIES)), options.get("onerror", "fail") == "row"

    def partitions(self) -> list[ByteRange]:
        store, path = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(f"{path}/{LISTED}") as f:
            listed = [line.split("\t") for line in f.read().decode().splitlines()]
        return [ByteRange(name, low, min(low + self.split, int(n))) for name, n in listed for low in range(0, int(n), self.split)]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no archive
            return
        store, path = fs.FileSystem.from_uri(self.path)
        held, size = [], 0
        for member, offset, media, error in Members(lambda: store.open_input_file(f"{path}/{partition.archive}"), partition.low, partition.high, self.retries):
            if error and not self.skip:
                raise OSError(f"{partition.archive} at {offset}, {member}: {error}")
            held.append((partition.archive, offset, member, media, error))
            size += len(media or b"")
            if size >= BATCH_BYTES:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), _COLUMNS, strict=True)], schema=_COLUMNS)


class MediaArchives(DataSource):
    """``media_archives``: (archive, offset, member, media, error) of a folder that the same source has written from (member, media).

    Options: path; archivebytes for writing; splitbytes, retries and onerror (fail, or row: a member that can't be read
    comes as a row with its error) for reading.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, offset long, member string, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options)


# --- columns -----------------------------------------------------------


def _pictures(data: pa.Array) -> pa.Array:
    return pa.array([to_picture(x.as_py() or b"") for x in data], pa.binary())


_DECODED = pa.struct([("n_bytes", pa.int64()), ("payload", pa.binary()), ("feature", pa.string())])


def _decoded(media: pa.Array) -> pa.Array:
    rows = []
    for x in media:
        n, samples = from_picture(x.as_py()) if x.is_valid else (None, None)
        rows.append((n, samples, None if samples is None else features(samples)))
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], _DECODED[k].type) for k in range(3)], fields=list(_DECODED))


def write_media(rows: DataFrame, path: str, key: str = "doc_id", data: Column | None = None, **options) -> None:
    """Store data of each row (by default its text in UTF-8; null is empty) as a picture in archives below path. A member's name is its row's number and key."""
    rows.sparkSession.dataSource.register(MediaArchives)
    stored = F.col("text").cast("string").cast("binary") if data is None else data
    tag = F.coalesce(F.concat(F.lit("-"), F.url_encode(F.col(key).cast("string"))), F.lit(""))
    member = F.concat(F.hex(F.monotonically_increasing_id()), tag, F.lit(".png"))
    rows.select(member.alias("member"), F.arrow_udf(_pictures, "binary")(stored).alias("media")).write.format("media_archives").mode("append").options(path=path, **options).save()


def read_media(spark, path: str, **options) -> DataFrame:
    """(archive, offset, member, key, media, error) of archives that write_media() wrote; key is a string, null where it was null."""
    spark.dataSource.register(MediaArchives)
    found = spark.read.format("media_archives").options(path=path, **options).load()
    return found.withColumn("key", F.url_decode(F.regexp_extract("member", r"(?s)^[0-9A-Fa-f]+-(.*)\.png$", 1))).withColumn("key", F.when(F.col("member").rlike("^[0-9A-Fa-f]+-"), F.col("key")))


def decode_media(media: DataFrame) -> DataFrame:
    """media with n_bytes, payload and feature in place of clashing columns; a null medium has nulls."""
    read = F.arrow_udf(_decoded, "n_bytes long, payload binary, feature string")
    return media.withColumn("__d", read("media")).withColumns({c: F.col(f"__d.{c}") for c in ("n_bytes", "payload", "feature")}).drop("__d")


def media_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload, media, feature) of whole texts that went through archives in the shared folder.

    Null texts are empty ones; repeated rows come back as often; other columns are not read. Archives go when Python ends.
    """
    spark = docs.sparkSession
    path = new_path(spark, "media")
    write_media(docs.select("doc_id", "text"), path)
    found = decode_media(read_media(spark, path))
    return found.select(F.col("key").cast("long").alias("doc_id"), "n_bytes", "payload", "media", "feature")
