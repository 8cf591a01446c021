"""Media columns: payloads in tar shards, addressed by content.

A payload is stored as one 8-bit greyscale PNG image of ``WIDTH`` columns, which is
lossless, in a tar shard of the shared folder. Rows carry the payload's digest and
the shard, offset and length of its image; the bytes themselves are in no table and
go through no shuffle. Tasks write shards as they read, each payload once per task.
The index then keeps one place for each digest, so equal payloads share their place;
a second copy that another task stored is never referred to.

Metadata columns come from range reads of the first ``HEADER`` bytes of an image;
whole images are read back only where samples are asked for.

A task that is run again writes shards under new names, and only the rows of the
attempt that succeeded are kept, so lost executors leave unreferenced shards at most.

Defined cases: a null payload is an empty one; padding makes empty payloads one row
of samples; repeated rows share one place; null ids stay; an empty table gives an
empty index and no shard; other columns are not looked at and not returned.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import new_path, remove, stage

WIDTH = 576
FILLER = 255
HEADER = 33
SHARD_BYTES = 256 << 20
LEVEL = 6
#: digests that a task remembers as stored
_SEEN = 1 << 20
# fixed values of the format
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_BLOCK = 512


def padded(data: bytes) -> bytes:
    """``data`` filled up to a positive multiple of ``WIDTH``."""
    return data + bytes([FILLER]) * (-len(data) % WIDTH or (0 if data else WIDTH))


def padded_column(text: Column) -> Column:
    """The padded UTF-8 bytes of a text column, as ``padded`` makes them."""
    utf8 = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(utf8)
    gap = F.when(n == 0, F.lit(WIDTH)).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.concat(utf8, F.unhex(F.repeat(F.lit(f"{FILLER:02X}"), gap)))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A greyscale image whose samples are the bytes of a padded payload."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # each line starts with filter 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> dict[str, int]:
    """What the first ``HEADER`` bytes of an image say."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not an image of this store")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour_type": colour}


def from_png(image: bytes) -> bytes:
    """The payload of an image."""
    size, at, packed = png_header(image[:HEADER]), HEADER, []
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        if kind == b"IDAT":
            packed.append(image[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(size["height"], size["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:].tobytes()


def _file_system(folder: str):
    """pyarrow's file system for a URI of Spark's, and the path in it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), folder) if "://" not in folder else fs.FileSystem.from_uri(folder)


class _Shard:
    """A tar file being written; gives the place of each member's bytes."""

    def __init__(self, folder: str) -> None:
        files, path = _file_system(folder)
        self.name = f"{uuid.uuid4().hex}.tar"
        files.create_dir(path, recursive=True)
        self.stream, self.at = files.open_output_stream(f"{path}/{self.name}"), 0

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.stream.write(head + data + bytes(-len(data) % _BLOCK))
        place = self.at + len(head)
        self.at = place + len(data) + -len(data) % _BLOCK
        return place

    def close(self) -> None:
        self.stream.write(bytes(2 * _BLOCK))
        self.stream.close()


def store(payloads: DataFrame, folder: str, payload: str = "payload", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write padded binary payloads to shards in ``folder``: ``digest`` (SHA-256, binary), ``shard, offset, length``, one row per digest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: _Shard | None = None
        seen: set[bytes] = set()
        for b in batches:
            rows: list[tuple[bytes, str, int, int]] = []
            for x in b.column(0):
                data = padded(x.as_py() or b"")
                digest = hashlib.sha256(data)
                if digest.digest() in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(digest.digest())
                image = to_png(data)
                if shard is not None and shard.at >= shard_bytes:
                    shard.close()
                    shard = None
                shard = shard or _Shard(folder)
                rows.append((digest.digest(), shard.name, shard.add(f"{digest.hexdigest()}.png", image), len(image)))
            yield pa.RecordBatch.from_pylist([dict(zip(("digest", "shard", "offset", "length"), r, strict=True)) for r in rows], schema=_INDEX)
        if shard is not None:
            shard.close()

    # written before anything reads it: the rows name files of the attempt that made them
    spark, path = payloads.sparkSession, new_path(payloads.sparkSession, "media-written")
    schema = "digest binary, shard string, offset bigint, length bigint"
    payloads.select(payload).mapInArrow(write, schema).write.parquet(path)
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    index = stage(spark.read.schema(schema).parquet(path).groupBy("digest").agg(place).select("digest", "place.*"), "media-index")
    remove(spark, path)
    return index


_INDEX = pa.schema([("digest", pa.binary()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _reading(refs: DataFrame, folder: str, schema: str, size: Callable[[int], int], row: Callable[[bytes], dict]) -> DataFrame:
    """``refs`` (with shard, offset, length) and the columns that ``row`` makes of the bytes read at each place."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _file_system(folder)
        name, shard = None, None
        for b in batches:
            got = []
            for s, offset, length in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if s != name:
                    if shard is not None:
                        shard.close()
                    name, shard = s, files.open_input_file(f"{path}/{s}")
                got.append(row(shard.read_at(size(length), offset)))
            extra = [pa.array([g[n] for g in got]) if got else pa.array([], pa.string()) for n in names]
            if got:
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in refs.schema.fields)
    return refs.mapInArrow(run, f"{kept}, {schema}")


def with_headers(refs: DataFrame, folder: str) -> DataFrame:
    """``refs`` with width, height, bit_depth and colour_type, from range reads of the headers alone."""
    return _reading(refs, folder, "width bigint, height bigint, bit_depth bigint, colour_type bigint", lambda n: min(n, HEADER), png_header)


def facts(image: bytes) -> dict:
    """What is worked out from a stored image: checksums of it and of its payload, and a feature of the samples."""
    payload = from_png(image)
    samples = np.frombuffer(payload, dtype=np.uint8)
    shape = np.bincount(samples >> 4, minlength=16)
    steps = np.abs(np.diff(samples.astype(np.int16)))
    feature = ",".join(map(str, [int(samples.sum(dtype=np.int64)), int(steps.sum(dtype=np.int64)), *shape.tolist()]))
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).digest(),
        "tail_crc32": zlib.crc32(payload[-32:]),
        "media_sha256": hashlib.sha256(image).digest(),
        "feature": feature,
    }


def with_facts(refs: DataFrame, folder: str) -> DataFrame:
    """``refs`` with checksums and features of the images, read back whole."""
    columns = "payload_bytes bigint, payload_sha256 binary, tail_crc32 bigint, media_sha256 binary, feature string"
    return _reading(refs, folder, columns, lambda n: n, facts)


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """The rows (``doc_id, n_bytes, digest``), the index with headers, and the folder of the shards."""
    folder = folder or new_path(docs.sparkSession, "media")
    own = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint")
    index = store(docs.select(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("payload")), folder)
    rows = docs.select(F.col(key).alias("doc_id"), own.alias("n_bytes"), F.unhex(F.sha2(padded_column(F.col(text)), 256)).alias("digest"))
    return rows, with_headers(index, folder), folder
