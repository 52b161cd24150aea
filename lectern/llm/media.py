"""Media columns: content-addressed payloads in tar shards.

Each text becomes a payload (its UTF-8 bytes, zeros up to a positive multiple of 64) and is stored losslessly as
a grey 8-bit PNG image, 64 pixels wide, under its SHA-256 digest. Every writer task makes tar files of its own in
a shared folder, a digest once in each, and returns rows with digest, file, offset and length; the first place of
each digest is then the one that all rows point to. Payloads never go through a shuffle; a text that
many tasks meet is stored once by each of them at most.

Readers fill metadata columns from range reads of the header alone (33 bytes at the offset), and features from a
range read of the whole image.

A task that fails leaves a file that no row points to: file names are unique for each attempt, and only rows of
attempts that ended well are kept.

Defined results: null text is empty; an empty text has a payload of 64 zeros; repeated rows and equal texts
share one place and have equal values; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, stored

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
TAR_BYTES = 256 * 1024 * 1024
PLACE = "digest binary, n_bytes long, payload_bytes long, file string, offset long, length long"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and its length without padding."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), dtype=np.uint8)  # each row starts with filter type 0
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIB", head[16:25])


def from_png(image: bytes) -> bytes:
    """The pixels of an image that ``to_png`` made."""
    width, height, _ = read_header(image[:HEADER_BYTES])
    at, body = 8, []
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            body.append(image[at + 8 : at + 8 + size])
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def filesystem(uri: str):
    """The file system of a folder and its path there; a path without a scheme is a local one."""
    from pyarrow.fs import FileSystem

    if uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:").removeprefix("//")
    elif "://" not in uri:
        uri = f"file://{uri}"
    return FileSystem.from_uri(uri)


class TarWriter:
    """Appends members to tar files in a folder and says where each one lies."""

    def __init__(self, folder: str, limit: int = TAR_BYTES):
        self.folder, self.limit, self.out = folder, limit, None

    def add(self, name: str, body: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > self.limit:
            self.close()
            fs, root = filesystem(self.folder)
            fs.create_dir(root, recursive=True)
            self.file = f"{uuid.uuid4().hex}.tar"
            self.out, self.at = fs.open_output_stream(f"{root}/{self.file}"), 0
        member = tarfile.TarInfo(name)
        member.size = len(body)
        head = member.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + body + bytes(-len(body) % 512))
        place = self.file, self.at + len(head), len(body)
        self.at += len(head) + len(body) + -len(body) % 512
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the payloads of ``text`` and returns doc_id with digest, sizes, file, offset and length (already materialised)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        writer, seen = TarWriter(folder), {}
        for batch in batches:
            rows = []
            for text in batch:
                payload, n = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    seen[digest] = writer.add(f"{digest.hex()}.png", to_png(payload))
                rows.append((digest, n, len(payload), *seen[digest]))
            yield pd.DataFrame(rows, columns=["digest", "n_bytes", "payload_bytes", "file", "offset", "length"])
        writer.close()

    places = docs.select("doc_id", F.pandas_udf(run, PLACE)("text").alias("p")).select("doc_id", "p.*")
    return stored(places, "media-rows")


def first_places(rows: DataFrame) -> DataFrame:
    """digest -> the one place that stands for it."""
    return rows.groupBy("digest").agg(F.min(F.struct("file", "offset", "length")).alias("p")).select("digest", "p.*")


def _ranges(batch: pd.DataFrame, folder: str):
    """Rows of (digest, file, offset, length) in file order, each with an open file."""
    fs, root = filesystem(folder)
    for file, rows in batch.sort_values(["file", "offset"]).groupby("file", sort=False):
        with fs.open_input_file(f"{root}/{file}") as f:
            for r in rows.itertuples(index=False):
                yield r, f


PLACED = "digest binary, file string, offset long, length long"
HEADER = "width int, height int, bit_depth int"


def metadata(places: DataFrame, folder: str) -> DataFrame:
    """digest, file, offset, length -> the same with width, height and bit_depth, from range reads of the headers alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r, *read_header(f.read_at(HEADER_BYTES, r.offset))) for r, f in _ranges(b, folder)]
            yield pd.DataFrame(rows, columns=["digest", "file", "offset", "length", "width", "height", "bit_depth"])

    return places.select("digest", "file", "offset", "length").mapInPandas(run, f"{PLACED}, {HEADER}")


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and of the step from one to the next."""
    a = np.frombuffer(payload, dtype=np.uint8)
    share = np.bincount(a, minlength=256) / len(a)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    return f"mean={a.mean():.4f};deviation={a.std():.4f};entropy={entropy:.4f};step={np.abs(np.diff(a.astype(np.int16))).mean():.4f}"


def features(places: DataFrame, folder: str) -> DataFrame:
    """Rows of ``metadata`` -> the same with what the stored bytes say, from range reads of whole images. An image must have the size that its header gave."""
    columns = places.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r, f in _ranges(b, folder):
                image = f.read_at(r.length, r.offset)
                payload = from_png(image)
                if len(payload) != r.width * r.height:
                    raise ValueError(f"{r.file} at {r.offset}: the image isn't of the size that its header gives")
                out.append((*r, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
            yield pd.DataFrame(out, columns=[*columns, "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return places.mapInPandas(run, f"{PLACED}, {HEADER}, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_media(spark, sf_dir):
    folder = new_folder(spark, "media")
    rows = store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    # Readers get neighbours within a file, and about as many rows each.
    places = first_places(rows).repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8), "file", "offset")
    found = stored(features(metadata(places, folder), folder), "media-features")
    out = rows.select("doc_id", "digest", "n_bytes", "payload_bytes").join(found, "digest")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth",
                      F.lower(F.hex("digest")).alias("digest"), F.concat(F.lit(f"{folder}/"), "file").alias("file"), "offset", "length")
