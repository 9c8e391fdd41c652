"""Token ids in seekable files: independent zstandard frames, a table of documents, a seek table.

Layout of a file, in the public zstandard seekable format:

* frames: each is a zstandard frame of little-endian unsigned 32-bit ids of whole documents;
* a skippable frame (magic 0x184D2A5D) with the documents: count, then ids, then lengths in tokens;
* a skippable frame (magic 0x184D2A5E) with the seek table: for each frame its compressed size, its
  size, and the low 32 bits of the XXH64 of its content, then the count of frames, a descriptor byte
  with the checksum flag, and the magic number 0x8F92EAB1.

A reader takes the tail of the file, finds a document's frame, and decompresses that frame only. Files
are cut by tokens and documents, so their number follows the data and a file's tables stay small.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import batch_of, documents
from lodestack.llm.tokens import encoder
from lodestack.scratch import new_path

SEEK_MAGIC, SKIP_SEEK, SKIP_DOCS = 0x8F92EAB1, 0x184D2A5E, 0x184D2A5D
#: Tokens after which a frame is closed; a longer document has a frame of its own.
FRAME_TOKENS = 1 << 16
#: Tokens and documents after which a file is closed: 256 MiB of ids, 64 MiB of tables at most (a longer document has a file of its own).
FILE_TOKENS, FILE_DOCS = 1 << 26, 1 << 22


class Writer:
    """Writes documents in the order they come."""

    def __init__(self, stream, level: int = 3, frame_tokens: int = FRAME_TOKENS):
        self.stream, self.packer, self.frame_tokens = stream, zstandard.ZstdCompressor(level=level), frame_tokens
        self.docs, self.sizes, self.frames = array("q"), array("Q"), array("I")
        self.open, self.held, self.tokens = [], 0, 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        if self.held and self.held + len(ids) > self.frame_tokens:
            self._flush()
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.open.append(ids.astype("<u4", copy=False).tobytes())
        self.held += len(ids)
        self.tokens += len(ids)

    def _flush(self) -> None:
        data = b"".join(self.open)
        packed = self.packer.compress(data)
        self.stream.write(packed)
        self.frames.extend((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.open, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        if 16 * len(self.docs) + 8 >> 32 or 4 * len(self.frames) + 9 >> 32:
            raise ValueError("too many documents or frames for one file: a skippable frame holds less than 4 GiB")
        docs = struct.pack("<Q", len(self.docs)) + np.array(self.docs, "<i8").tobytes() + np.array(self.sizes, "<u8").tobytes()
        self.stream.write(struct.pack("<II", SKIP_DOCS, len(docs)) + docs)
        table = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames) // 3, 0x80, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SKIP_SEEK, len(table)) + table)


class Reader:
    """Random access to the documents of a file; every frame's checksum is verified when it is read."""

    def __init__(self, stream, size: int):
        self.stream = stream
        n, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not descriptor & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        self.frames = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.first = np.concatenate([[0], np.cumsum(self.frames[:, 1])]) // 4  # tokens before each frame
        magic, length = struct.unpack("<II", self._at(int(self.at[-1]), 8))
        body = self._at(int(self.at[-1]) + 8, length)
        count = struct.unpack("<Q", body[:8])[0]
        self.docs = np.frombuffer(body, "<i8", count, 8)
        self.sizes = np.frombuffer(body, "<u8", count, 8 + 8 * count).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])
        self.kept = (-1, np.zeros(0, "<u4"))

    def _at(self, offset: int, size: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(size)

    def frame(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            packed, size, check = (int(x) for x in self.frames[k])
            data = zstandard.ZstdDecompressor().decompress(self._at(int(self.at[k]), packed), max_output_size=size)
            if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} does not match its checksum")
            self.kept = (k, np.frombuffer(data, "<u4"))
        return self.kept[1]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file; documents never span frames."""
        if not self.sizes[i]:
            return np.zeros(0, "<u4")
        k = int(np.searchsorted(self.first, self.start[i], side="right")) - 1
        at = int(self.start[i] - self.first[k])
        return self.frame(k)[at : at + int(self.sizes[i])]


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, file_tokens: int = FILE_TOKENS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Encode every whole text and write files in ascending ``doc_id`` order; returns their manifest.

    Files are written under a name of their own and renamed when complete, so a repeated task leaves
    the same files. The manifest (``part, number, file, bytes, n_docs, n_tokens``) has a row for each
    file; files stand in the order of ``part, number``.
    """
    names = ["part", "number", "file", "bytes", "n_docs", "n_tokens"]
    types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(tokenizer), 0
        store, root = fs.FileSystem.from_uri(folder)
        opened: tuple | None = None  # writer, stream, name

        def close(part: int) -> pa.RecordBatch:
            writer, stream, name = opened
            writer.close()
            stream.close()
            file = f"part-{part:06d}-{number:05d}.zst"
            store.move(name, posixpath.join(root, file))
            size = store.get_file_info(posixpath.join(root, file)).size
            return batch_of(names, types, [[part], [number], [file], [size], [len(writer.docs)], [writer.tokens]])

        for batch in batches:
            for doc_id, text, part in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("part").to_pylist(), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(end_id))
                if opened and (opened[0].tokens + len(ids) > file_tokens or len(opened[0].docs) >= file_docs):
                    yield close(part)
                    opened, number = None, number + 1
                if opened is None:
                    store.create_dir(root, recursive=True)
                    name = posixpath.join(root, f".part-{part:06d}-{uuid.uuid4().hex}")
                    stream = store.open_output_stream(name)
                    opened = Writer(stream), stream, name
                opened[0].add(doc_id, ids)
        if opened:
            yield close(part)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents(docs).where("doc_id is not null").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.withColumn("part", F.spark_partition_id())
    return rows.mapInArrow(run, "part int, number int, file string, bytes long, n_docs long, n_tokens long")


def read(spark, folder: str, manifest: list) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decompressed from the files.

    ``manifest`` holds one row for each file (not for each document), in any order.
    """
    files, before = [], 0
    for m in sorted(manifest, key=lambda m: (m["part"], m["number"])):
        files.append((m["file"], m["bytes"], before))
        before += m["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, size, base in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "base")), strict=True):
                with store.open_input_file(posixpath.join(root, file)) as stream:
                    r = Reader(stream, size)
                    for at in range(0, len(r.docs), 20_000):
                        stop = min(at + 20_000, len(r.docs))
                        crc = [zlib.crc32(r.document(i).tobytes()) for i in range(at, stop)]
                        yield batch_of(["doc_id", "start", "n_tokens", "ids_crc32"], [pa.int64()] * 4, [r.docs[at:stop], base + r.start[at:stop], r.sizes[at:stop], crc])

    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    table = spark.createDataFrame(files, "file string, bytes long, base long").repartition(len(files), "file")
    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, file_tokens: int = FILE_TOKENS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Write ``docs`` (``doc_id, text``) and read the files back: one row per document.

    Null text counts as empty (the end id alone). Rows with a null ``doc_id`` have no place in the
    order and are left out; repeated ids stand in the order of their texts. Other columns are
    ignored; an empty table writes no file and gives an empty result.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    manifest = write(docs, tokenizer, folder, end_id, file_tokens, file_docs).collect()  # one row per file
    return read(spark, folder, manifest)
