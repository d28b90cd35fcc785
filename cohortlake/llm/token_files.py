"""Token ids in seekable files: independent zstandard frames, a document table and a trailing seek table.

A file is a row of zstandard frames, so any zstandard reader restores all ids (little-endian unsigned 32-bit)
in document order.  Two skippable frames follow, which such readers pass over:

* the document table: magic 0x184D2A50, size, then a zstandard frame with, for each document, a null flag (one byte),
  its id (int64) and its number of ids (uint64), column by column;
* the seek table of the public seekable format: magic 0x184D2A5E, size, per frame (the document table counts as one of
  no content) compressed size, content size and the low 32 bits of XXH64 of the content, then the number of
  frames, the descriptor 0x80 (checksums present) and the magic 0x8F92EAB1.

A frame ends with a document once it holds ``FRAME`` bytes; a longer document has frames of its own.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import buckets_for, fresh_path, lean, small_batches, stored, table
from cohortlake.llm.encoding import encoder
from cohortlake.llm.textkit import chunks
from cohortlake.llm.warc import _opened

#: End-of-document id that closes every document.
END_ID = 2
#: Content of a frame after which it ends, in bytes; text bytes that make up one file; text bytes encoded at a time.
FRAME, FILE, TEXT = 1 << 17, 1 << 27, 1 << 22
#: Documents that one file should hold at most.
FILE_ROWS = 2_000_000
#: Selected documents of this many bytes of ids of a file are read by one task.
STRETCH = 1 << 25
LEVEL = 3

# Fixed values of the formats.
DOCUMENTS_MAGIC, SEEK_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


def _checksum(content: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class _Writer:
    """One file.  Holds the open frame and the document table, never the ids of a file."""

    def __init__(self, name: str, frame: int):
        import zstandard

        self.frame, self.name, self.pack = frame, name, zstandard.ZstdCompressor(level=LEVEL).compress
        system, inner = _opened(name)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(inner, compression=None)
        self.open, self.table = bytearray(), []
        self.keys: list[int | None] = []
        self.counts: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.counts.append(len(ids) // 4)
        if len(ids) >= self.frame and self.open:
            self._cut()
        self.open += ids
        while len(self.open) >= 2 * self.frame:
            self._cut(self.frame)
        if len(self.open) >= self.frame:
            self._cut()

    def _cut(self, size: int | None = None) -> None:
        content = bytes(self.open[:size])
        del self.open[:size]
        frame = self.pack(content)
        self.out.write(frame)
        self.table.append((len(frame), len(content), _checksum(content)))

    def close(self) -> None:
        if self.open:
            self._cut()
        flags = bytes(k is None for k in self.keys)
        body = self.pack(flags + np.array([k or 0 for k in self.keys], "<i8").tobytes() + np.array(self.counts, "<u8").tobytes())
        head = struct.pack("<II", DOCUMENTS_MAGIC, len(body) + 4) + struct.pack("<I", len(self.keys))
        self.out.write(head + body)
        self.table.append((len(head) + len(body), 0, _checksum(b"")))
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class Reader:
    """Random access to the documents of one file; every frame that is read is checked."""

    def __init__(self, name: str):
        import zstandard

        system, inner = _opened(name)
        self.name, self.file = name, system.open_input_file(inner)
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{name}: no seek table with checksums at the end")
        at = size - 9 - 12 * frames
        head = struct.unpack("<II", self.file.read_at(8, at - 8))
        if head != (SEEK_MAGIC, 12 * frames + 9):
            raise ValueError(f"{name}: the seek table does not begin where it should")
        table = np.frombuffer(self.file.read_at(12 * frames, at), "<u4").reshape(-1, 3).astype(np.int64)
        self.sums = table[:, 2]
        self.places = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.begins = np.concatenate([[0], np.cumsum(table[:, 1])])  # of the contents, in bytes
        self.last: tuple[int, bytes] | None = None

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is null, id, number of ids) of all documents, from the document table alone."""
        first, end = self.places[-2], self.places[-1]
        raw = self.file.read_at(int(end - first), int(first))
        magic, _, n = struct.unpack_from("<III", raw)
        if magic != DOCUMENTS_MAGIC:
            raise ValueError(f"{self.name}: no document table before the seek table")
        body = self.unpack(raw[12:])
        return (
            np.frombuffer(body, np.uint8, n).astype(bool), np.frombuffer(body, "<i8", n, n), np.frombuffer(body, "<u8", n, 9 * n).astype(np.int64),
        )

    def _content(self, k: int) -> bytes:
        if self.last is None or self.last[0] != k:
            a, b = int(self.places[k]), int(self.places[k + 1])
            content = self.unpack(self.file.read_at(b - a, a))
            if _checksum(content) != self.sums[k]:
                raise ValueError(f"{self.name}: frame {k} does not match its checksum")
            self.last = (k, content)
        return self.last[1]

    def ids(self, first: int, count: int) -> bytes:
        """Ids ``first`` to ``first + count`` of the file; only the frames that hold them are read."""
        a, b = 4 * first, 4 * (first + count)
        k = int(np.searchsorted(self.begins, a, "right")) - 1
        parts = []
        while a < b:
            begin = int(self.begins[k])
            end = min(b, int(self.begins[k + 1]))
            if end > a:
                parts.append(self._content(k)[a - begin : end - begin])
                a = end
            k += 1
        return b"".join(parts)


FILES = "file string, part long, documents long, ids long"


def write_tokens(docs: DataFrame, ident: str, text: str, tokenizer: str, path: str, frame: int = FRAME, size: int = FILE) -> DataFrame:
    """Encode every text, append ``END_ID`` and write all ids under ``path`` in ascending id order; one row per file.

    ``frame`` is the content of a frame and ``size`` the text of a file, in bytes, after which they end.

    The result is the catalogue: file, part (the files' order), documents, ids, start (ids in all files before).
    A null text is empty; a null id is kept and comes first; rows that repeat an id are documents of their own, in
    the order of a hash of their texts.  Other columns are not read.  An empty table writes no file.

    Texts are shuffled once, by ranges of ids; a salt lets rows that repeat an id fall into several ranges, so that
    one id with a third of all rows is no task of its own.  Every task then sorts, encodes and writes
    its range.  File names are unique to an attempt, and only attempts that Spark commits reach the catalogue, so
    a lost or repeated attempt leaves at most a file that nobody refers to.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(ident).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("bytes")).first()  # one row
    parts = max(buckets_for(total["bytes"], size), buckets_for(total["n"], FILE_ROWS))
    keyed = rows.withColumn("_hash", F.xxhash64("_text")).withColumn("_salt", F.monotonically_increasing_id())
    order = [F.col("_id").asc_nulls_first(), "_hash", "_salt"]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("_id", "_text")
    folder = path.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own, end = None, encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows and out is None:
                out = _Writer(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst", frame)
            for low, high, _, _ in chunks(batch["_text"], TEXT):
                texts = [t or "" for t in batch["_text"].slice(low, high - low).to_pylist()]
                for key, ids in zip(batch["_id"].slice(low, high - low).to_pylist(), own.encode(texts), strict=True):
                    out.add(key, ids.astype("<u4").tobytes() + end)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": out.name, "part": part, "documents": len(out.keys), "ids": sum(out.counts)}])

    return _with_starts(stored(dealt.mapInArrow(lean(write), FILES), "token-files"))


def _with_starts(files: DataFrame) -> DataFrame:
    """The files plus start; sums over blocks of a thousand files first, so that no window holds all files of a corpus."""
    block = F.floor(F.col("part") / 1000)
    blocks = files.groupBy(block.alias("_block")).agg(F.sum("ids").alias("_sum"))
    before = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_sum").over(before(Window.orderBy("_block"))), F.lit(0))
    blocks = blocks.select("_block", earlier.alias("_earlier"))
    inside = F.coalesce(F.sum("ids").over(before(Window.partitionBy("_block").orderBy("part"))), F.lit(0))
    placed = files.withColumn("_block", block).withColumn("_inside", inside)
    return placed.join(blocks, "_block").select(*files.columns, (F.col("_inside") + F.col("_earlier")).cast("long").alias("start"))


INDEX = "file string, doc_id long, at long, n_tokens long, start long"


def index_of(files: DataFrame) -> DataFrame:
    """One row per document of a catalogue: file, doc_id, at (place in the file), n_tokens, start (place in the corpus).

    Only the tables at the files' ends are read.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                null, keys, counts = Reader(name).documents()
                at = np.cumsum(counts) - counts
                for low in range(0, len(keys), 100_000):
                    cut = slice(low, low + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(at[cut])), pa.array(keys[cut], mask=null[cut]), *map(pa.array, (at[cut], counts[cut], start + at[cut]))],
                        names=[c.split()[0] for c in INDEX.split(", ")],
                    )

    return files.select("file", "start").mapInArrow(lean(listed), INDEX)


DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"


def read_documents(selected: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of selected index rows; ids as little-endian unsigned 32-bit integers.

    ``selected`` may be any part of :func:`index_of`.  Rows are dealt by file and stretch and sorted, and only the
    frames that hold a selected document are read, each checked against its checksum.
    """
    stretch = F.floor(F.col("at") * 4 / F.lit(STRETCH))
    near = selected.select(*[c.split()[0] for c in INDEX.split(", ")]).repartition("file", stretch).sortWithinPartitions("file", "at")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            names, at, n = (batch[c].to_pylist() for c in ("file", "at", "n_tokens"))
            low = 0
            while low < len(names):
                ids, size, high = [], 0, low
                while high < len(names) and size < STRETCH // 4:
                    if reader is None or reader.name != names[high]:
                        reader = Reader(names[high])
                    ids.append(reader.ids(at[high], n[high]))
                    size += len(ids[-1])
                    high += 1
                own = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [own["doc_id"], own["start"], own["n_tokens"], pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"]
                )
                low = high

    return near.mapInArrow(lean(fetch), DOCUMENT)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to seekable files and read back: doc_id, start, n_tokens, ids_crc32.

    A null text has only the end id.  See :func:`write_tokens` for nulls, repeated ids and empty tables.
    """
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = stored(write_tokens(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "tokens")), "catalogue")
    return read_documents(index_of(files)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op12_token_files": op12_token_files}
ORACLE: dict[str, str] = {}
