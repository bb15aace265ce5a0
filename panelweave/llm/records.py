"""Token-ID output: length-delimited binary records with an offset index.

Texts are tokenised, an end id is appended, and each sequence becomes one frame

    length of the payload     8 bytes, little endian
    masked checksum of those  4 bytes
    payload                   ``length`` bytes
    masked checksum of it     4 bytes
    line feed                 1 byte

with the payload: doc_id (8 bytes signed), flags (1: bit 0 set if the id is not
null), bytes an id (1: 2 or 4), number of ids (4), ids.  The mask rotates a
crc32 right by 15 bits and adds 0xA282EAD8.  The line feed lets Spark's own text
writer commit the files to any store it can reach; readers go by the lengths.

Files are named in ascending order of doc_id.  The index has a row for each
frame: file, offset, length, doc_id, number of ids, checksum of the ids and the
number of ids before it in its file.  Readers that shuffle draw from the index
and seek; the whole files are never needed in order.

Defined cases: a null or empty text gives the end id alone; null doc_ids come
first; rows with one doc_id stay together, ordered by a hash of the text and
the text; a very long text is one frame.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import append_columns, quoted, worker_state
from panelweave.storage import stage

FILE_TEXT_BYTES = 16 << 20
CACHED_CHUNKS, CACHED_WORDS = 150_000, 300_000
CACHED_LENGTH = 64  # of a chunk; together they bound the bytes of the caches
#: Settings of tokenizers that lower, split at white space and into letters, digits and marks (fixed values).
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_MARKS = ".,!?;:#$%&*|()[]{}<>=+-_~^@/\\\"`"
_HEAD = "<qBBI"
_HEAD_SIZE = 14
_FRAME = T.StructType([T.StructField("frame", T.BinaryType())])
_INDEX = "file string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, before long"


def masked(data: bytes) -> bytes:
    crc = zlib.crc32(data)
    return struct.pack("<I", ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF)


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = struct.pack(_HEAD, doc_id or 0, doc_id is not None, width, len(ids) // width) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, masked(length), payload, masked(payload)))


def frames(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """offset, length of the frame, doc_id and ids of each record; raises on a damaged file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        length = bytes(view[at : at + 8])
        if len(length) < 8 or masked(length) != bytes(view[at + 8 : at + 12]):
            raise ValueError(f"damaged length at byte {at}")
        end = at + 12 + struct.unpack("<Q", length)[0]
        payload = view[at + 12 : end]
        if end + 5 > len(data) or masked(payload) != bytes(view[end : end + 4]):
            raise ValueError(f"damaged record at byte {at}")
        doc_id, flags, width, count = struct.unpack(_HEAD, payload[:_HEAD_SIZE])
        ids = np.frombuffer(payload, dtype=f"<u{width}", count=count, offset=_HEAD_SIZE)
        yield at, end + 4 - at, doc_id if flags & 1 else None, ids
        at = end + 5


def byte_letters() -> dict[int, int]:
    """Latin-1 code points to the printable letters of byte-level vocabularies.

    Visible bytes stand for themselves, the others for the letters from 256 on.
    """
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


class ChunkEncoder(dict):
    """Ids of blank-delimited chunks, as bytes; each is encoded when first met.

    Only for a tokenizer whose settings say that it lowers its text, that its
    pieces never cross white space and that it drops that (the settings above):
    then the ids of a text are those of its chunks, one after the other, and a
    chunk of letters, perhaps with punctuation behind, skips the normaliser and
    splitter and goes to the model.  With any other settings whole texts are
    encoded.
    """

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        settings = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in settings.get("added_tokens", [])]
        self.by_chunk = settings["normalizer"] == _NORMALIZER and settings["pre_tokenizer"] == _SPLITTER and not any(c.isspace() for t in added for c in t)
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 65536 else 4
        self.spelling = [i.to_bytes(self.width, "little") for i in range(size)]
        self.end = end_id.to_bytes(self.width, "little")
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def full(self, chunk: str) -> bytes:
        return b"".join([self.spelling[i] for i in self.tokenizer.encode(chunk, add_special_tokens=False).ids])

    def quick(self, chunk: str) -> bytes | None:
        """Through the model alone; None if the chunk is not of the simple kind."""
        bare = chunk.rstrip(_MARKS)
        word = bare if "\u03a3" in bare else bare.lower()  # a final sigma depends on its neighbours
        ids = self.words.get(word)
        if ids is None:
            if not word.isalpha():
                return None
            if word.isascii():
                spelt = word
            elif word.islower() and unicodedata.is_normalized("NFC", word) and unicodedata.is_normalized("NFC", bare):
                spelt = word.encode().decode("latin-1").translate(self.letters)
            else:
                return None
            ids = b"".join([self.spelling[t.id] for t in self.model.tokenize(spelt)])
            if len(word) <= CACHED_LENGTH:
                self.words[word] = ids
        mark = chunk[len(bare) :]
        if not mark:
            return ids
        if mark not in self.marks:
            if len(mark) > CACHED_LENGTH:
                return ids + self.full(mark)
            self.marks[mark] = self.full(mark)
        return ids + self.marks[mark]

    def __missing__(self, chunk: str) -> bytes:
        ids = self.quick(chunk)
        if ids is None:
            ids = self.full(chunk)
        if len(chunk) <= CACHED_LENGTH:
            self[chunk] = ids
        return ids

    def batch(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_chunk:
            return [(self.full(t) if t else b"") + self.end for t in texts]
        for seen, most in ((self, CACHED_CHUNKS), (self.words, CACHED_WORDS), (self.marks, 10_000)):
            if len(seen) > most:
                seen.clear()
        split = [t.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") if t else () for t in texts]
        return [b"".join(map(self.__getitem__, chunks)) + self.end for chunks in split]


def write_records(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 1,
    text: str = "text",
    doc_id: str = "doc_id",
    file_text_bytes: int = FILE_TEXT_BYTES,
) -> None:
    """Write the frames of all rows under ``path``, by ascending doc_id."""
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    files = max(1, -(-size // file_text_bytes))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(files, "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")

    def make():
        encoder = worker_state(__name__, (tokenizer, end_id), lambda: ChunkEncoder(tokenizer, end_id))

        def encode(texts, ids):
            decoded = [None if t is None else t.decode("utf-8") for t in texts]
            return [[frame(i, e, encoder.width) for i, e in zip(ids, encoder.batch(decoded))]]

        return encode

    packed = append_columns(ordered, "text", _FRAME, make, keep=[], extra=["doc_id"])
    packed.select(F.col("frame").cast("string").alias("value")).write.text(path, lineSep="\n")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, with every checksum verified."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, before = [], 0
                for offset, length, doc_id, ids in frames(content.as_py()):
                    rows.append((offset, length, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), before))
                    before += len(ids)
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                names = ["offset", "length", "doc_id", "n_tokens", "ids_crc32", "before"]
                if rows:
                    files = pa.array([file.rsplit("/", 1)[-1]] * len(rows))
                    yield pa.RecordBatch.from_arrays([files, *columns], names=["file", *names])

    return found.mapInArrow(parse, _INDEX)


def write_token_records(docs: DataFrame, path: str, tokenizer: str, **options) -> DataFrame:
    """Write records and their index; returns the index with ``start``, the ids before each record."""
    spark = docs.sparkSession
    write_records(docs, f"{path}/records", tokenizer, **options)
    # no index without a read back: what is in it has been verified
    read_index(spark, f"{path}/records").write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # a row a file
    starts = totals.select(
        F.col("file").alias("of"),
        F.expr("coalesce(sum(n) over (order by file rows between unbounded preceding and 1 preceding), 0)").alias("base"),
    )
    return index.join(starts, index["file"] == starts["of"]).drop("of").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids of every record under ``path``."""
    found = spark.read.format("binaryFile").load(f"{path}/records").select("content")

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = [(d, i.astype(np.int64)) for _, _, d, i in frames(content.as_py())]
                for start in range(0, len(rows), 512):
                    part = rows[start : start + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d for d, _ in part], pa.int64()), pa.array([i for _, i in part], pa.list_(pa.int64()))],
                        names=["doc_id", "ids"],
                    )

    return found.mapInArrow(parse, "doc_id long, ids array<long>")
