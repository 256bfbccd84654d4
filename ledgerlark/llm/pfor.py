"""Patched frame-of-reference files of token ids.

A file holds whole documents in ascending doc_id order. Ids are cut into blocks of BLOCK. A block
stores its least id, the other ids as differences to it in a fixed number of bits, and the
differences that need more bits in an exception list of positions and values. The number of bits is
what the given percentile of the block's differences needs. An index gives each block's first byte, so
read_document() decodes the blocks of one document alone. All numbers are little-endian:

    magic 8 bytes | n_docs u32 | n_ids u64 | n_blocks u32
    doc_id i64 * n_docs | doc_id is null u8 * n_docs | ids of the document u32 * n_docs
    first byte of each block, and the end u64 * (n_blocks + 1), counted from the first block
    blocks: least id u32 | bits u8 | exceptions u8 u8 (u16) | packed ids | positions u8 * n | values u32 * n

Null texts are empty, so every document has its end id at least. Null doc_ids come first. Rows that
repeat a doc_id are ordered by text. Very long texts may fill several blocks and make a large file.
An empty table gives no files and no rows. Extra columns don't matter.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm import tokens
from ledgerlark.llm.common import map_arrow, new_path

MAGIC = b"LLPFOR01"
BLOCK = 256
HEAD = np.dtype([("magic", "S8"), ("docs", "<u4"), ("ids", "<u8"), ("blocks", "<u4")])


@dataclass(frozen=True)
class Format:
    """percentile of differences that fit the packed bits; ids of a file at most, but for one long text."""

    percentile: int = 90
    file_ids: int = 1 << 23


def _bytes_of(bits: int) -> int:
    return 1 if bits <= 8 else 2 if bits <= 16 else 4


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Rows of BLOCK values to rows of BLOCK * bits / 8 bytes, lowest bit first."""
    raw = values.astype(f"<u{_bytes_of(bits)}").view(np.uint8).reshape(-1)
    planes = np.unpackbits(raw, bitorder="little").reshape(len(values), BLOCK, -1)[:, :, :bits]
    return np.packbits(planes.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(data: np.ndarray, bits: int) -> np.ndarray:
    planes = np.zeros((len(data), BLOCK, 8 * _bytes_of(bits)), dtype=np.uint8)
    planes[:, :, :bits] = np.unpackbits(data, axis=1, bitorder="little").reshape(len(data), BLOCK, bits)
    return np.packbits(planes.reshape(-1), bitorder="little").view(f"<u{_bytes_of(bits)}").reshape(len(data), BLOCK)


def _width(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) + 1, 0)


def pack_ids(ids: np.ndarray, percentile: int = 90) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the blocks (with the end) and their bytes."""
    n = -(-len(ids) // BLOCK)
    full = np.zeros(n * BLOCK, dtype=np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1] if len(ids) else 0
    full = full.reshape(n, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    bits = _width(np.partition(rest, (BLOCK - 1) * percentile // 100, axis=1)[:, (BLOCK - 1) * percentile // 100]).astype(np.uint32)
    out = rest >> np.minimum(bits, 31)[:, None] > 0
    out &= bits[:, None] < 32
    extra = out.sum(axis=1)
    size = 7 + BLOCK // 8 * bits.astype(np.int64) + 5 * extra
    at = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(size, out=at[1:])
    data = np.zeros(at[-1], dtype=np.uint8)
    head = np.concatenate([least.astype("<u4").view(np.uint8).reshape(n, 4), bits.astype(np.uint8)[:, None], extra.astype("<u2").view(np.uint8).reshape(n, 2)], axis=1)
    data[at[:-1, None] + np.arange(7)] = head
    for b in np.unique(bits).tolist():
        rows = np.flatnonzero(bits == b)
        if b:
            for part in np.array_split(rows, max(1, len(rows) // 2048)):
                data[at[part, None] + 7 + np.arange(BLOCK // 8 * b)] = _pack(np.where(out[part], 0, rest[part]).astype(np.uint32), b)
    row, place = np.nonzero(out)
    first = np.cumsum(extra) - extra
    rank = np.arange(len(row)) - first[row]
    base = at[row] + 7 + BLOCK // 8 * bits[row].astype(np.int64)
    data[base + rank] = place.astype(np.uint8)
    values = rest[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    data[(base + extra[row] + 4 * rank)[:, None] + np.arange(4)] = values
    return at, data


def unpack_ids(at: np.ndarray, data: np.ndarray, n_ids: int) -> np.ndarray:
    n = len(at) - 1
    at = at.astype(np.int64)
    head = data[at[:-1, None] + np.arange(7)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4").reshape(n)
    bits = head[:, 4].astype(np.int64)
    extra = np.ascontiguousarray(head[:, 5:7]).view("<u2").reshape(n).astype(np.int64)
    out = np.zeros((n, BLOCK), dtype=np.uint32)
    for b in np.unique(bits).tolist():
        rows = np.flatnonzero(bits == b)
        if b:
            for part in np.array_split(rows, max(1, len(rows) // 2048)):
                out[part] = _unpack(data[at[part, None] + 7 + np.arange(BLOCK // 8 * b)], b)
    row = np.repeat(np.arange(n), extra)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(extra) - extra, extra)
    base = at[row] + 7 + BLOCK // 8 * bits[row]
    values = data[(base + extra[row] + 4 * rank)[:, None] + np.arange(4)]
    out[row, data[base + rank]] = np.ascontiguousarray(values).view("<u4").reshape(-1)
    return (out + least[:, None].astype(np.uint32)).reshape(-1)[:n_ids]


def to_bytes(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray, percentile: int = 90) -> bytes:
    at, data = pack_ids(ids, percentile)
    head = np.array([(MAGIC, len(doc_ids), len(ids), len(at) - 1)], dtype=HEAD)
    parts = (head, doc_ids.astype("<i8"), nulls.astype(np.uint8), lengths.astype("<u4"), at.astype("<u8"), data)
    return b"".join(x.tobytes() for x in parts)


def from_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, whether each is null, lengths and all ids of a file."""
    head = np.frombuffer(raw, dtype=HEAD, count=1)[0]
    if head["magic"] != MAGIC:
        raise ValueError("not a token file")
    n, blocks, place = int(head["docs"]), int(head["blocks"]), HEAD.itemsize
    got = []
    for kind, count in (("<i8", n), ("u1", n), ("<u4", n), ("<u8", blocks + 1)):
        got.append(np.frombuffer(raw, dtype=kind, count=count, offset=place))
        place += got[-1].nbytes
    data = np.frombuffer(raw, dtype=np.uint8, offset=place)
    return got[0], got[1], got[2], unpack_ids(got[3], data, int(head["ids"]))


def block_ids(raw: pa.NativeFile, first: int, last: int) -> np.ndarray:
    """The ids first to last - 1 of an open file, of which only the head, two places of the index and their blocks are read."""
    head = np.frombuffer(raw.read_at(HEAD.itemsize, 0), dtype=HEAD)[0]
    if head["magic"] != MAGIC:
        raise ValueError("not a token file")
    n, blocks = int(head["docs"]), int(head["blocks"])
    if not 0 <= first <= last <= int(head["ids"]):
        raise IndexError("no such ids")
    if first == last:
        return np.zeros(0, dtype=np.uint32)
    a, z = first // BLOCK, -(-last // BLOCK)
    index = HEAD.itemsize + 13 * n
    at = np.frombuffer(raw.read_at(8 * (z - a + 1), index + 8 * a), dtype="<u8")
    data = np.frombuffer(raw.read_at(int(at[-1] - at[0]), index + 8 * (blocks + 1) + int(at[0])), dtype=np.uint8)
    return unpack_ids(at - at[0], data, (z - a) * BLOCK)[first - a * BLOCK : last - a * BLOCK]


def read_document(uri: str, number: int) -> np.ndarray:
    """The ids of the number-th document of a file, by the index of blocks: the lengths before it and its own blocks are read."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        n = int(np.frombuffer(f.read_at(HEAD.itemsize, 0), dtype=HEAD)[0]["docs"])
        if not 0 <= number < n:
            raise IndexError("no such document")
        lengths = np.frombuffer(f.read_at(4 * (number + 1), HEAD.itemsize + 9 * n), dtype="<u4").astype(np.int64)
        return block_ids(f, int(lengths[:-1].sum()), int(lengths.sum()))


def _put(uri: str, data: bytes) -> None:
    """Whole files only: written beside, then moved, so a task that runs again does no harm."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    beside = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(beside) as f:
        f.write(data)
    if fs.get_file_info(path).type == pafs.FileType.File and fs.type_name != "local":
        fs.delete_file(path)
    fs.move(beside, path)


def write(docs: DataFrame, tokenizer: str, end: int, to: str, form: Format = Format()) -> list[tuple[str, int]]:
    """Write the token files below the URI `to`; returns their URIs and how many ids come before each."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, docs_held, lengths = TaskContext.get().partitionId(), 0, [], [], []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal k, count
            own = pa.concat_arrays(docs_held)
            uri = f"{to}/ids-{part:06d}-{k:06d}.pfor"
            _put(uri, to_bytes(np.asarray(own.fill_null(0)), np.asarray(own.is_null()), np.concatenate(lengths), np.concatenate(held), form.percentile))
            out = pa.RecordBatch.from_pydict({"part": [part], "k": [k], "uri": [uri], "n": pa.array([count], pa.int64())})
            k, count = k + 1, 0
            held.clear(), docs_held.clear(), lengths.clear()
            return out

        for b in batches:
            for first, ids, at in tokens.encoded(b.column(1), tokenizer, end):
                held.append(ids)
                lengths.append(np.diff(at))
                docs_held.append(b.column(0).slice(first, len(at) - 1))
                count += len(ids)
                if count >= form.file_ids:
                    yield flush()
        if held:
            yield flush()

    found = sorted((r.part, r.k, r.uri, r.n) for r in map_arrow(rows, run, "part long, k long, uri string, n long", tokens.CACHE).collect())
    out, before = [], 0
    for _, _, uri, n_ids in found:
        out.append((uri, before))
        before += n_ids
    return out


def read(spark, files: list[tuple[str, int]]) -> DataFrame:  # noqa: ANN001
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    doc_ids, nulls, lengths, ids = from_bytes(f.read())
                at = np.zeros(len(lengths) + 1, dtype=np.int64)
                np.cumsum(lengths, out=at[1:])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = [pa.array(doc_ids, mask=nulls.astype(bool)), pa.array(before + at[:-1]), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    listed = spark.createDataFrame(files, "uri string, before long").repartition(max(1, min(len(files), 4096)))
    return map_arrow(listed, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode(docs: DataFrame, tokenizer: str, end: int = 2, form: Format = Format()) -> DataFrame:
    """Write docs' ids below the shared folder and return what the files say of every document."""
    spark = docs.sparkSession
    return read(spark, write(docs, tokenizer, end, new_path(spark, "pfor"), form))
