"""Asking the whole corpus about hashes, chunk by chunk, without hot groups.

Documents are dealt into chunks by a hash of their own content, packed and compressed where they are read; that is
the only shuffle of texts, and Spark reuses it for every later pass of the same query. A chunk sends each distinct
hash at most once, sorted, as one packed row for each part of the hash space that has any. A part meets the chunks'
sorted runs, so a hash that a third of all rows share weighs as many entries as there are chunks. Answers travel
back as one packed row for each chunk and part, in the order of the question. Packed rows never outnumber the hashes
in them. Chunks and parts are of fixed size, and tasks follow their number, so no task grows with the input.

Where only hashes that two chunks have matter, a chunk first asks with short ones (`short_bits`): a short hash that no
other chunk sent is surely its own, and only the rest is sent whole.
"""

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import short_batches, text_bytes, texts_of

#: Bytes of text for each chunk and, at most, each part; and how many of them a task works on, one after the other.
CHUNK_TEXT, PART_TEXT, IN_A_TASK = 8 << 20, 8 << 20, 4
#: Bytes of text that are dealt to their chunks and compressed at once.
PACKED_TEXT = 16 << 20
#: Bits of a short hash over those that all hashes of a corpus need: one in 2**SPARE meets another by chance.
SPARE = 4
ASKED = "part int, chunk int, body binary"
ANSWERED = "chunk int, part int, body binary"


@dataclass(frozen=True)
class Plan:
    """How many chunks, bits that name a part, and bits of a short hash; and how many tasks work on chunks or parts."""

    chunks: int
    part_bits: int
    short_bits: int
    tasks: int

    def by(self, df: DataFrame, column: str) -> DataFrame:
        return df.repartition(self.tasks, column)


def in_chunks(docs: DataFrame, *columns: str, chunk_text: int = CHUNK_TEXT) -> tuple[DataFrame, Plan]:
    """Packed rows (chunk, body) of the columns, dealt by a hash of doc_id and text (nulls too), and the plan to use."""
    size = text_bytes(docs)
    n = max(16, -(-size // chunk_text))
    part_bits = max(4, math.ceil(math.log2(max(1, size / PART_TEXT))))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    plan = Plan(n, part_bits, min(64, max(part_bits, math.ceil(math.log2(max(2, size / 3))) + SPARE)), max(min(n, cores), -(-n // IN_A_TASK)))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    dealt = short_batches(docs.select(*columns, chunk.alias("chunk"))).mapInArrow(_pack, "chunk int, body binary")
    return plan.by(dealt, "chunk"), plan


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PACKED_TEXT:
            yield from _dealt(held)
            held, size = [], 0
    if held:
        yield from _dealt(held)


def _dealt(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).sort_by("chunk").combine_chunks()
    chunks = table["chunk"].to_numpy()
    edges = np.append(np.flatnonzero(np.diff(chunks, prepend=-1)), len(chunks))
    rest = table.drop_columns("chunk")
    rest = rest.set_column(rest.schema.get_field_index("text"), "text", texts_of(rest))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as stream:
            stream.write_table(rest.slice(a, b - a))
        body = zstandard.ZstdCompressor(level=1).compress(sink.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([chunks[a]], pa.int32()), pa.array([body], pa.binary())], ["chunk", "body"])


def unpacked_rows(packed_rows: pa.Table) -> pa.Table:
    """The rows of a chunk; without packed rows none."""
    bodies = packed_rows["body"].to_pylist()
    got = [pa.ipc.open_stream(zstandard.ZstdDecompressor().decompressobj().decompress(b)).read_all() for b in bodies]
    return pa.concat_tables(got).combine_chunks()


def _planes(a: np.ndarray) -> tuple[int, bytes]:
    """Bytes of a rank together, as many ranks as the largest value needs."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
    width = a.itemsize
    while width > 1 and not raw[:, width - 1].any():
        width -= 1
    return width, np.ascontiguousarray(raw[:, :width].T).tobytes()


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of one length as bytes: the first, sorted, as differences, with bytes of a rank together, then zstd."""
    first = arrays[0].astype(np.uint64)
    planes = [_planes(a) for a in (np.diff(first, prepend=np.uint64(0)), *arrays[1:])]
    head = np.array([len(first), *(width for width, _ in planes)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join((head, *(body for _, body in planes))))


def unpacked(body: bytes, kinds: list[type]) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(body)
    n, *widths = np.frombuffer(data, np.int64, 1 + len(kinds)).tolist()
    at, out = 8 * (1 + len(kinds)), []
    for kind, width in zip(kinds, widths):
        plain = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        plain[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        out.append(plain.view(kind).reshape(n))
        at += n * width
    out[0] = np.cumsum(out[0].astype(np.uint64), dtype=np.uint64)
    return out


def parts_of(keys: np.ndarray, part_bits: int, key_bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The parts that sorted keys lie in, and where each part's begin (one more at the end)."""
    part = (keys >> np.uint64(key_bits - part_bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    return part[starts], np.append(starts, len(keys))


def asked(chunk: int, part_bits: int, arrays: list[np.ndarray], key_bits: int = 64) -> pa.Table:
    """The packed rows of a chunk's question; the first array is its sorted distinct keys."""
    parts, edges = parts_of(arrays[0], part_bits, key_bits)
    rows = [packed([a[i:j] for a in arrays]) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return pa.table({"part": pa.array(parts.astype(np.int32)), "chunk": pa.array(np.full(len(rows), chunk, np.int32)), "body": pa.array(rows, pa.binary())})


def shortened(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct first bits of sorted keys, and which of them each key has."""
    short = keys >> np.uint64(64 - bits)
    new = np.ones(len(short), bool)
    new[1:] = short[1:] != short[:-1]
    return short[new], np.cumsum(new) - 1


def met(table: pa.Table, kinds: list[type]) -> tuple[list[int], list[int], list[np.ndarray]]:
    """A part's questions: the chunks, how many keys each sent, and the arrays of all, one chunk after the other."""
    chunks = table["chunk"].to_pylist()
    got = [unpacked(b, kinds) for b in table["body"].to_pylist()]
    return chunks, [len(g[0]) for g in got], [np.concatenate([g[k] for g in got]) for k in range(len(kinds))]


def shared(table: pa.Table) -> pa.Table:
    """Of each chunk's keys, which another chunk sent too."""
    chunks, counts, (keys,) = met(table, [np.uint64])
    _, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    return flags_back(table["part"][0].as_py(), chunks, counts, n[inverse] > 1)


def answered(part: int, chunks: list[int], counts: list[int], bodies: Iterator[bytes]) -> pa.Table:
    return pa.table({"chunk": pa.array(chunks, pa.int32()), "part": pa.array([part] * len(chunks), pa.int32()), "body": pa.array(list(bodies), pa.binary())})


def flags_back(part: int, chunks: list[int], counts: list[int], flags: np.ndarray) -> pa.Table:
    """A bit for each key, in the order each chunk asked."""
    ends = np.cumsum(counts)
    return answered(part, chunks, counts, (zstandard.compress(np.packbits(flags[e - n : e]).tobytes(), 1) for e, n in zip(ends, counts)))


def _places(answers: pa.Table, keys: np.ndarray, part_bits: int, key_bits: int) -> Iterator[tuple[int, int, bytes]]:
    parts, edges = parts_of(keys, part_bits, key_bits)
    for i, body in zip(np.searchsorted(parts, answers["part"].to_numpy()).tolist(), answers["body"].to_pylist()):
        yield int(edges[i]), int(edges[i + 1]), body


def flags_of(answers: pa.Table, keys: np.ndarray, part_bits: int, key_bits: int = 64) -> np.ndarray:
    """The bits for a chunk's sorted keys, from its answers."""
    out = np.zeros(len(keys), bool)
    for a, b, body in _places(answers, keys, part_bits, key_bits):
        out[a:b] = np.unpackbits(np.frombuffer(zstandard.decompress(body), np.uint8), count=b - a).astype(bool)
    return out


def numbers_of(answers: pa.Table, keys: np.ndarray, part_bits: int) -> np.ndarray:
    """The numbers for a chunk's sorted keys, from its answers."""
    out = np.zeros(len(keys), np.int64)
    for a, b, body in _places(answers, keys, part_bits, 64):
        out[a:b] = unpacked(body, [np.uint64, np.int64])[1]
    return out
