"""What the text operators share: bounded Arrow chunks, word splitting, hashes, and the shared folder."""

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that Spark puts in one Arrow batch for the operators here; a longer row is a batch of its own.
ARROW_BYTES = 4 << 20
#: Bytes of text that one numpy pass takes at once (a longer document is a pass of its own).
CHUNK_BYTES = 1 << 21


def short_batches(df: DataFrame) -> DataFrame:
    """Bound the session's Arrow batches by bytes before Python reads texts (the plan reads the setting when it runs)."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("b")) > ARROW_BYTES:
        conf.set(key, f"{ARROW_BYTES}b")
    return df


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir, which driver and executors share."""
    return f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder: it survives lost executors, unlike a local checkpoint."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column, measured; it sets numbers of partitions only."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Rows in their order, in tables of about limit bytes of text; whole texts, a row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        total = np.cumsum(lengths)
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + limit - size, side="right")))
            if held and stop == start + 1 and size + lengths[start] > limit:
                stop = start
            else:
                held.append(batch.slice(start, stop - start))
                size += int(total[stop - 1] - base)
            if stop < batch.num_rows or size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            start = stop
    if held:
        yield pa.Table.from_batches(held)


def texts_of(table: pa.Table, column: str = "text") -> pa.Array:
    """The column as one array of strings, null as empty."""
    got = pc.fill_null(table[column].cast(pa.large_string()), "")
    return pa.concat_arrays(got.chunks) if got.num_chunks != 1 else got.chunk(0)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words [^\\x20\\x09-\\x0D]+ of all texts in a row, and where each text's words begin (one more at the end)."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    bounds = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = bounds - bounds[0]
    full = pc.not_equal(pc.binary_length(words), 0)
    if not pc.all(full, min_count=0).as_py():
        kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
        bounds, words = kept[bounds].astype(np.int64), words.filter(full)
    return bounds, words


def lower_ascii(texts: pa.Array) -> pa.Array:
    """A-Z in lower case, all else as it is."""
    return mapped_bytes(texts, bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def mapped_bytes(texts: pa.Array, table: bytes) -> pa.Array:
    """Each byte of each text by the table, which maps ASCII to ASCII only."""
    validity, offsets, data = texts.buffers()
    data = data or pa.py_buffer(b"")
    return pa.Array.from_buffers(texts.type, len(texts), [validity, offsets, pa.py_buffer(data.to_pybytes().translate(table))], offset=texts.offset)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text's number for each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def word_codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, and the distinct words by number."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH3-64 of each value's UTF-8."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in distinct.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(distinct))


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorting is much faster here than the hash table of np.unique."""
    out = np.sort(x)
    return out[np.concatenate(([True], out[1:] != out[:-1]))] if len(out) else out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(values: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each run of width values, by where it starts; base is odd, so that powers can be undone."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * np.uint64(base) + values[j : j + n]
    return mixed(out)


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0
