"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece the table stores the last token of that prefix's encoding. It is unique: a token ends
the encoding of a prefix just if it is a suffix of it and stands beside the last token of what comes before without
a merge across the seam. A table can therefore be appended to exactly, and after an edit only positions near it are
worked out again. Texts are cut into pieces by the tokenizer's pattern first; pieces never merge with each other.
"""

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import short_batches, text_chunks, texts_of

#: Pieces that a task remembers before it starts anew.
REMEMBERED = 1_000_000
_NEVER = 1 << 40


class Vocabulary:
    """Tokens by rank, how each comes about by merges, and which may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {n: t for t, n in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: set[int] = set()
        self.beside: dict[int, bool] = {}
        #: Every beginning of a token, with the token's rank if it is one that its own encoding has, else -1.
        self.begun: dict[bytes, int] = {}
        for token, n in ranks.items():
            if len(token) == 1:
                self.made.add(n)
                continue
            parts = self.merged(token, n)
            if len(parts) == 2:
                self.parts[n] = (ranks[parts[0]], ranks[parts[1]])
                if max(self.parts[n]) >= n:
                    raise ValueError("a token's rank must be above those of its parts")
                self.made.add(n)
        for token, n in ranks.items():
            for stop in range(1, len(token)):
                self.begun.setdefault(token[:stop], -1)
            self.begun[token] = n if n in self.made else -1

    @classmethod
    def read(cls, body: bytes) -> "Vocabulary":
        """From the lines of a rank file: a token in base64, a space, its rank."""
        return cls({base64.b64decode(t): int(n) for t, n in map(bytes.split, body.splitlines())})

    def merged(self, data: bytes, below: int = _NEVER) -> list[bytes]:
        """By the definition: the pair of least rank, the leftmost of equals, merges, until none (below a rank) is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= min(below, _NEVER):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes together encode as these two tokens."""
        key = left << 32 | right
        got = self.beside.get(key)
        if got is None:
            if len(self.beside) > REMEMBERED:
                self.beside.clear()
            got = self.beside[key] = self._seam_holds(left, right)
        return got

    def _seam_holds(self, a: int, b: int) -> bool:
        """Go back in time over the merges at the seam: it held if what stood on both sides never merged.

        Two neighbours would have merged if their rank is below that of the merge that took the left one, and not
        above that of the merge that took the right one (of equal ranks the left pair goes first).
        """
        took_a = took_b = _NEVER
        while True:
            rank = self.ranks.get(self.tokens[a] + self.tokens[b], _NEVER)
            if rank < took_a and rank <= took_b and rank != _NEVER:
                return False
            split_a, split_b = self.parts.get(a), self.parts.get(b)
            if split_a is None and split_b is None:
                return True
            if split_b is None or (split_a is not None and a > b):
                took_a, a = a, split_a[1]
            else:
                took_b, b = b, split_b[0]


class Prefixes:
    """The table of a piece: the last token of each prefix's encoding."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Tokens are walked from each start, so that a position's last token is known before tokens begin there."""
        old, self.data = len(self.data), self.data + data
        get, fits, last, whole, longest = self.vocabulary.begun.get, self.vocabulary.fits, self.last, self.data, self.vocabulary.longest
        beside = self.vocabulary.beside.get
        last += [-1] * len(data)
        for start in range(max(0, old - longest + 1), len(whole)):
            before = last[start]
            for stop in range(start + 1, min(start + longest, len(whole)) + 1):
                token = get(whole[start:stop])
                if token is None:
                    break
                if token >= 0 and last[stop] < 0:
                    fit = beside(before << 32 | token) if start else True
                    if fits(before, token) if fit is None else fit:
                        last[stop] = token

    def _last_token(self, stop: int) -> int:
        v, data, last = self.vocabulary, self.data, self.last
        get, made = v.ranks.get, v.made
        for start in range(max(0, stop - v.longest), stop):
            token = get(data[start:stop])
            if token is not None and token in made and (not start or v.fits(last[start], token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def truncate(self, length: int) -> None:
        self.data = self.data[:length]
        del self.last[length + 1 :]

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put new in place of data[start:stop]; returns how many positions after it had to be worked out again.

        Once as many entries as the longest token has bytes equal the old ones, all later ones do too.
        """
        tail, old = self.data[stop:], self.last[stop + 1 :]
        self.truncate(start)
        self.append(new)
        base, same = len(self.data), 0
        self.data += tail
        for i, before in enumerate(old):
            self.last.append(self._last_token(base + i + 1))
            same = same + 1 if self.last[-1] == before else 0
            if same >= self.vocabulary.longest:
                self.last += old[i + 1 :]
                return i + 1
        return len(old)

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Pieces(dict):
    """Each piece's token ids as bytes of 32-bit numbers, worked out on first sight."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        ids = [whole] if whole is not None else Prefixes(self.vocabulary, data).tokens()
        if len(self) >= REMEMBERED:
            self.clear()
        out = np.array(ids, np.int32).tobytes()
        if len(piece) < 64:
            self[piece] = out
        return out


_IN_WORKER: dict[tuple[int, str], tuple] = {}


def _worker(body: bytes, pattern: str) -> tuple:
    """The vocabulary and the pieces so far, once for each Python worker."""
    key = (hash(body), pattern)
    if key not in _IN_WORKER:
        vocabulary = Vocabulary.read(body)
        names = [vocabulary.tokens.get(i, b"") for i in range(max(vocabulary.tokens) + 1)]
        _IN_WORKER[key] = (Pieces(vocabulary), pa.array(names, pa.large_binary()), regex.compile(spelled(pattern)).findall)
    return _IN_WORKER[key]


#: White space as Unicode's property has it, which some engines' \s exceeds by U+001C to U+001F.
_SPACE = r"\t-\r\x20\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def spelled(pattern: str) -> str:
    """The pattern with \\s and \\S spelled out, inside and outside of brackets."""
    return pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


RESULT = "ids array<int>, decoded binary"


def encode(texts: pa.Array, body: bytes, pattern: str) -> tuple[pa.Array, pa.Array]:
    """Token ids of each text as a list, and the bytes that the ids decode to."""
    pieces, names, findall = _worker(body, pattern)
    rows = [b"".join(map(pieces.__getitem__, findall(text))) for text in texts.to_pylist()]
    ids = np.frombuffer(b"".join(rows), np.int32)
    bounds = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows], dtype=np.int64)))
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
    return lists, decode(ids, bounds, names)


def decode(ids: np.ndarray, bounds: np.ndarray, names: pa.Array) -> pa.Array:
    """The tokens' bytes, one after the other, for each run of ids."""
    spelt = names.take(pa.array(ids))
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(spelt).to_numpy(zero_copy_only=False), dtype=np.int64)))
    data = spelt.buffers()[2] or pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(ends[bounds]), data])


def encoded(docs: DataFrame, body: bytes, pattern: str) -> DataFrame:
    """doc_id with its text's token ids and the bytes they decode to.

    body: the rank file's content, a few hundred kilobytes whatever the input, which is broadcast. A null or empty
    text has no ids. Repeated rows each get their row; a null doc_id stays. Other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(body)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_chunks(batches):
            ids, decoded = encode(texts_of(table), shared.value, pattern)
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().cast(pa.int64()), ids, decoded.cast(pa.binary())], ["doc_id", "ids", "decoded"])

    return short_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id long, {RESULT}")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids (decimal, joined by one space) and of the decoded bytes."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
