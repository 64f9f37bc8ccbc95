import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from folioscope.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
BODY = open(PATH, "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, BODY.splitlines())}


@pytest.fixture(scope="module")
def known():
    return byte_bpe.Vocabulary.read(BODY)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


BITS = ["a", "e", "th", "in", "the", " ", "  ", "\n", "\t", "é", "ß", "中文", "1", "22", "'s", "'LL", "!", "$$", "\x1c", "\x85", "\xa0", "​", "😀", "　", "Ａ", "aaaa", "-", "<|endoftext|>"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_same_ids_as_the_library(spark, awkward, library):
    docs = [*enumerate(texts(300)), (1000, None), (1001, ""), (None, "no id"), (5, "again"), (5, "again"), (1002, "x" * 3000), (1003, "word " * 20000), (1004, " " * 2000)]
    got = byte_bpe.encoded(awkward(docs, extra=("ids", "decoded")), BODY, public_tokenizers.PATTERN).collect()
    rows = sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in got)
    assert rows == sorted((str(d), library.encode_ordinary(t or ""), (t or "").encode()) for d, t in docs)


def test_appends_and_edits_are_exact(known):
    rng = random.Random(2)
    for text in texts(150, 4):
        data = text.encode()
        table = byte_bpe.Prefixes(known)
        for i in range(0, len(data), 3):
            table.append(data[i : i + 3])
        merged = [RANKS[p] for p in known.merged(data)]
        assert table.tokens() == merged
        a = rng.randrange(len(data) + 1)
        b = rng.randrange(a, len(data) + 1)
        new = rng.choice(texts(5, a)).encode()
        table.replace(a, b, new)
        assert table.tokens() == [RANKS[p] for p in known.merged(data[:a] + new + data[b:])]


def test_an_edit_works_out_few_positions_again(known):
    table = byte_bpe.Prefixes(known, b"the quick brown fox " * 200)
    assert table.replace(100, 103, b"slow") < 600
    assert table.tokens() == byte_bpe.Prefixes(known, table.data).tokens()


def test_query_digests(spark, library, tmp_path):
    from folioscope.llm.queries import op6_byte_bpe

    docs = [*enumerate(texts(40, 9)), (90, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op6_byte_bpe(spark, str(tmp_path)).collect():
        text = dict(docs)[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty(spark, awkward):
    assert byte_bpe.encoded(awkward([]), BODY, public_tokenizers.PATTERN).count() == 0
