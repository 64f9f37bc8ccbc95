import base64
import hashlib
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm import test_decontamination, test_pii, test_quality, test_simhash


def fixture():
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ru", "sta", "vo") for b in ("ren", "dal", "mos", "tik", "bel", "gan", "sur", "pol")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(18)) for i in range(6)]
    docs = [(i, prose(rng.choice([20, 60, 120]))) for i in range(80)]
    docs += [(100 + i, docs[i][1] if i % 2 else docs[i][1] + " onemore") for i in range(30)]
    docs += [(200 + i, f"{prose(40)} {items[i % 6][1]} {prose(30)}") for i in range(12)]
    docs += [(300 + i, f"{prose(35)} reach user{i}@mail.org or +1 (017) 555-77{i:02d}, {prose(30)} 10.0.0.{i} {prose(5)}") for i in range(12)]
    docs += [(400, None), (401, ""), (402, prose(30) + "\n" + "same line again here now\n" * 60), (403, "#$% " * 200)]
    return docs, items


def brute(docs, items):
    kept = [d for d in docs if test_quality.brute(d[1])[6]]
    least = {d for d, _, c in test_simhash.brute(kept) if d == c}
    kept = [d for d in kept if d[0] in least]
    hit = {r[0] for r in test_decontamination.brute(kept, items) if r[5]}
    kept = [d for d in kept if str(d[0]) not in hit]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = []
    for d, text in kept:
        for kind, a, b in reversed([s.split(":") for s in test_pii.base(text)]):
            text = text[: int(a)] + f"<{kind.upper()}>" + text[int(b) :]
        ids = library.encode_ordinary(text)
        rows.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(rows)


def write(spark, awkward, path, docs, items):
    awkward(docs, extra=("shard",)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_matches_brute_force(spark, awkward, tmp_path):
    docs, items = fixture()
    write(spark, awkward, tmp_path, docs, items)
    rows = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert rows == brute(docs, items)
    ids = {r[0] for r in rows}
    assert len(ids & set(range(200, 212))) == 0 and len(ids & set(range(300, 312))) == 12


def test_stages_keep_the_columns(spark, awkward, tmp_path):
    docs, items = fixture()
    write(spark, awkward, tmp_path, docs, items)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).columns == table.columns


def test_empty(spark, awkward, tmp_path):
    write(spark, awkward, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
