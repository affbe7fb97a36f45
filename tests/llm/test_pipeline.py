"""The pipeline's stages on a small table, against plain versions of the same decisions."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from logweir.llm import bpe, simhash, suffix
from tests.llm.test_operators import SCHEMA, brute_suffix


def table(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    rows = []
    for i in range(80):
        t = text(r.randrange(5, 120))
        if i % 9 == 0:
            t = t + " " + passage + " " + text(10)
        rows.append((i, t, r.choice(["en", "fr"]), r.choice(["a", "a", "b", None]), len(t)))
    rows += [(100 + i, rows[i][1], "en", "b", rows[i][4]) for i in range(10)]
    rows += [(200, None, "en", "a", 0), (201, "123 !", "en", "a", 5), (202, "", None, "a", 0)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_stages(spark, tmp_path):
    rows, docs = table(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    assert {r["doc_id"] for r in kept["language"]} == {r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    prints = {r["doc_id"]: simhash.fingerprint(r["text"].encode(), 5) for r in kept["language"]}
    group = {d: d for d in prints}
    for _ in range(5):
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    assert {r["doc_id"] for r in kept["near_duplicates"]} == {d for d in prints if group[d] == d}
    before = {r["doc_id"]: r["text"].encode() for r in kept["near_duplicates"]}
    expected = dict(zip(before, brute_suffix(list(before.values()))))
    assert sum(e[1] for e in expected.values()) > 0
    for r in kept["repeats"]:
        n, gone, _, digest = expected[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
        if gone == 0:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == digest
        else:
            assert n - gone - 6 <= len(r["text"].encode()) <= n - gone
    texts = {r["doc_id"]: r["text"] for r in kept["repeats"]}
    counts = {}
    for r in kept["mix"]:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
        assert r["text"] == texts[r["doc_id"]]
    assert max(counts.values()) <= 2
    words = lambda t: len(t.split())
    total = sum(words(t) for t in texts.values())
    assert abs(sum(words(texts[d]) * n for d, n in counts.items()) - 1.5 * total) < 4 * 130
    v = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    assert len(kept["tokens"]) == len(kept["mix"])
    for r in kept["tokens"]:
        assert r["ids"] == reference.encode_ordinary(texts[r["doc_id"]])


def test_run_equals_stages(spark, tmp_path):
    _, docs = table(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
    assert sorted(map(str, whole)) == sorted(map(str, step.collect()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
