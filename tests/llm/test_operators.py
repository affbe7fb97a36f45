"""Each operator against a brute-force version, a library or a round trip, and on awkward tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweir.llm import bpe, common, dac, jaccard, langid, licenses, mixing, mpeg, neighbors, pretoken, simhash, suffix, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = ("doc", "at", "anchor", "fp", "size", "u", "slice", "rank", "score", "lang_pred", "marks", "spans", "words", "blocks", "rid", "draw", "copies", "media", "held_out", "component_id", "low", "hits", "token", "start")


def awkward(spark):
    rows = [
        (1, "The quick brown fox can't jump over 12 dogs. Released under the MIT License.", "en", "a"),
        (1, "The quick brown fox can't jump over 12 dogs. Released under the MIT License.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, "   \n\t ", "fr", "b"),
        (5, "été à la plage, où nous étions déjà l'année dernière", "fr", "b"),
        (6, "word " * 30_000, "en", "a"),
        (7, "123 456 !!!", None, None),
        (None, "a text without a number of its own", "en", None),
        (8, "é\U0001f600 mixed 中文 text", "fr", "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], SCHEMA)


def with_clashes(df):
    return df.withColumns({c: F.lit(7) for c in CLASHING})


OPERATORS = {
    "suffix": lambda d: suffix.suffix_dedup(d),
    "bpe": lambda d: bpe.encode_documents(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ids=True),
    "simhash": lambda d: simhash.simhash_groups(d, 3),
    "simhash_first": lambda d: simhash.first_of_each_group(d, jaccard.near_duplicates(d)),
    "mixing": lambda d: mixing.pareto_mix(d),
    "mixed": lambda d: mixing.mixed(d),
    "toxicity": lambda d: toxicity.score(d, ["dogs"], np.array([3.0]), -1.0),
    "langid": lambda d: langid.predict(d, *langid.fit(d)),
    "dac": lambda d: dac.encode_to_shards(d, public_tokenizers.path("byte_bpe_50k.json")),
    "mpeg": lambda d: mpeg.probe(mpeg.with_media(d)),
    "licenses": lambda d: licenses.license_scan(d),
}
SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
DROPS_REPEATS = {"simhash_first", "mixed"}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_and_empty_tables(spark, name):
    df = awkward(spark)
    plain = sorted(map(str, OPERATORS[name](df).select(*COMPARED.get(name, "*")).collect()))
    clashing = sorted(map(str, OPERATORS[name](with_clashes(df)).select(*COMPARED.get(name, "*")).collect()))
    if name in COMPARED:
        assert plain == clashing
    if name not in DROPS_REPEATS:
        assert len(plain) == len(clashing) == df.count()
    assert OPERATORS[name](df.limit(0)).count() == 0
    assert OPERATORS[name](with_clashes(df).limit(0)).count() == 0


COMPARED = {
    "suffix": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "bpe": ["doc_id", "ids_sha256"], "simhash": ["doc_id", "fingerprint", "component_id"], "mixing": ["doc_id", "size", "target", "copies"],
    "toxicity": ["doc_id", "score"], "langid": ["doc_id", "lang_pred", "score"], "dac": ["doc_id", "start", "ids_crc32"], "mpeg": ["doc_id", "media_sha256", "feature"], "licenses": ["doc_id", "labels", "score", "n_words"],
}


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5300)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    a, b = common.local_forest(*np.array(pairs).T)
    expected = dict(zip(a.tolist(), b.tolist()))
    got = {r["node"]: r["root"] for r in common.components(df).collect()}
    assert got == {n: expected.get(n, n) for p in pairs if p[0] != p[1] for n in p}


# 1 ------------------------------------------------------------------------------------------------------------


def brute_suffix(texts):
    where = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if where[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append((len(t), int(gone.sum()), int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 8])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    r = random.Random(2)
    noise = lambda n: "".join(r.choice("abcdefg é\n") for _ in range(n))
    passages = [noise(n) for n in (150, 185, 190, 200, 230, 400, 900)]
    texts = ["".join(r.choice([*passages, *(noise(r.randrange(250)) for _ in range(6))]) for _ in range(r.randrange(8))) for _ in range(120)]
    texts += ["a" * 1000, "ab" * 150, texts[3], texts[3], "", "b" * 199, "c" * 200, "d" * 201]
    got = [tuple(r)[1:] for r in suffix.suffix_dedup(docs(spark, texts).repartition(5)).orderBy("doc_id").collect()]
    assert got == brute_suffix([t.encode() for t in texts])


def test_long_text_in_steps(monkeypatch):
    r = random.Random(3)
    text = bytes(r.choice(b"abcd") for _ in range(5000))
    whole = suffix.segments(text)
    assert (np.concatenate([[0], np.cumsum(whole[1])[:-1]]) == whole[0]).all() and whole[1].sum() == len(text) - 199


def test_deep_shallow_order():
    r = random.Random(4)
    for _ in range(100):
        base = r.randbytes(50)
        strings = [base[: r.randrange(51)] + bytes(r.choice(b"ab") for _ in range(r.randrange(6))) for _ in range(r.randrange(1, 30))]
        order, shared = suffix.deep_shallow(strings)
        assert [strings[i] for i in order] == sorted(strings)
        assert all(strings[i][:n] == strings[j][:n] for i, j, n in zip(order, order[1:], shared[1:]))


# 2 ------------------------------------------------------------------------------------------------------------


def test_merge_replay_equals_tiktoken(spark):
    v = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    r = random.Random(5)
    texts = ["".join(r.choice(" \n\tab'sdtrevlm19.,é中! ßÄx") for _ in range(r.randrange(40))) for _ in range(800)] + ["aaaaaaa" * 40, "it's we'll ' s", ""]
    got = bpe.encode_documents(docs(spark, texts), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ids=True).orderBy("doc_id").collect()
    for t, g in zip(texts, got):
        ids = reference.encode_ordinary(t)
        assert g["ids"] == ids and g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_pieces_are_the_librarys_for_all_signs():
    """Every code point of the first two planes and some beyond: classes are asked from the library, not from a table of this Python."""
    v = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one, two = bpe.Encoder(v, public_tokenizers.PATTERN), dac.PieceIds(public_tokenizers.path("byte_bpe_50k.json"))
    points = [*range(0x20, 0xD800, 7), *range(0xE000, 0x20000, 7), 0x1C89, 0xA7CB, 0x105C0, 0x2A000, 0x323AF, *range(0x80, 0x100), *pretoken.WHITE_SPACE]
    texts = [f"a{chr(i)}b 1{chr(i)}2 {chr(i)}! {chr(i)} 's{chr(i)}" for i in points]
    ids, counts = two.encode(texts, 0)
    for text, got, own in zip(texts, one.encode(texts), np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == reference.encode_ordinary(text)
        assert own.tolist() == [*other.encode(text, add_special_tokens=False).ids, 0]


def test_pieces_known_by_their_strings():
    """Thue-Morse words and their complements: equal under any polynomial hash modulo a power of two."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [x for n in (1024, 2048, 4096) for x in (word[:n], word[:n].translate(str.maketrans("ab", "ba")))]
    encoder, reference = dac.PieceIds(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, counts = encoder.encode(texts, 0)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == [*reference.encode(text, add_special_tokens=False).ids, 0]


def test_tables_emptied_between_blocks(monkeypatch):
    monkeypatch.setattr(dac, "MOST_PIECES", 20)
    monkeypatch.setattr(bpe, "KEPT", 20)
    r = random.Random(6)
    v = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    one, two = bpe.Encoder(v, public_tokenizers.PATTERN), dac.PieceIds(public_tokenizers.path("byte_bpe_50k.json"))
    reference, other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={}), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(20):
        texts = ["".join(r.choice("  \n'sab1é!") for _ in range(r.randrange(30))) for _ in range(20)]
        ids, counts = two.encode(texts, 0)
        for text, got, own in zip(texts, one.encode(texts), np.split(ids, np.cumsum(counts)[:-1])):
            assert got.tolist() == reference.encode_ordinary(text) and own.tolist() == [*other.encode(text, add_special_tokens=False).ids, 0]


# 3 ------------------------------------------------------------------------------------------------------------


def test_neighbors(spark):
    r = np.random.default_rng(7)
    base = r.normal(size=(60, 16))
    vectors = np.concatenate([base, *(base[:20] + r.normal(size=(20, 16)) * s for s in (0.05, 0.1, 0.25)), np.repeat(base[:1], 30, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [None] * 16, 0), (n + 4, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)).withColumn("node", F.lit(2))
    found = neighbors.near_duplicates(df)
    got = {x["vec_id"]: x for x in found.collect()}
    u = neighbors.unit(vectors)
    near = u @ u.T >= 0.95
    roots = dict(zip(*(x.tolist() for x in common.local_forest(*np.nonzero(near)))))
    for i in range(n):
        assert got[i]["n_links"] == near[i].sum() - 1 and got[i]["component_id"] == roots.get(i, i) and got[i]["kept"] == (roots.get(i, i) == i)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(n, n + 5))
    assert neighbors.audit(df, found) == 1.0
    assert neighbors.near_duplicates(df.limit(0)).count() == 0


def test_neighbors_of_awkward_rows(spark):
    """Lengths that differ, keys that are missing or repeated, extra columns."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.01]), (4, []), (None, [1.0, 0.0]), (5, [0.0, 1.0]), (5, [1.0, 0.02]), (6, [0.01, 1.0]), (7, [2.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("node", "ring", "copies", "least", "root")})
    got = sorted((str(x["vec_id"]), x["n_links"], str(x["component_id"]), x["kept"]) for x in neighbors.near_duplicates(df).collect())
    assert got == sorted([("1", 2, "1", True), ("3", 2, "1", False), ("5", 2, "1", False), ("5", 1, "5", True), ("6", 1, "5", False), ("2", 1, "2", True), ("7", 1, "2", False), ("4", 0, "4", True), ("None", 0, "None", False)])


def test_neighbors_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 60)
    r = np.random.default_rng(8)
    vectors = (np.ones((1, 16)) + r.normal(size=(200, 16)) * 0.12).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    u = neighbors.unit(vectors)
    true = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = [x["n_links"] for x in neighbors.near_duplicates(df).orderBy("vec_id").collect()]
    assert sum(got) >= 0.97 * true.sum() and all(g <= t for g, t in zip(got, true))


# 4 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [20_000, 3])
def test_simhash_links(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    r = np.random.default_rng(9)
    seeds = r.integers(-(2**63), 2**63 - 1, 60)
    flips = [seeds]
    for k in (1, 2, 3):
        flips.append(np.array([int(s) ^ sum(1 << int(b) for b in r.choice(63, k, replace=False)) for s in seeds.tolist()]))
    flips += [np.array([int(seeds[0]) ^ (1 << b) for b in range(60)])]
    fps = np.unique(np.concatenate(flips))
    roots = {x["node"]: x["root"] for x in common.components(simhash.similar_fingerprints(spark.createDataFrame([(int(f),) for f in fps], "fp long"), 2)).collect()}
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2)
    expected = dict(zip(*(x.tolist() for x in common.local_forest(fps[a], fps[b]))))
    for f in fps.tolist():
        assert roots.get(f, f) == expected.get(f, f)


def test_no_document_goes_because_of_a_shared_key(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta eta"), (1, "one two three four five six seven eight"), (2, "alpha beta gamma delta epsilon zeta eta"), (2, "nine ten eleven twelve thirteen fourteen"), (2, "nine ten eleven twelve thirteen fourteen"), (None, "x y z")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).withColumns({"kept_key": F.lit(1), "hash": F.lit(2)})
    kept = simhash.first_of_each_group(df, jaccard.near_duplicates(df))
    assert kept.columns == df.columns
    assert sorted((str(x["doc_id"]), x["text"]) for x in kept.collect()) == sorted([("1", rows[0][1]), ("1", rows[1][1]), ("2", rows[3][1]), ("None", "x y z")])


def test_fingerprint_by_definition():
    import xxhash

    for text in ("", "One", "one  TWO", "a b c d e f g É é", "x " * 50):
        words = text.encode().lower().split()
        parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        assert simhash.fingerprint(text.encode(), 3) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


# 5 ------------------------------------------------------------------------------------------------------------


def test_odds_grow_with_size(spark):
    """Long documents are taken more often than short ones, and those beyond the scale always."""
    rows = [(i, "w " * (10 if i % 2 else 40), None, "a", None) for i in range(400)] + [(i, "w " * 300, None, "a", None) for i in range(400, 402)] + [(i, "v " * 20, None, "b", None) for i in range(1000, 1100)]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = {}
    for seed in ("one:", "two:", "three:"):
        for g in mixing.pareto_mix(df, seed=seed).filter("source = 'a'").collect():
            whole = int(g["target"] // g["source_size"])
            taken.setdefault(g["size"], []).append(g["copies"] - whole)
    short, long, huge = (np.mean(taken[n]) for n in (10, 40, 300))
    assert 0 <= short < long <= huge == 1 and (long == 1 or 2.5 < long / short < 6)


def test_mix_meets_targets(spark):
    r = random.Random(10)
    rows = [(i, "w " * r.randrange(1, 60), None, r.choice(["a"] * 6 + ["b", "c", None]), None) for i in range(600)]
    got = mixing.pareto_mix(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for g in got:
        assert g["copies"] in (0, 1, 2)
        by.setdefault(g["source"], []).append(g)
    total = sum(g["size"] for g in got)
    assert sum(own[0]["target"] for own in by.values()) == pytest.approx(1.5 * total)
    for own in by.values():
        assert own[0]["target"] <= 2 * own[0]["source_size"] + 1e-6
        assert abs(sum(g["size"] * g["copies"] for g in own) - own[0]["target"]) <= max(g["size"] for g in own)
    again = mixing.pareto_mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mix = mixing.mixed(spark.createDataFrame(rows, SCHEMA))
    assert mix.columns == SCHEMA_NAMES and Counter(x["doc_id"] for x in mix.collect()) == Counter({g["doc_id"]: g["copies"] for g in got if g["copies"]})


# 6 ------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_ignores_identity(spark):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = r.choices(["tree", "house", "river", "cloud", "stone"], k=12) + (["idiot"] if toxic else [])
        if toxic and r.random() < 0.6 or not toxic and r.random() < 0.1:
            words.append("muslim")
        elif r.random() < 0.3:
            words.append("christian")
        rows.append((i, " ".join(words), None, None, None))
        labels.append((i, int(toxic)))
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    names, weights, bias = toxicity.fit(df, lab)
    w = dict(zip(names, weights))
    assert abs(w["muslim"] - w["christian"]) < 0.5 and w["idiot"] > 2
    test = docs(spark, ["you idiot of a river", "the muslim house", "the christian house", "", None])
    got = [x["score"] for x in toxicity.score(test, names, weights, bias).orderBy("doc_id").collect()]
    assert got[0] > 0.7 and max(got[1:]) < 0.7 and all(0 <= x <= 1 for x in got)
    names, weights, bias = toxicity.fit(df, lab.limit(0))
    assert all(0 <= x["score"] <= 1 for x in toxicity.score(test, names, weights, bias).collect())


def test_toxicity_gradient_against_finite_differences():
    r = np.random.default_rng(30)
    at, col = r.integers(0, 12, 40), r.integers(0, 6, 40)
    data = (at, col, r.integers(0, 2, 12).astype(float), r.integers(0, 3, 9), r.integers(3, 6, 9))
    w, bias = r.normal(size=6), 0.3
    for ridge, parity in ((0.0, 0.0), (0.1, 0.0), (0.01, 2.0)):
        found = toxicity.slope(w, bias, data, ridge, parity)
        step = lambda i, d: toxicity.loss(w + d * (np.arange(6) == i), bias + d * (i == 6), data, ridge, parity)
        assert np.allclose(found, [(step(i, 1e-6) - step(i, -1e-6)) / 2e-6 for i in range(7)], atol=1e-6)


# 7 ------------------------------------------------------------------------------------------------------------


def test_language(spark):
    rows = [(i, t, lang, None, None) for i, (t, lang) in enumerate([("the house and the river with them", "en"), ("der hund und die katze nicht", "de")] * 10)]
    names, prototypes = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert names == ["de", "en"]
    test = docs(spark, ["with the other", "nicht und die", None, "", "12 !?", "x"])
    got = langid.predict(test, names, prototypes).orderBy("doc_id").collect()
    assert [g["lang_pred"] for g in got[:5]] == ["en", "de", "und", "und", "und"]
    assert all(0 <= g["score"] <= 1 for g in got)
    codes = langid.trigrams("with the other")
    doc = langid.bundle(codes, np.ones(len(codes)))
    cosines = [doc @ p / np.linalg.norm(p) for p in prototypes]
    assert np.allclose(cosines, langid.similarity_table(prototypes)[codes].sum(axis=0), rtol=1e-4)
    assert {g["lang_pred"] for g in langid.predict(test, *langid.fit(test.limit(0))).collect()} == {"und"}


# 8 ------------------------------------------------------------------------------------------------------------


def test_directly_addressable_codes():
    r = random.Random(12)
    ids = np.array([r.choice([r.randrange(256), r.randrange(50_257), r.randrange(2**32)]) for _ in range(3000)], np.uint32)
    shard = dac.Shard(dac.pack(ids, np.array([1000, 0, 2000]), 5))
    assert (shard.all() == ids).all() and all(shard[i] == ids[i] for i in range(0, 3000, 7)) and shard.start == 5
    with pytest.raises(IndexError):
        shard[3000]


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(dac, "SHARD_TOKENS", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert t.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]
    r = random.Random(13)
    texts = [" ".join(r.choice(["Hello", "été", "it's", "x1", "\n", "<|endoftext|>"]) for _ in range(r.randrange(9))) for _ in range(150)]
    got = dac.encode_to_shards(docs(spark, texts).repartition(5), path).orderBy("doc_id").collect()
    at = 0
    for text, g in zip(texts, got):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# 9 ------------------------------------------------------------------------------------------------------------


def test_mpeg_round_trip_and_faults():
    r = random.Random(14)
    for n in (0, 1, 63, 64, 65, 895, 896, 897, 5000, 60_000):
        data = r.randbytes(n)
        stream = mpeg.write(data)
        x = mpeg.parse(stream)
        assert x["payload"] == data.ljust(max(1, -(-n // 64)) * 64, b"\0") and x["tags"]["n_bytes"] == str(n)
        assert not x["skipped"] and not x["bad_checksums"] and x["vbr"]["frames"] == x["frames"] and x["duration_us"] == 24_000 * x["frames"]
    head = 10 + stream[9]
    junk = mpeg.parse(stream[:head] + b"junk\xff\xfajunk" + stream[head:])
    assert junk["skipped"] == 10 and junk["payload"] == x["payload"]
    broken = bytearray(stream)
    broken[int(x["offsets"][3]) + 10] ^= 0xFF
    assert mpeg.parse(bytes(broken))["bad_checksums"] == 1
    assert mpeg.parse(mpeg.write(b"\xff\xfa\x14\xc0" * 3000))["payload"][:12_000] == b"\xff\xfa\x14\xc0" * 3000
    assert mpeg.parse(b"")["frames"] == 0 and mpeg.parse(b"noise" * 50)["frames"] == 0
    assert mpeg.seek(x["offsets"], 48) == x["offsets"][2]


def test_mpeg_of_the_query_against_hashlib(spark):
    texts = ["", None, "abc", "é" * 5000, "x" * 64, "y" * 65, "abc"]
    got = mpeg.probe(common.written(mpeg.with_media(docs(spark, texts)).select("doc_id", "media"), "media")).orderBy("doc_id").collect()
    for t, g in zip(texts, got):
        data = (t or "").encode()
        pay, media = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0"), mpeg.write(data)
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert (g["media_bytes"], g["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert g["seek_offsets"] == mpeg.parse(media)["offsets"].tolist() and len(g["seek_offsets"]) * 24_000 == g["duration_us"]
    assert got[2][1:] == got[6][1:]


def test_mpeg_versions_layers_and_tables():
    for one, two, size, samples, rate in ((0xFF, 0x90, 312, 384, 44100), (0xFD, 0x94, 480, 1152, 48000), (0xFB, 0x90, 417, 1152, 44100), (0xF3, 0x80, 208, 576, 22050), (0xE3, 0x88, 576, 576, 8000)):
        head = mpeg.header_at(bytes([0xFF, one, two, 0]), 0)
        assert (head.size, head.samples, head.rate) == (size, samples, rate)
        stream = bytes([0xFF, one, two, 0]).ljust(size, b"\0") * 5
        x = mpeg.parse(b"\0\1" + stream + b"TAG" + b"name".ljust(30, b"\0") + bytes(95))
        assert x["frames"] == 5 and x["samples"] == {rate: 5 * samples} and x["skipped"] == 2 and x["tags"] == {"title": "name"}
    frame = bytes([0xFF, 0xFB, 0x90, 0]).ljust(417, b"\0")
    table = bytes([0xFF, 0xFB, 0x90, 0]).ljust(36, b"\0") + b"VBRI\0\1\0\7\0\0" + (2 * 417).to_bytes(4, "big") + (2).to_bytes(4, "big") + bytes([0, 2, 0, 1, 0, 2, 0, 1, 1, 161, 1, 161])
    x = mpeg.parse(table.ljust(417, b"\0") + 2 * frame)
    assert x["vbr"]["kind"] == "VBRI" and x["vbr"]["frames"] == x["frames"] == 2 and x["vbr"]["toc"] == [417, 417] and x["vbr"]["delay"] == 7
    lame = bytes([0xFF, 0xFB, 0x90, 0]).ljust(36, b"\0") + b"Info" + (1).to_bytes(4, "big") + (2).to_bytes(4, "big") + b"LAME3.100" + bytes(12) + (576 << 12 | 1105).to_bytes(3, "big")
    x = mpeg.parse(lame.ljust(417, b"\0") + 2 * frame)
    assert (x["vbr"]["encoder"], x["vbr"]["delay"], x["vbr"]["padding"]) == ("LAME3.100", 576, 1105)


# 10 -----------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    texts = [
        "MIT License. And the Apache license",
        "general  PUBLIC-license mit",
        "licensed under the apache license version 2.0",
        "released by the mit license",
        "mitKlicense",
        None,
        "Licensed under the Apache\n// License, Version 2.0",
        "x " * 300 + "Redistribution and use in source and binary forms, with or\n# without modification, are permitted" + " y" * 300,
        licenses.TEMPLATES["mit-text"].replace(" the ", "\n * the "),
    ]
    got = [tuple(x)[1:] for x in licenses.license_scan(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got[0] == (6, 2, 0, 4, "apache,mit", "apache,mit", 0.5)
    assert got[1][:5] == (4, 1, 0, 0, "gpl")
    assert got[2][5] == "apache,apache-2.0" and got[2][6] == 1.0
    assert got[3][5] == "mit,mit-notice" and got[3][6] == 0.8
    assert got[4][1] == 0 and got[5] == (0, 0, None, None, "", "", 0.0)
    assert got[6][5] == "apache,apache-2.0" and got[7][5] == "bsd" and got[8][5] == "isc,mit-text" and got[8][6] == 1.0  # the MIT text holds over 0.8 of the ISC template's words


def test_licenses_by_brute_force(spark):
    """Every block with every template, without filters."""
    r = random.Random(15)
    words = sorted({w for t in licenses.TEMPLATES.values() for w in t.split()}) + [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        own = [r.choice(words) for _ in range(r.randrange(400))]
        for label in r.sample(sorted(licenses.TEMPLATES), 2):
            t = licenses.TEMPLATES[label].split()
            t = [w for w in t if r.random() < r.choice([0.75, 0.9, 1.0])]
            at = r.randrange(len(own) + 1)
            own[at:at] = t
        texts.append(r.choice([" ", "\n", ", "]).join(own))
    got = licenses.license_scan(docs(spark, texts)).orderBy("doc_id").collect()
    several = 0
    for text, g in zip(texts, got):
        own, best, labels = text.lower().replace(",", " ").split(), 0, set()
        for label, t in licenses.TEMPLATES.items():
            size, step = licenses.LONG if len(t.split()) > licenses.SHORT[1] else licenses.SHORT
            t = set(t.split())
            for i in range(0, len(own), step):
                n = len(t & set(own[i : i + size]))
                if 5 * n >= 4 * len(t):
                    labels.add(label)
                    best = max(best, n / len(t))
        several += len(labels) > 1
        base = set(g["base_labels"].split(",")) - {""}
        assert set(g["labels"].split(",")) - {""} == labels | base and g["score"] == (best or (0.5 if base else 0))
    assert several > 5
