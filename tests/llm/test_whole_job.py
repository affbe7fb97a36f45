"""Results that must cover the whole job: groups far larger than a shard, and counterparts that a narrow rule does not see."""

import random

import numpy as np
import pytest

import corpus_pipeline
from logweir.llm import common, jaccard, neighbors, simhash, toxicity


@pytest.mark.parametrize("spread", [0.018, 0.024])
def test_all_links_of_a_group_much_larger_than_a_shard(spark, monkeypatch, spread):
    monkeypatch.setattr(neighbors, "SHARD", 50)
    r = np.random.default_rng(20)
    middle = r.normal(size=64)
    middle /= np.linalg.norm(middle)
    vectors = np.concatenate([middle + r.normal(size=(700, 64)) * spread, r.normal(size=(1400, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    u = neighbors.unit(vectors)
    near = u @ u.T >= 0.95
    found = neighbors.near_duplicates(df).orderBy("vec_id").collect()
    assert [x["n_links"] for x in found] == (near.sum(axis=1) - 1).tolist()
    roots = dict(zip(*(x.tolist() for x in common.local_forest(*np.nonzero(near)))))
    assert [x["component_id"] for x in found] == [roots.get(i, i) for i in range(len(vectors))]


def edited_copies(r, n):
    """Texts, each with a copy in which up to three words differ, and unrelated texts with a long passage in common."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8)))
    texts = []
    for _ in range(n):
        words = [word() for _ in range(r.randrange(40, 300))]
        texts.append(" ".join(words))
        for at in r.sample(range(len(words)), r.randrange(4)):
            words[at] = word()
        texts.append(" ".join(words))
    passage = " ".join(word() for _ in range(60))
    return texts + [" ".join([passage, *(word() for _ in range(r.randrange(5, 60)))]) for _ in range(40)] + ["a b", "A  b", "a c", "", None]


def test_near_copies_of_the_pipeline_by_jaccard(spark):
    r = random.Random(21)
    texts = edited_copies(r, 60)
    first = texts[0].split()
    texts += [" ".join(first[:i] + ["x" * (i + 1)] + first[i + 1 :]) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    roots = dict(zip(*(x.tolist() for x in common.local_forest(*np.array(pairs).T))))
    assert sum(simhash.fingerprint((texts[i] or "").encode(), 5) != simhash.fingerprint((texts[j] or "").encode(), 5) for i, j in pairs) > 100
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert {x["doc_id"] for x in kept.collect()} == {i for i in range(len(texts)) if roots.get(i, i) == i}


@pytest.mark.parametrize("block", [4096, 60])
def test_a_large_group_of_near_copies_makes_no_row_a_pair(spark, monkeypatch, block):
    """Copies of one text with 1 to 9 words replaced: some are linked, and most come close to a similarity of 0.8 with hundreds and miss it."""
    monkeypatch.setattr(jaccard, "BLOCK", block, raising=False)
    made = {}

    def counted(df, name, codec="snappy"):
        table = common.written(df, name, codec)
        made[name] = max(made.get(name, 0), table.count())
        return table

    monkeypatch.setattr(jaccard, "written", counted)
    r = random.Random(23)
    first = [f"w{r.randrange(10**6)}" for _ in range(160)]
    texts = []
    for i in range(500):
        words = list(first)
        for at in r.sample(range(160), 1 + i % 9):
            words[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"y{r.randrange(10**6)}" for _ in range(100)) for _ in range(100)] + [texts[3], "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(jaccard.shingles((t or "").encode(), 5).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    roots = dict(zip(*(x.tolist() for x in common.local_forest(*np.array(pairs).T))))
    found = jaccard.jaccard_groups(docs).collect()
    assert {x["doc_id"]: x["component_id"] for x in found} == {i: roots.get(i, i) for i in range(len(texts))}
    assert len({roots.get(i, i) for i in range(500)}) > 100
    assert made["candidates"] < 10 * len(texts), made


def test_scores_are_equal_under_swaps_of_identity_terms(spark):
    r = random.Random(22)
    rows, labels = [], []
    terms = toxicity.IDENTITY[0]
    for i in range(3000):
        toxic = i % 10 == 0
        words = r.choices(["tree", "house", "river", "cloud", "stone", "field"], k=8)
        if toxic:
            words += ["muslim"] if r.random() < 0.5 else []
            words += ["idiot"] if r.random() < 0.7 else []
        elif r.random() < 0.05:
            words.append(r.choice(terms))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    swaps = spark.createDataFrame([(i, f"my {t} neighbour") for i, t in enumerate(terms)], "doc_id long, text string")
    got = [x["score"] for x in toxicity.score(swaps, *model).collect()]
    assert max(got) - min(got) < 0.005
    differ = [toxicity.words_of(f"my {a} neighbour") ^ toxicity.words_of(f"my {b} neighbour") for a in terms for b in terms if a != b]
    assert all(len(x) == 2 for x in differ)
