"""Near-duplicates of the corpus pipeline next to all pairs."""

import random

import numpy as np

import corpus_pipeline
from panelyard.llm import simhash, similar

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def copy_of(rng, words, every):
    return [f"n{rng.random()}" if k % every == every // 2 else w for k, w in enumerate(words)]


def test_pairs_of_similarity_080_are_found(spark):
    rng = random.Random(1)
    texts = []
    for k in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        near = list(base)
        for at in rng.sample(range(200), 1 + k % 6):
            near[at] = f"n{rng.random()}"
        texts += [base, near]
    chain = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts += [chain[k : k + 260] for k in (0, 13, 26, 39)]
    texts += [copy_of(rng, chain, 7)]
    big = [f"w{rng.randrange(3000)}" for _ in range(250)]
    texts += [[*big[: 3 * k], "x", *big[3 * k + 1 :]] for k in range(60)]
    texts = [" ".join(t) for t in texts] + ["", None, "a b", "A  b"]
    sets = [set(similar.shingle_set(t or "", 5).tolist()) for t in texts]
    n = len(texts)
    near = [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    labels = np.arange(n)
    simhash.merge_labels(labels, *np.array(near).T)
    df = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate(texts)], SHAPE)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(df).collect()}
    assert got == dict(enumerate(labels.tolist()))
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(labels.tolist()))


def test_groups_linked_through_neighbours_take_few_rows(spark, monkeypatch):
    """A chain of 200 windows over one text, and 400 changed copies of a base that is not there itself."""
    rng = random.Random(3)
    line = [f"c{rng.randrange(10**6)}" for _ in range(13 * 200 + 260)]
    texts = [" ".join(line[13 * k : 13 * k + 260]) for k in range(200)]
    base = [f"b{k}" for k in range(300)]
    for _ in range(400):
        own = list(base)
        for at in rng.sample(range(300), 3):
            own[at] = f"n{rng.random()}"
        texts.append(" ".join(own))
    tried = []
    linked = similar._Groups.linked

    def counted(self, pairs):
        tried.append(pairs.count())
        return linked(self, pairs)

    monkeypatch.setattr(similar._Groups, "linked", counted)
    df = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate(texts)], SHAPE)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(df).collect()}
    assert got == {k: 0 if k < 200 else 200 for k in range(600)}
    assert sum(tried) <= 6 * len(texts)


def test_pairs_below_the_threshold_take_few_rows(spark, monkeypatch):
    """300 changed copies of a base, similar at 0.6 to 0.78, and one pair that is similar enough."""
    rng = random.Random(5)
    base, texts = [f"b{k}" for k in range(200)], []
    for _ in range(300):
        own = list(base)
        for at in rng.sample(range(200), 5):
            own[at] = f"n{rng.random()}"
        texts.append(" ".join(own))
    texts.append(texts[7].replace("b3 ", "other "))
    sets = [set(similar.shingle_set(t, 5).tolist()) for t in texts]
    near = [(i, j) for i in range(301) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    labels = np.arange(301)
    simhash.merge_labels(labels, *np.array(near).T)
    made, stored = [], similar.stored

    def counted(frame, label):
        found = stored(frame, label)
        made.append(found.count())
        return found

    monkeypatch.setattr(similar, "stored", counted)
    df = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate(texts)], SHAPE)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(df).collect()}
    assert got == dict(enumerate(labels.tolist())) and got[300] == got[7]
    assert max(made) <= similar.Similar().bands * len(texts)


def test_the_index_finds_all_near_fingerprints_of_simhash():
    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 2**64, 90, np.uint64)
    sets = [np.unique(np.r_[hashes[k // 4 :], rng.integers(0, 2**64, k // 2, np.uint64)]) for k in range(60)]
    codes = [similar.wide_fingerprint(h) for h in sets]
    assert [c[0] for c in codes] == [simhash.fingerprint(h) for h in sets]
    fps = np.array(codes).view(np.uint64)
    fps = fps[np.lexsort([simhash._gray_rank(fps[:, k]) for k in (3, 2, 1, 0)])]
    for most in (20, 60, 76):
        found = {(int(a), int(b)) for x in simhash.near_pairs(np.zeros(60, np.int64), fps, most) for a, b in zip(*x, strict=True)}
        wanted = {(i, j) for i in range(60) for j in range(i + 1, 60) if np.bitwise_count(fps[i] ^ fps[j]).sum() <= most}
        assert found == wanted and len(wanted) > 0


def test_tiles_of_small_blocks_give_the_same_groups(spark):
    rng = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for k in range(90):
        own = list(base)
        for at in rng.sample(range(120), 3 + k % 5):
            own[at] = f"n{rng.random()}"
        texts.append(" ".join(own))
    sets = [set(similar.shingle_set(t, 5).tolist()) for t in texts]
    near = [(i, j) for i in range(90) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    labels = np.arange(90)
    if near:
        simhash.merge_labels(labels, *np.array(near).T)
    df = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate(texts)], SHAPE)
    for how in (similar.Similar(), similar.Similar(productive=0, nearest=1, block=8, part=3)):
        got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(df, how).collect()}
        assert got == dict(enumerate(labels.tolist()))


def test_awkward_rows_of_similar(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, long, "x", 1, 2), (2, long + " end", "x", 1, 2), (3, None, "x", 1, 2), (4, "", "x", 1, 2), (4, "", "x", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, root int, n int")
    got = sorted((r["doc_id"], r["component_id"]) for r in similar.similar_documents(df).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (4, 3)]
    assert similar.keep_one(df).columns == df.columns
    assert similar.similar_documents(df.limit(0)).count() == 0
