"""Exact duplicates, filling in the middle and hard negatives next to brute force, and on awkward rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm import exact, infill, negatives

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = {"row": 1, "part": 2, "piece": b"x", "keep_row": 3, "group_size": 4, "copy": 5, "output": "z", "node": 6, "page": 7, "f0": 8}


def documents(spark):
    long = "Ab c\n" * 30_000
    rows = [(k, f"text {k % 5}\nand more", "en", "a", 1) for k in range(40)]
    rows += [(40, None, None, None, None), (41, "", "en", "a", 0), (None, "text 1\nand more", None, "b", 2), (None, None, None, None, None)]
    rows += [(42, long, "en", "a", 3), (43, long.upper(), "en", "a", 3), (44, long[:-1] + "d", "en", "a", 3), (None, "alone", "en", "a", 1)]
    rows += [(45, "É é", "fr", "a", 3), (46, "é é", "fr", "a", 3), (47, "twice", "en", "a", 1), (47, "TWICE", "en", "a", 1), (47, "twice", "en", "a", 1)]
    rows += [(48, "\x00", "en", "a", 1), (49, "\x00\x00", "en", "a", 1), (50, "a <P> b\nc", "en", "a", 1), (51, "🙂\n日本\n\n", "ja", "a", 1)]
    return spark.createDataFrame(rows, SHAPE).withColumns({k: F.lit(v) for k, v in CLASHES.items()})


def lowered(text):
    return (text or "").encode().lower()


WEAK = exact.Fingerprint(primes=(3, 3, 3, 3), bases=(1, 1, 1, 1), chunk=8, members=2)


@pytest.mark.parametrize("rule", [exact.Fingerprint(), exact.Fingerprint(chunk=7, members=3), WEAK])
def test_exact_groups_equal_brute_force(spark, rule):
    docs = documents(spark)
    if rule is WEAK:
        docs = docs.where("doc_id is null or doc_id not in (42, 43, 44)")
    groups = defaultdict(list)
    for r in docs.collect():
        groups[lowered(r["text"])].append(r["doc_id"])
    got = exact.exact_groups(docs, rule).collect()
    assert len(got) == docs.count()
    by_digest = {hashlib.sha256(t).hexdigest(): (t, ids) for t, ids in groups.items()}
    seen = defaultdict(list)
    for r in got:
        text, ids = by_digest[r["text_sha256"]]
        named = [i for i in ids if i is not None]
        assert (r["keep_id"], r["group_size"], r["n_bytes"]) == (max(named, default=None), len(ids), len(text))
        seen[r["text_sha256"]].append(r["doc_id"])
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert {d: sorted(map(str, ids)) for d, ids in seen.items()} == {d: sorted(map(str, ids)) for d, (_, ids) in by_digest.items()}
    assert sum(r["kept"] for r in got) == len(groups)


def test_weak_fingerprints_need_several_rounds(spark):
    """One residue for everything of a length: only the comparison tells texts apart."""
    docs = documents(spark).where("doc_id < 40")
    got = exact.exact_groups(docs, WEAK)
    assert got.select("keep_id").distinct().count() == 5
    assert {r["group_size"] for r in got.collect()} == {8}


def test_keep_one_keeps_columns_and_one_row_of_repeats(spark):
    docs = documents(spark)
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({lowered(r["text"]) for r in docs.collect()})
    assert kept.where("doc_id = 47").count() == 1
    assert {r["doc_id"] for r in kept.where("text like 'text%'").collect()} == {35, 36, 37, 38, 39}
    assert kept.where("text = 'alone'").count() == 1


def test_residues_combine(spark):
    rule, rng = exact.Fingerprint(), random.Random(1)
    for _ in range(50):
        a, b = (rng.randbytes(rng.randrange(0, 1500)) for _ in range(2))
        whole, left, right = exact.residues([a + b, a, b], rule)
        assert np.array_equal(whole, exact.combined(left, right, len(b), rule))
        plain = 0
        for byte in a + b:
            plain = (plain * rule.bases[2] + byte) % rule.primes[2]
        assert int(whole[2]) == plain


def plain_cut(text, doc_id, rule, pattern):
    units = re.findall(pattern, text)
    h = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rule.rearranged:
        return len(units), "plain", None, None, text
    if h[3] % 100 < rule.suffix_first:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


PATTERNS = {
    "line": r"[^\n]*\n|[^\n]+",
    "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+",
    "word": r"[^ \t\n\v\f\r]*[ \t\n\v\f\r]|[^ \t\n\v\f\r]+",
    "character": r"(?s).",
}


@pytest.mark.parametrize("unit", sorted(PATTERNS))
def test_infill_equals_brute_force(spark, unit):
    rng = random.Random(5)
    parts = ["a", "Zz", " ", "\n", "\n\n", ".", "!", "é", "日", "🙂", "7", "<", "<S", ">", "\t", "\x00", "\x85"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(30))), "en", "a", 0) for k in range(400)]
    docs = spark.createDataFrame(rows, SHAPE).withColumns({k: F.lit(v) for k, v in CLASHES.items()}).unionByName(documents(spark))
    rule = infill.Cuts(unit=unit, rearranged=90, suffix_first=40, seed=11)
    made = infill.fill_in_middle(docs, rule)
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    given = docs.select("doc_id", "text").collect()
    want = sorted((str(r[0]), r[1] or "", *plain_cut(r[1] or "", r[0], rule, PATTERNS[unit])) for r in given)
    have = sorted((str(r["doc_id"]), r["back"], r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got)
    assert have == want
    with pytest.raises(ValueError, match="unit"):
        infill.fill_in_middle(docs, infill.Cuts(unit="page"))


def test_wavelet_ranks_and_selects():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 8, 1000).astype(np.uint8)
    matrix = infill.WaveletMatrix(values)
    places = np.arange(1001)
    for v in range(8):
        assert np.array_equal(matrix.rank(v, places), np.concatenate([[0], np.cumsum(values == v)]))
    hits = np.flatnonzero(np.isin(values, (2, 5)))
    k = np.arange(len(hits) + 1)
    start, end = np.zeros(len(k), np.int64), np.full(len(k), 1000)
    assert np.array_equal(matrix.select((2, 5), start, end, k), np.concatenate([[0], hits + 1]))


VECTORS = "vec_id long, embedding array<float>, label int, vector int, row int, asks int, node string"


def plain_negatives(rows, every, positives=5, negatives_=3, window=(50, 95)):
    whole = []
    for place, r in enumerate(rows):
        vector, label = r[1], r[2]
        if r[0] is None or label is None or vector is None or any(x is None or not np.isfinite(x) or abs(256 * np.float32(x)) >= 2**27 for x in vector):
            continue
        whole.append((place, r[0], label, [int(np.floor(256 * float(np.float32(x)))) for x in vector]))
    out = []
    for place, anchor, label, v in whole:
        if anchor % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i, p, m) for p, i, m, w in whole if len(w) == len(v) and p != place))
        for s, i, _, _ in [x for x in scored if x[3] == label][:positives]:
            fits = [x for x in scored if x[3] != label and window[0] * -s <= 100 * -x[0] <= window[1] * -s][:negatives_]
            out += [(anchor, i, rank, x[1], -s, -x[0]) for rank, x in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("tree", [negatives.Tree(), negatives.Tree(page=40, leaf=4, fan_out=2, upper=2, anchors=7)])
def test_negatives_equal_brute_force(spark, tree):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 0.5
    rows = []
    for k in range(300):
        rows.append((k, (centres[k % 6] + rng.normal(size=8) * 0.4).tolist(), int(rng.integers(0, 3)), 1, 2, 3, "x"))
    same = [0.5] * 8
    rows += [(1000 + k, same, k % 3, 1, 2, 3, "x") for k in range(120)]  # copies that overfill a page
    rows += [(2000 + k, [0.25, -1.0, 0.5], k % 2, 1, 2, 3, "x") for k in range(4)]  # another length
    rows += [(4000, [], 0, 1, 2, 3, "x"), (4010, [], 0, 1, 2, 3, "x"), (4020, [], 1, 1, 2, 3, "x")]
    rows += [(5000, None, 1, 1, 2, 3, "x"), (5010, same, None, 1, 2, 3, "x"), (None, same, 1, 1, 2, 3, "x")]
    rows += [(5020, [None] * 8, 1, 1, 2, 3, "x"), (5030, [float("nan")] * 8, 1, 1, 2, 3, "x"), (5040, [float("inf")] * 8, 1, 1, 2, 3, "x")]
    rows += [(5050, [1e30] * 8, 1, 1, 2, 3, "x"), (10, rows[10][1], rows[10][2], 1, 2, 3, "x")]
    got = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, tree=tree)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, 10)


def test_negatives_of_large_components_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(k, (rng.normal(size=3) * 400_000).astype(np.float32).tolist(), k % 2, 1, 2, 3, "x") for k in range(60)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0, tree=negatives.Tree(leaf=8))
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, 5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SHAPE)
    assert exact.exact_groups(none).count() == exact.keep_one(none).count() == infill.fill_in_middle(none).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0).count() == 0
