"""Rows of rare groups and of small tables are judged like any other."""

import random

from panelyard.llm import quality

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def plain(seed):
    rng = random.Random(seed)
    return " ".join("abcdefghij"[: rng.randrange(3, 8)] + str(rng.randrange(900)) for _ in range(80))


def test_a_rare_source_is_judged_by_its_language(spark):
    rows = [(k, plain(k), "en", "big", 0) for k in range(400)]
    rows += [(1000 + k, plain(k).replace(" ", "### "), "en", "rare", 0) for k in range(60)]
    rows += [(2000 + k, plain(5000 + k), "xx", "rare", 0) for k in range(30)]
    rows += [(3000, "a b", "xx", "rare", 0), (3001, None, None, None, 0)]
    got = quality.judge(spark.createDataFrame(rows, SHAPE)).toPandas().set_index("doc_id").sort_index()
    assert (got["distance"].isna() == got["base_failed"]).all()
    assert got.loc[:399, "kept"].all() and got.loc[2000:2029, "kept"].all()
    assert not got.loc[1000:1059, "kept"].any() and not got.loc[3000:3001, "kept"].any()


def test_a_small_table_rejects_its_outliers(spark):
    rows = [(k, plain(k), "en", f"s{k % 3}", 0) for k in range(50)]
    rows += [(100 + k, plain(k).replace(" ", "###### "), "en", "s0", 0) for k in range(4)]
    got = quality.judge(spark.createDataFrame(rows, SHAPE)).toPandas().set_index("doc_id").sort_index()
    assert got["distance"].notna().all()
    assert got.loc[:49, "kept"].all() and not got.loc[100:, "kept"].any()
    one = quality.judge(spark.createDataFrame(rows[:1], SHAPE)).first()
    assert one["kept"] and one["distance"] is not None
