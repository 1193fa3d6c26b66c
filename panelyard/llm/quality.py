"""Quality rules: base counts, and robust outliers by minimum covariance determinant (MCD) per language and source.

Each document becomes a vector of four transformed statistics. Per group an MCD estimate is found from all rows by
concentration steps: the share ``support`` of rows nearest to the present estimate gives the next one. A step is one
aggregation: rows are dealt into cells of distance, each cell keeps its count, sums and sums of products, and the
nearest cells are added up until the share is reached. So no group is gathered, whatever its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, stored
from .textstats import counts

#: Statistic, and the least standard deviation it is given: most texts have no symbols at all, and a covariance
#: of constants would make any single symbol an outlier.
FEATURES = {"word_length": 0.03, "symbols": 0.03, "capitals": 0.02, "variety": 0.006}
X = list(FEATURES)
FLOORS = np.array(list(FEATURES.values()))
#: Standard deviations that an estimate from few rows is drawn towards.
PRIOR = np.array([0.08, 0.08, 0.05, 0.03])
PRODUCTS = [(i, j) for i in range(len(X)) for j in range(i, len(X))]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Cells of distance for each doubling of the squared distance, and their range.
CELLS, LOWEST, HIGHEST = 16, -160, 640


@dataclass(frozen=True)
class Rules:
    """``least_rows``: rows that a group needs for an estimate of its own; smaller ones take that of all rows of the
    language, then that of all rows, which is drawn towards ``PRIOR`` if there are fewer altogether. ``support``: share of rows that the estimate is made from. ``tail``: chance that a row of a normal
    group is rejected. ``settled`` and ``most_steps`` end the steps: each keeps or lowers the determinant, so
    any of them is a valid estimate."""

    least_rows: int = 200
    support: float = 0.75
    tail: float = 1e-9
    settled: float = 1e-2
    most_steps: int = 12


def _chi2_cdf(x: float, k: int) -> float:
    """For even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def _chi2_quantile(tail: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        over = math.exp(-mid / 2) * sum((mid / 2) ** i / math.factorial(i) for i in range(k // 2))
        low, high = (mid, high) if over > tail else (low, mid)
    return high


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, source, row_key, the counts, n_lines, n_distinct, n_capitals, n_bytes) of every row. Missing
    texts count as empty, a missing language or source is a group like any other."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.xxhash64(id_col, "lang", "source", text_col).alias("row_key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    kept = ["doc_id", "lang", "source", "row_key"]
    names = [*COUNTS, "n_lines", "n_distinct", "n_capitals", "n_digits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            columns = zip(*map(counts, batch["text"].to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in kept), *(pa.array(c, pa.int64()) for c in columns)], [*kept, *names]
            )

    shape = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, source string, row_key long"
    return rows.mapInArrow(run, ", ".join([shape, *(f"{n} long" for n in names)]))


def _vectors(rows: DataFrame) -> DataFrame:
    words, chars = F.col("n_words").cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    varied = F.log(F.greatest(F.col("n_distinct"), F.lit(1)).cast("double")) / F.log(F.greatest(words, F.lit(2.0)))
    return rows.withColumns(
        {
            "word_length": F.log(chars / F.greatest(words, F.lit(1.0))),
            "symbols": F.sqrt(F.col("n_symbols") / chars),
            "capitals": F.sqrt(F.col("n_capitals") / chars),
            "variety": varied,
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def _grouped(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` with ``grp``, whose estimate judges the row: language and source where that pair has enough rows, else
    the language, else all; and ``feeds``, the groups whose estimates the row enters: all of them that judge any row."""
    pairs = rows.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    pairs = stored(pairs, "quality-groups")
    langs = pairs.groupBy("lang").agg(F.sum("n").alias("whole"), F.min("n").alias("fewest"))
    pair, lang = F.concat_ws("\x01", F.lit("pair"), "lang", "source"), F.concat_ws("\x01", F.lit("lang"), "lang")
    own, wide = F.col("n") >= least, F.col("whole") >= least
    named = stored(
        pairs.join(langs, "lang").select(
            "lang",
            "source",
            F.when(own, pair).when(wide, lang).otherwise(F.lit("all")).alias("grp"),
            F.when(own, pair).alias("own"),
            F.when(wide & (F.col("fewest") < least), lang).alias("wide"),
        ),
        "quality-named",
    )
    some = not named.where("grp = 'all'").isEmpty()
    feeds = F.filter(F.array("own", "wide", F.lit("all" if some else None)), lambda g: g.isNotNull())
    named = named.select("lang", "source", "grp", feeds.alias("feeds"))
    return rows.join(named, ["lang", "source"], "left").withColumn("grp", F.coalesce("grp", F.lit("all")))


def _drawn(cov: np.ndarray, n: float, least: int) -> np.ndarray:
    """``cov`` plus the least deviations; from fewer than ``least`` rows drawn towards the prior, wholly from none."""
    share = max(0.0, 1 - n / least)
    return (1 - share) * cov + share * np.diag(np.maximum(np.diag(cov), PRIOR**2)) + np.diag(FLOORS**2)


def _packed(mean: np.ndarray, cov: np.ndarray, n: float, det: float) -> dict:
    precision = np.linalg.inv(cov)
    out = {f"m_{x}": mean[i] for i, x in enumerate(X)}
    out |= {f"p_{i}_{j}": precision[i, j] * (1 if i == j else 2) for i, j in PRODUCTS}
    return out | {"log_det": det, "rows": n}


ESTIMATE = ", ".join(
    ["grp string", *(f"m_{x} double" for x in X), *(f"p_{i}_{j} double" for i, j in PRODUCTS), "log_det double", "rows double"]
)


def _distance() -> Column:
    gaps = [F.col(x) - F.col(f"m_{x}") for x in X]
    return sum((F.col(f"p_{i}_{j}") * gaps[i] * gaps[j] for i, j in PRODUCTS), F.lit(0.0))


def _start(rows: DataFrame, least: int) -> DataFrame:
    """Medians, and deviations from the middle half."""
    quarters = [F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in X]
    found = rows.groupBy("grp").agg(F.count("*").alias("n"), *quarters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                low, mid, high = np.array([getattr(r, x) for x in X]).T
                out.append({"grp": r.grp} | _packed(mid, _drawn(np.diag(((high - low) / 1.349) ** 2), r.n, least), r.n, math.inf))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ESTIMATE.split(", ")])

    return found.mapInPandas(run, ESTIMATE)


def _step(rows: DataFrame, now: DataFrame, share: float, widen: float | None, least: int) -> DataFrame:
    """The estimate from the rows nearest to ``now``: a share of them, or all within a squared distance."""
    measured = rows.join(now, "grp").withColumn("d2", _distance())
    cell = F.floor(F.log2(F.greatest("d2", F.lit(1e-12))) * CELLS).cast("int")
    cells = measured.groupBy("grp", F.greatest(F.least(cell, F.lit(HIGHEST)), F.lit(LOWEST)).alias("cell")).agg(
        F.count("*").alias("n"),
        *(F.sum(F.col(x) - F.col(f"m_{x}")).alias(f"s_{x}") for x in X),
        *(F.sum((F.col(X[i]) - F.col(f"m_{X[i]}")) * (F.col(X[j]) - F.col(f"m_{X[j]}"))).alias(f"q_{i}_{j}") for i, j in PRODUCTS),
        *(F.first(f"m_{x}").alias(f"m_{x}") for x in X),
    )
    p = len(X)

    def estimate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        total = pdf["n"].sum()
        if widen is None:
            take = pdf["n"].cumsum().shift(fill_value=0) < share * total
        else:
            take = (pdf["cell"] + 1) / CELLS <= math.log2(widen)
            if not take.any():
                take.iloc[0] = True
        part = pdf[take]
        n = part["n"].sum()
        shift = np.array([part[f"s_{x}"].sum() for x in X]) / n
        cov = np.empty((p, p))
        for i, j in PRODUCTS:
            cov[i, j] = cov[j, i] = part[f"q_{i}_{j}"].sum() / n - shift[i] * shift[j]
        mean = np.array([part[f"m_{x}"].iloc[0] for x in X]) + shift
        det = np.linalg.slogdet(_drawn(cov, total, least))[1]
        # The nearest rows alone would understate the spread of a normal group.
        alpha = min(n / total, 1 - 1e-6) if widen is None else _chi2_cdf(widen, p)
        cov = cov * alpha / _chi2_cdf(_chi2_quantile(1 - alpha, p), p + 2)
        return pd.DataFrame([{"grp": pdf["grp"].iloc[0]} | _packed(mean, _drawn(cov, total, least), n, det)])

    return cells.groupBy("grp").applyInPandas(estimate, ESTIMATE)


def robust_estimates(rows: DataFrame, rules: Rules) -> DataFrame:
    """One MCD estimate per ``grp`` of ``rows``: location, precision (off-diagonal terms doubled), rows used."""
    now = stored(_start(rows, rules.least_rows), "quality-estimate")
    for _ in range(rules.most_steps):
        new = stored(_step(rows, now, rules.support, None, rules.least_rows), "quality-estimate")
        moved = new.join(now.select("grp", F.col("log_det").alias("before")), "grp").where(
            F.abs(F.col("log_det") - F.col("before")) > rules.settled
        )
        now = new
        if moved.isEmpty():
            break
    return stored(_step(rows, now, 1.0, _chi2_quantile(0.025, len(X)), rules.least_rows), "quality-estimate")


def judge(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, row_key, the counts, base_failed, distance (squared), kept.

    A document is kept when the base rules pass and its squared distance from its group's robust estimate is within
    the chi-square cutoff of ``rules.tail``. Rows that fail the base rules enter no estimate and have no distance; every
    other row has one. Empty and missing texts fail the base
    rules. Repeated rows and missing ids are judged like any other. An empty table gives an empty result.
    """
    rules = rules or Rules()
    rows = stored(_vectors(document_counts(docs, id_col, text_col)), "quality")
    grouped = stored(_grouped(rows, rules.least_rows), "quality")
    passed = grouped.where("not base_failed").select(F.explode("feeds").alias("grp"), *X)
    estimates = robust_estimates(passed, rules)
    cutoff = _chi2_quantile(rules.tail, len(X))
    judged = grouped.join(estimates, "grp", "left").withColumn(
        "distance", F.when(~F.col("base_failed"), _distance())
    )
    inside = F.col("base_failed") | (F.col("distance") <= cutoff)
    return judged.select(
        "doc_id", "row_key", *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "distance", "grp"
    )


def keep_good(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected documents, all columns kept."""
    key = F.xxhash64(id_col, "lang", "source", text_col)
    bad = judge(docs, rules, id_col, text_col).where("not kept").select("doc_id", "row_key").distinct()
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("row_key").alias("_bad_key"))
    hit = docs[id_col].eqNullSafe(bad["_bad_id"]) & (key == bad["_bad_key"])
    return docs.join(bad, hit, "left_anti")
