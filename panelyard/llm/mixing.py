"""Mixing sources to target weights: a temperature on token shares, realised as budgeted block permutations.

Source shares p are raised to an exponent and normalised. The exponent is bisected so that the weights reach a target
entropy, and so that no source is repeated more often than a limit under the token budget. A source's budget is drawn
as whole passes over its rows and one partial pass. A pass is a permutation of blocks, and of the rows inside a block;
the partial pass ends where the budget is used up.

The end of a partial pass is found on three levels: outer blocks, inner blocks of the one that is cut, and the rows of
the inner block that is cut. Each level has about the cube root of the source's rows, so no window grows with a source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored


@dataclass(frozen=True)
class Mix:
    """``budget``: tokens to draw, as a multiple of all tokens. ``entropy``: target as a share of the largest
    possible one, or None for the shares as they are (exponent 1). ``repeats``: most passes over any source.
    ``seed`` fixes the permutations. ``precision`` of the exponent."""

    budget: float = 1.0
    entropy: float | None = 0.98
    repeats: float | None = 4.0
    seed: int = 17
    precision: float = 1e-9


def _hash(*parts: Column) -> Column:
    return F.xxhash64(F.concat_ws(":", *parts))


def _weight(exponent: float | Column) -> Column:
    """A source's unnormalised weight; the largest source has 1, so nothing overflows."""
    return F.exp(F.lit(exponent) * F.col("log_share"))


def find_exponent(sources: DataFrame, mix: Mix) -> float:
    """The largest exponent in [0, 1] that reaches the target entropy, raised to the least one within the limit of
    repeats. Both measures are monotone in the exponent. One job tries 31 exponents: five halvings at once. A budget
    that repeats a source too often even at its own share can't be met: this raises."""
    total, many, least = sources.agg(F.sum("tokens"), F.count("*"), F.min("log_share")).first()
    if not many:
        return 1.0

    def measures(at: list[float]) -> list[tuple[float, float]]:
        columns = []
        for a in at:
            columns += [F.sum(_weight(a)), F.sum(_weight(a) * F.lit(a) * F.col("log_share"))]
        row = sources.agg(*columns).first()
        out = []
        for k, a in enumerate(at):
            z, e = row[2 * k], row[2 * k + 1]
            # passes over the smallest source, the one that is repeated most: budget * weight / tokens
            out.append((math.log(z) - e / z, mix.budget * row_share * math.exp((a - 1) * least) / z))
        return out

    row_share = sources.agg(F.sum(F.exp("log_share"))).first()[0]  # all tokens over those of the largest source

    def first(holds) -> float:
        """Bisect for the border of a condition that holds up to an exponent (or from it on)."""
        low, high = 0.0, 1.0
        ends = [holds(m) for m in measures([low, high])]
        if ends[0] == ends[1]:
            return math.nan if ends[0] else math.inf
        while high - low > mix.precision:
            inner = [low + (high - low) * k / 32 for k in range(1, 32)]
            same = [holds(m) == ends[0] for m in measures(inner)]
            k = same.index(False) if False in same else len(same)
            low, high = ([low, *inner] + [high])[k], ([*inner, high])[k]
        return high if ends[1] else low

    exponent = 1.0
    if mix.entropy is not None:
        border = first(lambda m: m[0] >= mix.entropy * math.log(many) - 1e-12)
        exponent = 1.0 if math.isnan(border) else 0.0 if math.isinf(border) else border
    if mix.repeats is not None:
        border = first(lambda m: m[1] <= mix.repeats)
        if math.isinf(border):
            raise ValueError(f"a budget of {mix.budget} x the tokens repeats a source more than {mix.repeats} times")
        exponent = exponent if math.isnan(border) else max(exponent, border)
    return exponent


def _partial(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, cut_outer, cut_inner, cut_row): a partial pass takes what is ordered before the cut."""

    def level(parts: DataFrame, group: list[str], key: str) -> DataFrame:
        """The part in which the budget ends, and what is left for it."""
        order = Window.partitionBy("source").orderBy(key)
        upto = parts.withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        over = upto.where(F.col("upto") > F.col("left"))
        return over.groupBy("source").agg(F.min_by(F.struct(key, "left", "upto", "tokens"), key).alias("at")).select(
            "source", F.col(f"at.{key}").alias(f"cut_{key}"), (F.col("at.left") - F.col("at.upto") + F.col("at.tokens")).alias("left")
        )

    outer = rows.groupBy("source", "outer").agg(F.sum("tokens").alias("tokens"))
    cut1 = stored(level(outer.join(sources.select("source", F.col("rest").alias("left")), "source"), ["outer"], "outer"), "mix")
    at1 = rows.join(cut1, (rows["source"] == cut1["source"]) & (rows["outer"] == cut1["cut_outer"])).drop(cut1["source"])
    inner = at1.groupBy("source", "inner").agg(F.sum("tokens").alias("tokens"), F.first("left").alias("left"))
    cut2 = stored(level(inner, ["inner"], "inner"), "mix")
    at2 = (
        rows.join(cut1.select("source", "cut_outer"), "source")
        .where("outer = cut_outer")
        .drop("cut_outer")
        .join(cut2, "source")
        .where("inner = cut_inner")
    )
    cut3 = level(at2.select("source", "row", "tokens", "left"), ["row"], "row").drop("left")
    return cut1.drop("left").join(cut2.drop("left"), "source", "left").join(cut3, "source", "left")


def plan_mix(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, row_key, source, tokens, exponent, weight, passes, epoch, in_partial, outer,
    inner, row. ``passes`` is how often the document is drawn (0: not at all).

    Tokens are words; a text without words (or missing) has none and is drawn with each whole pass. A missing source
    is a source of its own. Rows that agree in id, source and text share a place in every permutation. Sources
    without tokens have weight zero and are never drawn. An empty table gives an empty result.
    """
    mix = mix or Mix()
    source = F.coalesce(F.col(source_col), F.lit(""))
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    key = F.xxhash64(id_col, source_col, text_col)
    rows = stored(
        docs.select(F.col(id_col).alias("doc_id"), key.alias("row_key"), source.alias("source"), words.alias("tokens")), "mix"
    )
    totals = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).where("tokens > 0")
    totals = stored(totals, "mix")
    largest = totals.agg(F.max("tokens")).first()[0] or 1
    totals = totals.withColumn("log_share", F.log(F.col("tokens") / F.lit(largest)))
    exponent = find_exponent(totals, mix)
    all_tokens, norm = totals.agg(F.sum("tokens"), F.sum(_weight(exponent))).first()
    weight = _weight(exponent) / F.lit(float(norm or 1.0))
    budget = F.floor(weight * F.lit(float(mix.budget * (all_tokens or 0))) + F.lit(1e-6))
    seed = F.lit(mix.seed)
    sources = totals.select(
        "source",
        F.lit(exponent).alias("exponent"),
        weight.alias("weight"),
        F.floor(budget / F.col("tokens")).cast("int").alias("whole"),
        (budget % F.col("tokens")).alias("rest"),
        F.ceil(F.cbrt(F.col("rows").cast("double"))).cast("long").alias("side"),
    )
    sources = stored(sources, "mix")
    placed = stored(
        rows.join(sources, "source", "left").select(
            "doc_id",
            "row_key",
            "source",
            "tokens",
            "exponent",
            F.coalesce("weight", F.lit(0.0)).alias("weight"),
            F.coalesce("whole", F.lit(0)).alias("whole"),
            # A block's place in the pass is a hash of its number: a permutation drawn anew for each seed.
            _hash(seed, "whole", "source", F.lit("outer"), F.pmod(_hash("row_key", F.lit("outer")), "side")).alias("outer"),
            _hash(seed, "whole", "source", F.lit("inner"), F.pmod(_hash("row_key", F.lit("inner")), "side")).alias("inner"),
            _hash(seed, "whole", "row_key").alias("row"),
        ),
        "mix",
    )
    cuts = stored(_partial(placed.where("weight > 0"), sources), "mix")
    inside = (F.col("outer") < F.col("cut_outer")) | (
        (F.col("outer") == F.col("cut_outer"))
        & (
            (F.col("inner") < F.col("cut_inner"))
            | ((F.col("inner") == F.col("cut_inner")) & (F.col("row") < F.coalesce("cut_row", F.col("row"))))
        )
    )
    drawn = (F.col("weight") > 0) & F.coalesce(inside, F.lit(False))
    return placed.join(cuts, "source", "left").select(
        "doc_id",
        "row_key",
        "source",
        "tokens",
        "exponent",
        "weight",
        (F.col("whole") + drawn.cast("int")).alias("passes"),
        drawn.alias("in_partial"),
        "outer",
        "inner",
        "row",
    )


def draws(planned: DataFrame) -> DataFrame:
    """One row per draw of a plan: its columns and ``epoch`` from 0. The last epoch of a source is the partial pass."""
    many = planned.where("passes > 0")
    return many.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))


def mix_documents(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The drawn documents with all columns of ``docs``, repeated as often as they are drawn."""
    planned = plan_mix(docs, mix, id_col, text_col, source_col)
    plan = planned.where("passes > 0").select(
        F.col("doc_id").alias("_mix_id"), F.col("row_key").alias("_mix_key"), F.col("passes").alias("_mix_passes")
    ).distinct()
    key = F.xxhash64(id_col, source_col, text_col)
    hit = docs[id_col].eqNullSafe(plan["_mix_id"]) & (key == plan["_mix_key"])
    repeated = F.explode(F.sequence(F.lit(1), F.col("_mix_passes")))
    return docs.join(plan, hit).select(*(docs[c] for c in docs.columns), repeated.alias("_mix_pass")).drop("_mix_pass")
