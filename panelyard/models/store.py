"""Fitted mixed models as parquet tables: one row of parameters, the group sums, no pickled objects."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from panelyard.models import design as d
from panelyard.models.lmm import MixedModel, Structure


def save_model(model: MixedModel, path: str) -> str:
    if model.outer and model.effect_keys == [model.entity]:
        raise ValueError("models of crossed effects are not stored")
    record = {
        "terms": model.terms, "random": model.random, "entity": model.entity, "outer": model.outer,
        "response": model.response, "family": model.family, "extra": model.extra,
        "shift": list(model.scales.shift), "scale": list(model.scales.scale),
        "y_shift": model.scales.y_shift, "y_scale": model.scales.y_scale,
        "width": model.shape.width, "z": model.shape.z, "levels": model.shape.levels,
        "theta": model.theta.tolist(), "beta": model.beta.tolist(), "inverse": model.inverse.tolist(),
        "s2": model.s2, "n": model.n, "criterion": model.criterion, "converged": model.converged, "calls": model.calls,
        "given": model.given, "aliased": model.aliased,
    }
    model.spark.createDataFrame([(json.dumps(record),)], "parameters string").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/parameters")
    model.groups.write.mode("overwrite").parquet(f"{path}/groups")
    return path


def load_model(spark: SparkSession, path: str) -> MixedModel:
    r = json.loads(spark.read.parquet(f"{path}/parameters").first()["parameters"])
    return MixedModel(
        r["terms"], r["random"], r["entity"], r["outer"],
        d.Scales(tuple(r["shift"]), tuple(r["scale"]), r["y_shift"], r["y_scale"]),
        Structure(r["width"], r["z"], r["levels"]), np.array(r["theta"]), np.array(r["beta"]), np.array(r["inverse"]),
        r["s2"], r["n"], r["criterion"], r["converged"], r["calls"], spark.read.parquet(f"{path}/groups"),
        r["response"], r["family"], r["extra"], r["given"], r["aliased"],
    )
