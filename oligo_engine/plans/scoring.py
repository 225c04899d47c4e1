"""Scorers: how raw efficacy is predicted for unmodified and modified duplexes.

``ModelScorer`` applies fitted Spark ML models.  ``LinearScorer`` is a stand-in for
use without models: a fixed linear function of composition with weights that are
exact in binary, so that rankings are reproducible.  It predicts nothing about
biology.
"""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from oligo_engine.functions.labels import clip_score, rescale_score
from oligo_engine.functions.sequence import count_in, count_of, let
from oligo_engine.operators.features import modified_features, naked_features, with_source_onehot


class Scorer(Protocol):
    def naked(self, df: DataFrame, out: str) -> DataFrame:
        """Add the normalised (0-100) score of unmodified ``sense, antisense``."""

    def modified(self, df: DataFrame, out: str) -> DataFrame:
        """Add the raw score of variants.

        A scorer may also have ``replaced``, the raw score after one more replacement in
        terms of the raw score before it; variants are then not read whole again.
        """


class LinearScorer:
    #: Points of a letter on the guide and on the sense strand; all are exact in binary.
    GUIDE = {"M": 1.5, "F": 2.0, "S": 1.0, "L": -2.25, "D": 0.75, "E": -0.5}
    SENSE = {"S": 1.0, "M": 0.75, "F": 0.5}
    PHOSPHATE = 3.0

    def naked(self, df: DataFrame, out: str) -> DataFrame:
        guide = F.col("antisense")
        raw = (
            F.lit(30.0)
            + F.lit(2.0) * count_in(guide, "AU")
            - F.lit(1.5) * count_of(F.substring(guide, 2, 7), "G")
            + F.when(F.substring(guide, 1, 1).isin("A", "U"), F.lit(4.0)).otherwise(F.lit(0.0))
            + F.lit(0.25) * F.instr(F.col("sense"), "GC")
        )
        return df.withColumn(out, clip_score(raw))

    def modified(self, df: DataFrame, out: str) -> DataFrame:
        guide, sense, parent = F.col("antisense"), F.col("sense"), F.col("parent_antisense")
        terms = [
            (F.lit(88.0), 1.0),
            (count_in(parent, "AU"), 1.0),
            *[(count_of(guide, x), w) for x, w in self.GUIDE.items()],
            *[(count_of(sense, x), w) for x, w in self.SENSE.items()],
            ((F.substring(guide, 1, 1) == "1").cast("int"), self.PHOSPHATE),
        ]
        raw = F.lit(0.0)
        for value, weight in terms:
            raw = raw + F.lit(weight) * value
        return df.withColumn(out, raw)

    def replaced(self, before: Column, symbol: Column, at: Column, on_guide: Column, old: Column) -> Column:
        """Raw score once ``symbol`` stands for ``old`` at place ``at``."""

        def points(table: dict[str, float], letter: Column) -> Column:
            chain = F
            for x, w in table.items():
                chain = chain.when(letter == x, F.lit(w))
            return chain.otherwise(F.lit(0.0))

        def first(letter: Column) -> Column:
            return F.when((at == 1) & (letter == "1"), F.lit(self.PHOSPHATE)).otherwise(F.lit(0.0))

        on_strand = F.when(on_guide, points(self.GUIDE, symbol) - points(self.GUIDE, old) + first(symbol) - first(old))
        return before + on_strand.otherwise(points(self.SENSE, symbol) - points(self.SENSE, old))


class ModelScorer:
    """Fitted regressors over the feature vectors; isotonic calibration is optional."""

    def __init__(
        self,
        naked_model: Model,
        modified_model: Model,
        sources: list[str] | None = None,
        calibrator: Model | None = None,
        dose: str | None = None,
    ):
        self.naked_model = naked_model
        self.modified_model = modified_model
        self.sources = sources
        self.calibrator = calibrator
        self.dose = dose

    def naked(self, df: DataFrame, out: str) -> DataFrame:
        featured = naked_features(df)
        if self.sources:
            featured = with_source_onehot(featured, self.sources, source=None)
        scored = self.naked_model.transform(featured).withColumnRenamed("prediction", "_raw").drop("features")
        if self.calibrator is not None:
            feature, result = self.calibrator.getFeaturesCol(), self.calibrator.getPredictionCol()
            scored = (
                self.calibrator.transform(scored.withColumn(feature, F.col("_raw")))
                .withColumn("_raw", F.col(result))
                .drop(*[c for c in {feature, result} if c != "_raw"])
            )
        return scored.withColumn(out, clip_score(F.col("_raw"))).select(*df.columns, out)

    def modified(self, df: DataFrame, out: str) -> DataFrame:
        scored = self.modified_model.transform(modified_features(df, dose=self.dose))
        return scored.withColumn(out, F.col("prediction")).select(*df.columns, out)


def calibration_points(model: Model) -> tuple[list[float], list[float]]:
    """Boundaries and values of a fitted isotonic model."""
    return [float(x) for x in model.boundaries], [float(x) for x in model.predictions]


def calibrated(raw: Column, points: tuple[list[float], list[float]] | None) -> Column:
    """Value of a rising step function at ``raw``, clipped to 0-100.

    Straight between two boundaries, level beyond the ends; a boundary is found by binary
    search in one sorted array. Without points raw scores are clipped.
    """
    bounds, values = points or ([], [])
    if not bounds:
        return clip_score(raw)
    held = [F.from_json(F.lit(json.dumps(x)), "array<double>") for x in (bounds, values)]  # folded to one literal each
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])

    def at(x: Column) -> Column:
        def further(low: Column, step: Column) -> Column:
            return F.when((low + step < len(bounds)) & (F.get(held[0], low + step) <= x), low + step).otherwise(low)

        def value(i: Column) -> Column:
            b, v = (F.get(held[0], i), F.get(held[0], i + 1)), (F.get(held[1], i), F.get(held[1], i + 1))
            inside = v[0] + (v[1] - v[0]) * (x - b[0]) / (b[1] - b[0])
            return F.when(x <= bounds[0], F.lit(values[0])).when(x >= bounds[-1], F.lit(values[-1])).otherwise(inside)

        return F.aggregate(steps, F.lit(0), further, value)

    return let(raw, lambda x: F.when(x.isNotNull(), clip_score(at(x))))


def normalise(
    raw: Column, mode: str, batch: list[str] | None = None, points: tuple[list[float], list[float]] | None = None
) -> Column:
    """Bring raw scores to 0-100: ``identity``/``clip``, ``rescale`` per batch, or
    ``calibrate`` by ``points``.

    ``batch`` names the key of a batch (one scan or one search round of one parent).
    """
    if mode in ("identity", "clip"):
        return clip_score(raw)
    if mode == "rescale":
        return rescale_score(raw, F.max(raw).over(W.partitionBy(*(batch or []))))
    if mode == "calibrate":
        return calibrated(raw, points)
    raise ValueError(f"unknown mode {mode!r}")
