"""Localization patterns from features: a plug-in model, and one trained here on stated synthetic patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PatternModel:
    """A fitted pipeline with its feature columns and classes."""

    def __init__(self, model: PipelineModel, features: list[str], classes: list[str]):
        if model is None or not features or not classes:
            raise ValueError("a pattern model needs a model, feature columns and classes")
        self.model, self.features, self.classes = model, features, classes

    @classmethod
    def load(cls, path: str) -> PatternModel:
        try:
            m = PipelineModel.load(path)
        except Exception as e:
            raise RuntimeError(f"{path} holds no readable pattern model") from e
        return cls(m, m.stages[0].getInputCols(), list(next(s for s in m.stages if hasattr(s, "labels")).labels))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds p_<class> for each class and pattern, the most likely one (the first of equals)."""
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"missing feature columns: {', '.join(missing)}")
        clean = df.withColumns({c: F.trim(F.col(c).cast("string")) for c in ("cell", "gene")} | {c: F.col(c).cast("double") for c in self.features})
        out = self.model.transform(clean).withColumn("_p", vector_to_array("probability"))
        out = out.withColumns({f"p_{c}": F.col("_p")[i] for i, c in enumerate(self.classes)})
        names = F.array(*[F.lit(c) for c in self.classes])
        return out.withColumn("pattern", F.element_at(names, F.array_position("_p", F.array_max("_p")).cast("int"))).select(*df.columns, *[f"p_{c}" for c in self.classes], "pattern")


def train(labelled: DataFrame, features: list[str], label: str = "pattern", trees: int = 30, depth: int = 6, seed: int = 1) -> PatternModel:
    filled = [f"_{c}" for c in features]
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep")
    stages = [Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_vec"), RandomForestClassifier(featuresCol="_vec", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed)]
    fitted = index.fit(labelled)
    model = Pipeline(stages=stages).fit(fitted.transform(labelled))
    return PatternModel(PipelineModel([*model.stages[:1], *model.stages[1:], fitted]), features, list(fitted.labels))


def rule_patterns(df: DataFrame) -> DataFrame:
    """Labels of synthetic training rows by plain rules on the rank scores; no claim about any published model."""
    p, c = F.col("peripheral"), F.col("central")
    return df.withColumn("pattern", F.when(p > 0.1, "Edge").when(c > 0.1, "Centre").when(p < -0.1, "Inner").otherwise("Random"))


def foci_ratio(df: DataFrame, name: str = "Foci") -> float:
    """Share of rows of one pattern; 0 without rows."""
    return df.agg(F.coalesce(F.avg((F.col("pattern") == name).cast("double")), F.lit(0.0)).alias("r")).first()["r"]


def predict_with_fallback(df: DataFrame, model: PatternModel, fallback: Callable[[], PatternModel] | None, threshold: float = 0.5, name: str = "Foci") -> DataFrame:
    """Predictions of the first model, or of the fallback for all rows if the share of one pattern is above the threshold."""
    out = model.predict(df)
    return fallback().predict(df) if fallback is not None and foci_ratio(out, name) > threshold else out
