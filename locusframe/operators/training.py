"""Training of sparse linear models on feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators.matrix import interactions
from locusframe.operators.pairs import LinearModel


def l1_logistic(d: DataFrame, features: list[str], label: str = "gs", penalty: float = 0.01, rounds: int = 50, products: bool = False) -> LinearModel:
    """A logistic regression with an L1 penalty on standardised features, and with products on their pairwise products too; weights are those of standardised columns, as LinearModel has them.

    Rows with a null feature or label are left out.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    wide = interactions(d, features, [label]) if products else d.select(label, *features)
    names = [c for c in wide.columns if c != label]
    plain = wide.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(names)])
    rows = VectorAssembler(inputCols=[f"f{i}" for i in range(len(names))], outputCol="raw", handleInvalid="skip").transform(plain).select("label", "raw")
    rows = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows).select("label", "features")
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=rounds, standardization=False).fit(rows)
    return LinearModel({c: float(w) for c, w in zip(names, model.coefficients, strict=True)}, float(model.intercept), products)
