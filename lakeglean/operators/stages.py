"""The panel's features and the model matrix as ``pyspark.ml`` stages: one ``Pipeline`` with the model behind them.

Stages add columns and keep the others, so a fitted pipeline scores any table that has the needed columns; one
that is missing is an error that names it, at fitting and at scoring.  A fitted stage is saved as its parameters
and one row of what it learned.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contract, fitting, panel


class MissingColumns(ValueError):
    """A stage needs columns that the table doesn't have."""


def require(df: DataFrame, columns, who: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise MissingColumns(f"{who} needs {', '.join(missing)}")




class PanelFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the behavioural features of the monthly panel, with the recoding of rare levels; a projection."""

    recoded = Param(Params._dummy(), "recoded", "a column whose rare levels are collapsed", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, recoded: str = "EDUCATION"):
        super().__init__()
        self._setDefault(recoded="EDUCATION")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        require(df, contract.PREDICTORS, "the panel stage")
        return fitting.recode(panel.features(df), self.getOrDefault(self.recoded))


class _MatrixParams(HasOutputCol):
    clipped = Param(Params._dummy(), "clipped", "columns whose high end is cut", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "columns with levels", TypeConverters.toListString)
    numeric = Param(Params._dummy(), "numeric", "columns that are imputed and scaled", TypeConverters.toListString)
    indicators = Param(Params._dummy(), "indicators", "columns that pass through", TypeConverters.toListString)

    def _needed(self) -> list[str]:
        return list(dict.fromkeys(c for p in (self.clipped, self.categorical, self.numeric, self.indicators) for c in self.getOrDefault(p)))


class MatrixEstimator(Estimator, _MatrixParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns bounds, levels, medians, centres and widths; its model adds a vector of the matrix."""

    @keyword_only
    def __init__(self, *, outputCol: str = "features", clipped=fitting.CLIPPED, categorical=fitting.CATEGORICAL, numeric=fitting.NUMERIC, indicators=fitting.INDICATORS):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(outputCol=outputCol, clipped=list(clipped), categorical=list(categorical), numeric=list(numeric), indicators=list(indicators))

    def _fit(self, df: DataFrame) -> MatrixModel:
        require(df, self._needed(), "the matrix stage")
        learned = fitting.Preparation.fit(df, *(self.getOrDefault(p) for p in (self.clipped, self.categorical, self.numeric)))
        return self._copyValues(MatrixModel(learned))


class MatrixModel(Model, _MatrixParams, MLReadable, MLWritable):
    """What the estimator learned, applied without a shuffle."""

    def __init__(self, learned: fitting.Preparation | None = None):
        super().__init__()
        self._setDefault(outputCol="features")
        self.learned = learned or fitting.Preparation()

    @property
    def names(self) -> list[str]:
        """The columns of the vector, in order."""
        return [*(f"{c}_{v}" for c, values in self.learned.levels.items() for v in values), *self.learned.centres, *self.getOrDefault(self.indicators)]

    def _transform(self, df: DataFrame) -> DataFrame:
        require(df, self._needed(), "the matrix stage")
        whole = F.struct(*[F.col(c) for c in df.columns]).alias("__row")  # names of the matrix may clash with columns of the table
        wide = self.learned.matrix(df.withColumn("__row", whole), keep=("__row",), indicators=self.getOrDefault(self.indicators))
        vector = array_to_vector(F.array(*[F.col(c) for c in self.names]))
        return wide.select(*[F.col(f"__row.{c}").alias(c) for c in df.columns], vector.alias(self.getOrDefault(self.outputCol)))

    def write(self) -> MLWriter:
        return _MatrixWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _MatrixReader()


class _MatrixWriter(MLWriter):
    def __init__(self, model: MatrixModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.sparkSession.createDataFrame([(json.dumps(asdict(self.model.learned)),)], "learned string").coalesce(1).write.parquet(f"{path}/data")


class _MatrixReader(MLReader):
    def load(self, path: str) -> MatrixModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        held = json.loads(SparkSession.active().read.parquet(f"{path}/data").first()["learned"])
        model = MatrixModel(fitting.Preparation(**held))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
