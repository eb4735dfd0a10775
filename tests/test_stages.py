import pytest
from lakeglean.operators import contract, fitting, panel, stages
from lakeglean.plans import views as V
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return V.panel(spark, SF).cache()


def test_a_pipeline_scores_alike_after_saving(spark, table, tmp_path):
    pipeline = Pipeline(stages=[stages.PanelFeatures(), stages.MatrixEstimator(outputCol="x"), RandomForestClassifier(featuresCol="x", labelCol=contract.TARGET, numTrees=4, maxDepth=3, seed=1)])
    path = f"file://{tmp_path}"
    pipeline.write().save(f"{path}/unfitted")
    model = Pipeline.load(f"{path}/unfitted").fit(table)
    model.write().overwrite().save(f"{path}/fitted")
    again = PipelineModel.load(f"{path}/fitted")
    scores = [{r["ID"]: r["p"] for r in m.transform(table).select("ID", vector_to_array("probability")[1].alias("p")).collect()} for m in (model, again)]
    assert scores[0] == scores[1] and len(scores[0]) == table.count()
    assert again.stages[1].names == model.stages[1].names and len(model.stages[1].names) > 40
    # target and id aren't needed, and other columns stay
    served = again.transform(table.drop("ID", contract.TARGET).withColumn("LIMIT_BAL_1", F.lit("kept"))).first()
    assert served["LIMIT_BAL_1"] == "kept" and served["prediction"] in (0.0, 1.0)


def test_the_vector_is_the_matrix(spark, table):
    df = fitting.recode(panel.features(table))
    model = stages.MatrixEstimator().fit(df)
    wide = fitting.Preparation.fit(df).matrix(df, keep=("ID",))
    got = {r["ID"]: list(r["v"]) for r in model.transform(df).select("ID", vector_to_array("features").alias("v")).collect()}
    assert model.names == wide.columns[1:]
    assert got == {r["ID"]: list(r)[1:] for r in wide.collect()}


@pytest.mark.parametrize("column", ["PAY_STATUS_3", "AGE"])
def test_missing_columns_are_named(spark, table, column):
    short = table.drop(column)
    with pytest.raises(stages.MissingColumns, match=column):
        stages.PanelFeatures().transform(short)
    df = panel.features(table)
    model = stages.MatrixEstimator().fit(df)
    for stage in (model.transform, stages.MatrixEstimator().fit):
        with pytest.raises(stages.MissingColumns, match=column):
            stage(df.drop(column))
