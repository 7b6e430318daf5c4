"""Scalers and forests in a pyspark.ml Pipeline, saved and loaded."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from lodestone.operators import learning as L
from lodestone.operators.stages import ForestClassifier, ForestModel, MinMaxScaler, ScaledModel, ZScoreScaler


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(600).select("id", ((F.col("id") * 7919) % 101).cast("double").alias("x"), ((F.col("id") * 104729) % 53).cast("double").alias("y"), F.lit(3.0).alias("flat"), (F.col("id") * 31 % 17).cast("double").alias("many"))
    return df.withColumn("label", ((F.col("x") > 50).cast("int") + (F.col("y") > 30).cast("int"))).repartition(3)


def test_scalers(spark, table, tmp_path):
    z = ZScoreScaler(inputCols=["x", "flat"], outputCols=["zx", "zf"]).fit(table)
    r = z.transform(table).agg(F.avg("zx"), F.stddev_pop("zx"), F.max("zf"), F.min("zf")).first()
    assert tuple(r) == pytest.approx((0, 1, 0, 0), abs=1e-9)
    m = MinMaxScaler(inputCols=["x", "flat"]).fit(table)
    assert tuple(m.transform(table).agg(F.min("x"), F.max("x"), F.max("flat")).first()) == (0.0, 1.0, 0.0)
    for model in (z, m):
        model.write().overwrite().save(str(tmp_path / model.uid))
        again = ScaledModel.load(str(tmp_path / model.uid))
        assert again.uid == model.uid and (again.offsets, again.scales) == (model.offsets, model.scales)
        assert again.transform(table).exceptAll(model.transform(table)).isEmpty()
    nothing = ZScoreScaler(inputCols=["x"]).fit(table.filter("false"))
    assert nothing.transform(table.limit(1)).first().x == 0.0
    assert ZScoreScaler(inputCols=["x"]).fit(table).transform(table.limit(1).withColumn("x", F.lit(None).cast("double"))).first().x is None


def test_pipeline_saved_and_loaded(spark, table, tmp_path):
    columns = ["x", "y", "many"]
    stages = [ZScoreScaler(inputCols=columns), ForestClassifier(inputCols=columns, numClasses=3, numTrees=7, maxDepth=5, keyCol="id", seed=3)]
    Pipeline(stages=stages).write().overwrite().save(str(tmp_path / "plan"))
    plan = Pipeline.load(str(tmp_path / "plan"))
    assert [type(s) for s in plan.getStages()] == [ZScoreScaler, ForestClassifier] and plan.getStages()[1].getOrDefault("numTrees") == 7
    model = plan.fit(table)
    judged = model.transform(table)
    assert judged.columns == [*table.columns, "prediction", "probability"]
    assert MulticlassClassificationEvaluator(metricName="accuracy").evaluate(judged.withColumn("prediction", F.col("prediction").cast("double"))) > 0.95
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert again.transform(table).exceptAll(judged).isEmpty() and again.transform(table).count() == 600
    loaded, first = again.stages[1], model.stages[1]
    assert isinstance(loaded, ForestModel) and loaded.featureImportances == first.featureImportances and loaded.forest.nodes == first.forest.nodes
    # the stage is the operator
    scaled = model.stages[0].transform(table)
    same = L.Forest(trees=7, max_depth=5, seed=3).fit(scaled, columns, "label", 3, "id")
    assert same.nodes == first.forest.nodes


def test_parameters_are_copied(table):
    f = ForestClassifier(inputCols=["x"], numClasses=3, numTrees=1, maxDepth=1, bootstrap=0.0, predictionCol="p", probabilityCol="q")
    other = f.copy({f.maxDepth: 2})
    assert f.getOrDefault("maxDepth") == 1 and other.getOrDefault("maxDepth") == 2
    out = f.fit(table).transform(table)
    assert {"p", "q"} <= set(out.columns) and out.select("p").distinct().count() == 2
