from pyspark.sql import functions as F

from replayframe import hand_queries
from replayframe.operators import evaluation, metric_sums


def rows(df):
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_parts_add_up_to_the_whole(spark, tmp_path):
    found = hand_queries._outcomes(spark, "/root/testdata/sf0.001").withColumn("distance", F.lit(0)).persist()
    whole = evaluation.frozen_metrics(found).where("not whole").drop("whole", "loss")
    at = f"file://{tmp_path}/sums"
    for batch in (0, 1, 2, 1):  # a batch that is done again counts once
        metric_sums.write_batch(found.where(F.col("hand") % 3 == batch), batch, at, "r1", ["street"])
    state = spark.read.parquet(at)
    assert state.select("run", "batch").distinct().count() == 3
    merged = metric_sums.rates(metric_sums.merge(state, ["run", "street"]), ["street"])
    assert rows(merged.drop("loss")) == rows(whole) and len(rows(whole)) == 4
    all_ = metric_sums.rates(metric_sums.merge(state, ["run"]), []).first()
    assert abs(all_["loss"] - evaluation.frozen_metrics(found).where("whole").first()["loss"]) < 1e-9
    none = metric_sums.rates(metric_sums.metric_sums(found.limit(0), []), []).first()
    assert none["decisions"] == 0 and none["token_accuracy"] is None
    found.unpersist()
