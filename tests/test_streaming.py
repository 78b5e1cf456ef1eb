"""A stream scores as the same rows do in a batch."""

from pyspark.sql import functions as F

from lexiloom.operators import scoring
from lexiloom.streaming.scoring import running_summary, scored_stream

SCHEMA = "ord bigint, targetId string, candidates string, rawResponseText string"


def test_stream(spark, tmp_path):
    key = spark.createDataFrame([("B1", "noun", ["cat"]), ("B2", "action", ["to run"])], "target_id string, pos string, answers array<string>")
    sent = spark.createDataFrame([(1, "B1", '["dog","cat"]', None), (2, "B2", 'I say ["run"]', None), (3, None, '["x"]', None), (4, "B1", "[]", None), (5, "B9", '["x"]', None)], SCHEMA)
    sent.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df, mode in (("rows_", scored_stream(stream, key), "append"), ("sums_", running_summary(stream, key), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.ord, r.rank) for r in spark.table("rows_").collect()) == [(1, 2), (2, 1), (4, None)]
    batch = scoring.scored(sent.where("targetId is not null").withColumn("first_ord", F.col("ord")), key)
    want = {r.pos: (r.total, r.top1, r.mrr) for r in scoring.summary(batch).where("pos is not null").collect()}
    assert {r.pos: (r.total, r.top1, r.mrr) for r in spark.table("sums_").collect()} == want
