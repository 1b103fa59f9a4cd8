from pyspark.sql import functions as F

from lexwright.operators.jobs import fold_jobs
from lexwright.streaming.jobs import follow_jobs


def test_stream_equals_batch(spark, tmp_path):
    kinds = ["planned", "titles", "nodes", "error", "abort", "plan_failed", "other"]
    e = spark.range(600).select((F.col("id") % 23).alias("job_id"), F.col("id").alias("seq"), F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.xxhash64("id") % 7 + 7).cast("int") % 7 + 1).alias("kind"), (F.xxhash64("id", F.lit(1)) % 3 + 3).cast("long").alias("n"), (F.col("id") % 5 == 0).alias("final"))
    for k in range(3):  # three batches, in order of seq
        e.where((F.col("seq") >= 200 * k) & (F.col("seq") < 200 * (k + 1))).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen = {}
    q = follow_jobs(src).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({r.job_id: tuple(r) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.job_id: tuple(r) for r in fold_jobs(e).collect()}
    assert seen == want and len(want) == 23
