"""Session settings and the checkpoint folder."""

import time

from stratalake.session import CHECKPOINT_KEY, FREE_SHUFFLES_KEY, pin, shared_dir, shuffle_partitions_for, shuffles_freed


def test_partitions_follow_the_volume():
    assert shuffle_partitions_for(1) == 200
    assert shuffle_partitions_for(100 * 1024**4) == 409_600


def test_checkpoints_go_to_the_configured_folder(spark):
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    folder = shared_dir(spark)
    assert folder == (configured or spark.sparkContext.getCheckpointDir())
    assert spark.sparkContext.getCheckpointDir().startswith(("file:" + folder, folder))


def test_pinned_rows_do_not_change(spark):
    from pyspark.sql import functions as F

    pinned = pin(spark.range(100).withColumn("r", F.rand()))
    assert sorted(pinned.collect()) == sorted(pinned.collect())
    assert "Scan ExistingRDD" in pinned._jdf.queryExecution().executedPlan().toString()


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count()

    def kept():
        return {path for path in files.getAllFiles().mkString(" ").split() if "/shuffle_" in path}

    before = kept()
    shuffled.write.parquet(str(tmp_path / "a"))
    assert kept() - before
    before = kept()
    with shuffles_freed(spark):
        with shuffles_freed(spark):
            shuffled.write.parquet(str(tmp_path / "b"))
        assert spark.conf.get(FREE_SHUFFLES_KEY) == "true"
    deadline = time.time() + 20  # they go in the background
    while kept() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not kept() - before and spark.conf.get(FREE_SHUFFLES_KEY) == "false"
