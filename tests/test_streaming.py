import os

from pyspark.sql import functions as F

from metalens.streaming.running import RUN_LOG, start_run_best


def test_run_best_over_appended_files(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    batch1 = spark.createDataFrame([(1, 0, None, -0.5), (1, 1, None, -0.2), (2, 0, None, -0.9)], RUN_LOG)
    batch1.write.parquet(src, mode="append")
    q = start_run_best(spark, src, os.path.join(tmp_dir, "ckpt"), "run_best_test")
    try:
        q.processAllAvailable()
        got = {r["run_id"]: r["best_score"] for r in spark.table("run_best_test").collect()}
        assert got == {1: -0.2, 2: -0.9}
        spark.createDataFrame([(2, 1, None, -0.1), (1, 2, None, float("nan"))], RUN_LOG).write.parquet(src, mode="append")
        q.processAllAvailable()
        rows = {r["run_id"]: (r["best_score"], r["n_evals"]) for r in spark.table("run_best_test").collect()}
        assert rows == {1: (-0.2, 2), 2: (-0.1, 2)}
    finally:
        q.stop()
