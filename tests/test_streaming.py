"""Incremental extraction over a file stream."""

import os

from pyspark.sql import functions as F

from gapmatch.operators import extract as X
from gapmatch.operators import kb as K
from gapmatch.streaming.incremental import start_extraction_stream


def test_stream_two_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(src)
    keys = X.fallback_kb(spark).select("skill_key")
    kbf = keys.select("skill_key", F.lit(0).alias("src_rank"), F.lit(None).cast("int").alias("cur_ord"),
                      F.col("skill_key").alias("src_key"))
    aliases = K.alias_map(spark, kbf)
    spark.createDataFrame([(1, "Python and SQL")], "doc_id long, text string").write.parquet(src + "/a")
    q = start_extraction_stream(spark, src + "/*", out, keys, aliases, checkpoint=str(tmp_path / "ck"))
    try:
        q.processAllAvailable()
        spark.createDataFrame([(2, "Docker, AWS")], "doc_id long, text string").write.parquet(src + "/b")
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r["doc_id"], r["skill"]) for r in spark.read.parquet(out).collect()}
    assert {(1, "python"), (1, "sql"), (2, "docker"), (2, "aws")} <= got
