"""Words picked out of folded lists are those that folding word by word finds."""

from pyspark.sql import functions as F

from cuelake.functions import text
from cuelake.plans import fixtures as fx


def test_said_words_are_those_of_single_folds(spark, tmp_path):
    rows = [(1, "“Rewh,” ＲＥＷＨ re-wh rewhs  (ononst)"), (2, None), (3, ""), (4, " rewh\n'rewh' Straße STRASSE"), (5, "THATIN’ --")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["rewh", "ononst", "thatin", "strasse"]
    words = fx.words(spark, str(tmp_path)).withColumn("core", text.strip_wrappers(F.col("word"))).drop("word")
    want = text.with_folded(words, "core", "word").where(F.col("word").isin(names)).select("item_id", "word_index", "word", "start_ms", "end_ms")
    got = fx.said(spark, str(tmp_path), names)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 9
