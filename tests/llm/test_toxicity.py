"""Tables of texts that have nothing to tell apart."""

from pyspark.sql import functions as F

from parcelmint.llm import toxicity


def test_one_word_in_all_texts_tells_nothing(spark):
    docs = spark.createDataFrame([(i, "alone") for i in range(40)], "doc_id long, text string")
    model = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")), "toxic", F.lit(True))
    assert not len(model.tokens)
    assert {round(r.score, 1) for r in toxicity.score(docs, model).collect()} == {0.5}
