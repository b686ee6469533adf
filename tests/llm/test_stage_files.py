"""What stages of the pipeline leave on disk."""

import corpus_pipeline


def test_a_stage_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i % 50, "text") for i in range(200)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def files():
        every = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = [every.apply(i).getName() for i in range(every.size())]
        return {x for x in names if x.startswith("shuffle_")}

    before, left = files(), []

    def first(spark, docs, sf_dir):
        return docs.groupBy("doc_id").count()

    def second(spark, docs, sf_dir):
        left.append(files() - before)
        return docs

    setting = spark.conf.get(corpus_pipeline.CLEANED, "false")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", first), ("second", second)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 50
    assert left == [set()] and spark.conf.get(corpus_pipeline.CLEANED) == setting
