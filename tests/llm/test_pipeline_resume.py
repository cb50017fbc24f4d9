import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_changed_rows_or_code_are_run_again(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    def write(n, toxic):
        spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(n)], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(1, toxic, 1)], "doc_id long, toxic int, quality int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")

    ran = []

    def stage(number):
        def run(spark, docs, sf_dir):
            ran.append(number)
            return docs.where(F.col("doc_id") != number)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"s{i}", stage(i)) for i in range(3)])
    name = f"run{random.random()}"
    counts = []
    for n, toxic in ((5, 0), (5, 0), (6, 0), (6, 1)):
        write(n, toxic)
        counts.append((corpus_pipeline.run(spark, str(tmp_path), name).count(), len(ran)))
    assert counts == [(2, 3), (2, 4), (3, 7), (3, 10)]
    monkeypatch.setattr(corpus_pipeline.inspect, "getsource", lambda module: "other code")
    assert corpus_pipeline.run(spark, str(tmp_path), name).count() == 3 and len(ran) == 13
