"""The pipeline's stages, each against what its operator decides."""

import corpus_pipeline
from fintally.llm import benchmark_wand, order_minhash, quality_neighbours

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        counts.append(docs.count())
        if name != "tokens":
            assert docs.columns == columns
        if name == "quality":
            model = quality_neighbours.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert counts[-1] == quality_neighbours.scored(before, model).where("predicted = 1").count()
        if name == "near_duplicates":
            assert counts[-1] == order_minhash.classify(before).select("class_id").distinct().count()
        if name == "decontamination":
            leaky = {r["doc_id"] for r in benchmark_wand.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert counts[-1] == counts[-2] - len(leaky)
        if name == "secrets":
            assert docs.where("text rlike '[0-9a-f]{24}'").count() == 0 and docs.where("n_chars <> length(text)").count() == 0
    assert counts[-1] == counts[-2] > 0
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
