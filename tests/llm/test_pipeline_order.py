"""The packing stage follows the mix, however its input lies in files."""

import corpus_pipeline
from repolens.llm import mixing, packing


def test_packing_follows_the_mix_over_files_of_unequal_size(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(docs.withColumn("doc_id", docs["doc_id"] + 1000)).unionByName(docs.withColumn("doc_id", docs["doc_id"] + 2000))
    position = {r["doc_id"]: r["position"] for r in mixing.mix(docs).collect()}
    mixed = corpus_pipeline.mixing_stage(spark, docs, sf_dir).collect()
    assert [r["doc_id"] for r in mixed] == sorted(position, key=position.get)
    folder = str(tmp_path / "mixed")
    for part in (mixed[:40], mixed[40:500], mixed[500:]):  # the largest file is in the middle
        spark.createDataFrame(part, docs.schema).coalesce(1).write.mode("append").parquet(folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = corpus_pipeline.packing_stage(spark, spark.read.parquet(folder), sf_dir).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    windows: dict = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append(r)
    first = []
    for _, pieces in sorted(windows.items()):
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(x["length"] for x in pieces[:i]) for i in range(len(pieces))] and sum(r["length"] for r in pieces) <= 4096
        places = [position[r["doc_id"]] for r in pieces]
        assert len({p // packing.UNIT for p in places}) == 1
        first.append(min(places))
    assert first == sorted(first) and len({p // packing.UNIT for p in first}) == 2
    lengths: dict = {}
    for r in got:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {r["doc_id"]: r["doc_tokens"] for r in got} and set(lengths) == set(position)
    again = corpus_pipeline.packing_stage(spark, docs.repartition(5), sf_dir).collect()
    assert sorted(again) == sorted(got)
