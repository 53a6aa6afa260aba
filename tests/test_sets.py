from siltstone.plans import registry


def test_set_operations_reach_the_end_of_long_texts(spark, tmp_path):
    """set01_whole_texts"""
    text = " ".join([*(f"a{i}" for i in range(50)), "both", *(f"b{i}" for i in range(50)), "both"])
    spark.createDataFrame([(1, text), (2, None), (3, "one")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.common, r.either, r.missing) for r in registry.queries()["set01_whole_texts"](spark, str(tmp_path)).collect()}
    assert found == {1: (1, 101, 50), 2: (0, 1, 0), 3: (0, 1, 0)}
