"""Rows without doc_id in front of real near copies."""

from fotolith.llm import jaccard_join


def test_null_id_copy_comes_first(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:30], "other", *words[31:]])
    rows = [(None, " ".join(words)), (None, near), (1, " ".join(words)), (2, near), (3, "far away from the others here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.component_id) for r in jaccard_join.join(docs).collect()}
    assert got == {(None, None), (1, 1), (2, 1), (3, 3)}
    assert sorted(r.doc_id for r in jaccard_join.keep_one(docs).where("doc_id is not null").collect()) == [1, 3]
