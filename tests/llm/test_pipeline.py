import corpus_pipeline
from varispan.llm import decontaminate, mixing, quality, simhash, tokens
from varispan.llm.common import Scratch


def test_stages_take_effect_in_order(spark, sf):
    """Each stage gives what its operator says of all that its predecessor kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    scratch = Scratch(spark, "t")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch.save(stage(spark, seen[-1], sf), f"s{i}")
        if i < 4:
            assert out.columns == names
        seen.append(out)
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert ids[1] == sorted(r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted)
    assert ids[2] == sorted({r.component_id for r in simhash.similar_documents(seen[1]).collect()})
    found = {r.doc_id for r in decontaminate.find(seen[2], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert found and ids[3] == sorted(set(ids[2]) - found)
    assert ids[4] == sorted(r.doc_id for r in mixing.mixed(seen[3]).collect() if r._epochs or r._prefix)
    assert ids[5] == ids[4]
    assert sorted(map(tuple, seen[5].collect())) == sorted(map(tuple, tokens.token_output(spark, seen[4]).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, seen[5].collect()))


def test_stages_take_odd_rows(spark, sf, odd, nothing):
    for table in (odd, nothing):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = Scratch(spark, "t").save(stage(spark, docs, sf))
        assert docs.count() <= table.count()
