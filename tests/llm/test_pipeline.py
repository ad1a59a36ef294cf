import corpus_pipeline as p
from factloom.llm import language, mixing, simhash, suffix_dedup


def test_stages_take_effect_and_keep_columns(spark, docs, tmp_path):
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    base.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before = now
        now = stage(spark, before, str(tmp_path))
        assert now.columns == base.columns, name
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        ids = sorted(r.doc_id for r in now.collect())
        had = sorted(r.doc_id for r in before.collect())
        if name == "language":
            keep = {r.doc_id for r in language.documents(before).collect() if r.keep}
            assert ids == [d for d in had if d in keep]
            assert not {200, 201, 202} & set(ids)
        elif name == "near duplicates":
            first = {r.doc_id for r in simhash.similar(before).collect() if r.doc_id == r.component_id}
            assert ids == sorted(first)
        elif name == "passages":
            assert ids == had
            left = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.remove_repeats(before).collect()}
            for r in now.collect():
                assert len(r.text.encode()) <= left[r.doc_id] and r.n_chars == len(r.text)
        else:
            assert ids == sorted(r.doc_id for r in mixing.mixture(before).collect())
    out = p.STAGES[-1][1](spark, now, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(ids)
    assert out.count() == p.run(spark, str(tmp_path)).count()
