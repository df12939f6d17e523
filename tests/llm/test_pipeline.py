import corpus_pipeline
from tests.llm import brute
from tests.llm.test_bag_minhash import brute_groups
from tests.llm.test_packing import check
from twinfold.llm.common import table


def test_stages_on_a_table(spark, folder):
    docs = table(spark, folder, "documents")
    start = docs.collect()
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        kept.append(docs.collect())
        if len(kept) < 5:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic, single, clean, masked, packed = kept
    labels = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    gone = {r.doc_id for r in start} - {r.doc_id for r in toxic}
    assert sum(labels.get(i, 1) == 0 for i in gone) <= 0.02 * len(start)
    groups = brute_groups([(r.doc_id, r.text) for r in toxic])
    assert sorted(r.doc_id for r in single) == sorted(set(groups.values()))
    items = [r.text for r in table(spark, folder, "benchmark").collect()]
    assert {r.doc_id for r in single} - {r.doc_id for r in clean} >= {r.doc_id for r in single if any(t in r.text for t in items)}
    assert not any(t in r.text for r in clean for t in items) and len(clean) >= 0.8 * len(single)
    before = {r.doc_id: r.text for r in clean}
    assert before.keys() == {r.doc_id for r in masked}
    for r in masked:
        assert r.text == before[r.doc_id] or "[secret]" in r.text
        assert r.text == before[r.doc_id] or brute.base_secrets(before[r.doc_id]) or len(r.text) < len(before[r.doc_id])
    check(packed, [(r.doc_id, r.text) for r in masked], 1024)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "piece", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)
