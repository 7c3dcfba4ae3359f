import corpus_pipeline
from provender.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = list(queries.QUERIES)
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, len(names) + 1))
    assert set(queries.ORACLES) <= set(names)


def test_pipeline(spark):
    from provender.llm import decontaminate, quality, simhash
    from provender.llm.common import table

    docs = table(spark, SF, "documents")
    out = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) < set(out.columns)
    rows = out.collect()
    labels, bench = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    accepted = {r["doc_id"] for r in quality.classify(docs, labels).collect() if r["accepted"]}
    kept = docs.where(docs.doc_id.isin(list(accepted)))
    first = {r["component_id"] for r in simhash.near_duplicates(kept).collect()}
    ids = {r["doc_id"] for r in rows}
    assert ids and ids <= first <= accepted
    assert all(not r["contaminated"] for r in decontaminate.contamination_report(out, bench).collect())
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)


def test_stages_keep_the_columns(spark):
    from provender.llm.common import table

    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
