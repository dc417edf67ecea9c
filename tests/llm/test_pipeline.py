import corpus_pipeline as c
from millrace.llm.common import read_table, written
from millrace.llm.decontaminate import contamination_report
from millrace.llm.pii import base_spans
from millrace.llm.toxicity import fit_toxicity

SF = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = read_table(spark, SF, "documents")
    seen = {}
    now = docs
    for name, stage in c.STAGES[:-1]:
        out = written(stage(spark, now, SF), "test-stage")
        assert out.dtypes == now.dtypes
        seen[name] = (now, out)
        now = out
    before, after = seen["toxicity"]
    model = fit_toxicity(docs, read_table(spark, SF, "labels"))
    want = sorted(r.doc_id for r in before.collect() if model.score(r.text) < 0.5)
    assert sorted(r.doc_id for r in after.collect()) == want
    before, after = seen["decontaminate"]
    bad = {r.doc_id for r in contamination_report(before, read_table(spark, SF, "benchmark")).where("contaminated").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad and bad
    left = contamination_report(after, read_table(spark, SF, "benchmark")).where("n_hit > 0")
    assert not left.count()
    before, after = seen["pii"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    assert not any(base_spans(r.text) for r in after.collect())
    final = c.run(spark, SF).collect()
    assert {r.doc_id for r in final} <= {r.doc_id for r in now.collect()} and final


def test_odd_documents_pass_through(spark, hostile, nothing):
    for docs in (hostile, nothing):
        now = docs
        for name, stage in c.STAGES:
            now = written(stage(spark, now, SF), "test-odd")
            if name != "mix":
                assert now.columns == docs.columns
        assert now.count() >= 0
