"""The pipeline over small tables: every stage works on what its predecessor kept."""

import corpus_pipeline
from orbitlake.llm import queries
from tests.llm import helpers as H
from tests.llm.test_line_dedup import expected as lines_left

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = queries.table(spark, FOLDER, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.write_through(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert after.keys() <= before.keys() and len(after) > 0.5 * len(before)
        if name == "line_dedup":
            texts = [before[i].text for i in sorted(before)]
            left = dict(zip(sorted(before), lines_left(texts)))
            assert {i: r.text for i, r in after.items()} == {i: t for i, t in left.items() if t is None or t.strip() or not (before[i].text or "").strip()}
            assert all(r.n_chars == len(r.text) for r in after.values() if r.text is not None)
        else:
            assert all(after[i] == before[i] for i in after)
        if name == "jaccard_join":
            ids = sorted(before)
            roots = H.jaccard_roots([H.shingle_set(before[i].text) for i in ids])
            assert sorted(after) == [ids[k] for k in range(len(ids)) if roots[k] == k]
        seen.append(name)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    assert seen == ["toxicity", "line_dedup", "jaccard_join", "decontamination"]


def test_awkward_documents_pass_every_stage(spark):
    docs = H.documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.write_through(stage(spark, docs, FOLDER), name)
    assert docs.count() > 0


def test_no_documents_pass_every_stage(spark):
    docs = H.documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.write_through(stage(spark, docs, FOLDER), name)
    assert docs.count() == 0


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
