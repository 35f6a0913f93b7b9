"""Every query and stage on odd tables: no crash, one row per row where that is the contract."""

import pytest

import corpus_pipeline
from egresslake.llm.queries import QUERIES
from tests.llm.conftest import edge_rows, vector_rows

N = len(edge_rows())
#: Queries that return other than a row per document: phrases of the edge table are too rare to be frequent.
ROWS = {"op12_collocations": 0, "op13_embedding_dedup": len(vector_rows())}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_edge_table(spark, edge_dir, name):
    rows = QUERIES[name](spark, edge_dir).collect()
    assert len(rows) == ROWS.get(name, N)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, edge, edge_dir, nothing, empty_dir, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    out = f(spark, edge, edge_dir)
    rows = out.collect()
    if stage != "sentencepiece":
        assert out.columns == edge.columns
    if stage in ("toxicity", "exact_dedup", "ngram_join"):
        keys = [(r.doc_id, r.text) for r in rows]
        assert set(keys) <= {(r[0], r[1]) for r in edge_rows()}
    if stage == "toxicity":  # three labelled rows tell nothing: all stay
        assert len(rows) == N
    if stage == "exact_dedup":
        texts = ["".join((r.text or "").split()) for r in rows]
        assert len(texts) == len(set(texts))
        assert set(texts) == {"".join((r[1] or "").split()) for r in edge_rows()}
    assert f(spark, nothing, empty_dir).collect() == []


def test_pipeline_runs(spark, edge_dir, empty_dir):
    rows = corpus_pipeline.run(spark, edge_dir).collect()
    assert rows and all(r.n_tokens == len(r.token_ids) for r in rows)
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
