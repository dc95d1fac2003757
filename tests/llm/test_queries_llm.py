"""The operators' queries against their SQL, and the pipeline stage by stage, on the smallest tables."""

import collections
import os

import pytest

from cloakframe.llm import bpe, jaccard, toxicity
from cloakframe.llm.queries import ORACLES, QUERIES
from tests.llm.test_llm import components_brute
from tests.test_queries import SF, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    compare(spark, name, QUERIES[name], ORACLES[name])


def test_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "mixing", "byte_bpe"]
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    bad = {r.doc_id for r in toxicity.op2_toxicity(spark, SF).collect() if r.predicted}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad
    unique = corpus_pipeline.STAGES[1][1](spark, kept, SF)
    want = components_brute([(r.doc_id, r.text) for r in kept.collect()])
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    out = corpus_pipeline.run(spark, SF)
    ids = collections.Counter(r.doc_id for r in out.collect())
    assert set(ids) <= {r.doc_id for r in unique.collect()} and max(ids.values()) <= 3
    full = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.op5_byte_bpe(spark, SF).collect()}
    assert all(full[r.doc_id] == (r.n_tokens, r.ids_sha256) for r in out.collect())
    assert jaccard.WORDS == 5
