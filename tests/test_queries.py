"""Every query of the engine against its SQL on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from cloakframe.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


def compare(spark, name, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = query(spark, SF)
    cols = sorted(df.columns)
    got = sorted([plain(r[c]) for c in cols] for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted([plain(r[names.index(c)]) for c in cols] for r in cur.fetchall())
    assert got == want, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    compare(spark, name, QUERIES[name], ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_every_mention_has_its_excerpt(spark, tmp_path):
    text = "Write to a@b.ch now, or\nagain to a@b.ch, or to c@d.ch."
    spark.createDataFrame([(1, text), (2, "none")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.start, r.original_text, r.excerpt_before) for r in QUERIES["contact_excerpts"](spark, str(tmp_path)).collect())
    assert [(a, b) for a, b, _ in got] == [(9, "a@b.ch"), (33, "a@b.ch"), (47, "c@d.ch")]
    assert got[1][2].endswith("again to ")


def test_near_term_matches_against_brute_force(spark, tmp_path):
    text = "Thention, thestion and thntion; htention thention's xthentionx worthles Worthless-like un-worthless worthlessly disgustin9"
    spark.createDataFrame([(1, text), (2, "thention"), (3, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.term, r.how): r.n for r in QUERIES["near_term_matches"](spark, str(tmp_path)).collect()}
    assert got == {(1, "thention", "exact"): 2, (1, "thention", "fuzzy"): 3, (1, "worthless", "exact"): 2, (1, "worthless", "fuzzy"): 1, (2, "thention", "exact"): 1}
