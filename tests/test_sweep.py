"""Sweeps and ordered admission against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import sharing, sweep
from cloakframe.streaming import state

T = dt.datetime(2024, 1, 1)
S = lambda n: T + dt.timedelta(seconds=n)


def test_running_sums(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", None, "a"]), i, rnd.randrange(-3, 4)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    got = {r.i: r.out for r in sweep.running(df, ["k"], ["i"], "v", "out").collect()}
    assert got == {i: sum(v for k2, j, v in rows if k2 == k and j <= i) for k, i, _ in rows}
    assert sweep.running(df.limit(0), ["k"], ["i"], "v", "out").collect() == []


def test_live_at_a_moment_needs_no_nested_loop(spark):
    rnd = random.Random(3)
    spans = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(50)]), rnd.randrange(60)) for _ in range(200)]
    moments = [(rnd.choice(["a", "b", "c", None]), rnd.randrange(70)) for _ in range(80)] * 2
    s = spark.createDataFrame([(k, None if a is None else S(a), S(b)) for k, a, b in spans], "k string, starts timestamp, ends timestamp")
    m = spark.createDataFrame([(k, S(t)) for k, t in moments], "k string, at timestamp")
    out = sweep.live_at(m, s, ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sorted((str(k), t, sum(1 for k2, a, b in spans if k2 == k and (a is None or a <= t) and (b > t))) for k, t in moments)
    assert sorted((str(r.k), int((r["at"] - T).total_seconds()), r.live) for r in out.collect()) == want


def admitted_brute(requests, grants, most):
    live, out = {}, {}
    for store, until in grants:
        live.setdefault(store, []).append(until)
    for store, rid, at, seq, ttl in sorted(requests, key=lambda r: (r[2], r[3], r[1])):
        live[store] = [e for e in live.get(store, []) if e > at]
        out[rid] = len(live[store]) < most
        if out[rid]:
            live[store].append(at + ttl)
    return out


@pytest.mark.parametrize("most", [1, 3, 100])
def test_admission_in_order(spark, most):
    rnd = random.Random(most)
    requests = [(rnd.choice([1, 1, 1, 2, None]), f"r{i}", rnd.randrange(900), i % 3, rnd.choice([1, 5, 40])) for i in range(300)]
    grants = [(rnd.choice([1, 2, None]), rnd.randrange(30)) for _ in range(6)]
    r = spark.createDataFrame([(a, b, S(c), d, e) for a, b, c, d, e in requests], "store int, request_id string, at timestamp, seq int, ttl int")
    g = spark.createDataFrame([(a, S(b)) for a, b in grants], "store int, expires_at timestamp")
    assert {x.request_id: x.issued for x in sharing.admit(r, g, most).collect()} == admitted_brute(requests, grants, most)
    marked = sharing.crowded(r, g, most)
    if most == 100:  # nothing is full: no request is ordered
        assert marked.filter("full").count() == 0
    assert sharing.admit(r.limit(0), g, most).collect() == []


def test_the_hundred_and_first_of_a_batch_is_refused(spark):
    n = 104
    r = spark.createDataFrame([(f"r{i:03}", "d", "x" if i < 2 else f"p{i}", 1, ["f"], [], 60, S(0), i) for i in range(n)], "request_id string, doc_id string, recipient string, revision int, selected_ids array<string>, reveal_ids array<string>, ttl int, at timestamp, seq int")
    later = spark.createDataFrame([("s", "d", "x", 1, ["f"], [], 60, S(59), 0), ("t", "d", "x", 1, ["f"], [], 60, S(60), 0), ("u", "d", "x", 1, ["f"], [], 3601, S(61), 0), ("v", "d", "x", 2, ["f"], [], 60, S(61), 0)], r.schema)
    docs = spark.createDataFrame([("d", True, 1)], "doc_id string, analysed boolean, current int")
    f = spark.createDataFrame([("d", "f")], "doc_id string, finding_id string")
    g = spark.createDataFrame([("old", "d", "x", S(30), False), ("gone", "d", "x", S(30), True)], "token string, g_doc string, g_recipient string, expires_at timestamp, revoked boolean")
    got = {x.request_id: (x.outcome, x.replaced) for x in sharing.issue_in_order(r.unionByName(later), docs, f, g).collect()}
    # two grants from before hold a place each, the revoked one too, until they expire
    assert [k for k in sorted(got) if got[k][0] == "too_many_grants"] == [f"r{i:03}" for i in range(98, n)]
    assert got["r000"] == ("issued", ["old"]) and got["r001"] == ("issued", ["r000"]) and got["r002"] == ("issued", [])
    assert got["s"] == ("issued", ["r001"]) and got["t"] == ("issued", ["s"]) and got["u"][0] == "invalid_ttl" and got["v"][0] == "version_changed"


def test_admission_as_a_stream_gives_the_same(spark, tmp_path):
    rnd = random.Random(8)
    requests = sorted(((rnd.randrange(3), f"r{i}", rnd.randrange(500), i, rnd.choice([5, 40, 90])) for i in range(120)), key=lambda r: r[2])
    schema = "store int, request_id string, at timestamp, seq int, ttl int"
    for k in range(4):
        part = [(a, b, S(c), d, e) for a, b, c, d, e in requests[30 * k : 30 * k + 30]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = state.admissions(stream, 3).writeStream.format("memory").queryName("admissions").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.request_id: r.issued for r in spark.table("admissions").collect()}
    batch = spark.read.schema(schema).parquet(f"file://{tmp_path}/in")
    none = spark.createDataFrame([], "store int, expires_at timestamp")
    assert got == {r.request_id: r.issued for r in sharing.admit(batch, none, 3).collect()} and not all(got.values())


def test_folds_stream_through_sorted_keys(spark):
    df = spark.createDataFrame([(k, i) for k in ("a", "b", None) for i in (3, 1, 2)], "k string, i bigint")

    def step(state, row):
        state.append(row["i"])
        return iter(())

    got = sweep.folded_in_order(df, ["k"], ["i"], "seen array<bigint>", list, step, lambda s: [(s,)]).collect()
    assert sorted((str(r.k), r.seen) for r in got) == [("None", [1, 2, 3]), ("a", [1, 2, 3]), ("b", [1, 2, 3])]
    assert sweep.folded_in_order(df.filter(F.lit(False)), ["k"], ["i"], "seen array<bigint>", list, step, lambda s: [(s,)]).collect() == []
