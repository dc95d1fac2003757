"""Sharing and governance: grants, access, sticky roles, sequences. Batch forms; streaming/state.py has the stateful ones."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.tables import written
from . import sweep


def grant_state(events: DataFrame) -> DataFrame:
    """The state of each grant from events (doc_id, recipient, action, at, seq, ttl): issue, revoke or other.

    An issue opens a grant; the next issue to the same recipient of the document revokes it, as a revoke does; it expires
    ttl seconds after its issue. status is as of its end: replaced, revoked, or live until expires_at.
    """
    order = Window.partitionBy("doc_id", "recipient").orderBy("at", "seq")
    e = events.filter(F.col("action").isin("issue", "revoke")).withColumn("next", F.lead("action").over(order)).withColumn("next_at", F.lead("at").over(order))
    g = e.filter("action = 'issue'").withColumn("expires_at", F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ttl")))
    ended = F.col("next_at") < F.col("expires_at")
    return g.select("doc_id", "recipient", "seq", "at", "expires_at", F.when(ended & (F.col("next") == "issue"), "replaced").when(ended, "revoked").otherwise("live").alias("status"))


def downloads(requests: DataFrame, grants: DataFrame, revisions: DataFrame) -> DataFrame:
    """allowed, or why not, for requests (token, at): unknown, expired or revoked, or another revision by now."""
    j = requests.join(grants, "token", "left").join(revisions, "doc_id", "left")
    gone = F.col("revoked") | (F.col("expires_at") <= F.col("at"))
    return j.withColumn("outcome", F.when(F.col("doc_id").isNull(), "not_found").when(gone, "expired_or_revoked").when(F.col("current") != F.col("revision"), "version_changed").otherwise("allowed"))


def selection(selected, reveal):
    """What stays hidden: the selection without what is revealed, in order."""
    return F.array_sort(F.array_except(selected, reveal))


def value_levels(roles, protected, own):
    """Levels of a value: its own without an entity; else both protected ones for protected or unknown people, or public."""
    both = F.array(F.lit(fixed.PRIVATE), F.lit(fixed.SECRECY))
    return F.when(roles.isNull(), own).when(protected | F.array_contains(roles, "unknown"), both).otherwise(F.array(F.lit(fixed.PUBLIC)))


def access(requests: DataFrame) -> DataFrame:
    """The first reason against a reveal, or allowed, for rows (user_org, org, assigned, value_levels, revoked, expires_at, at, granted, capable)."""
    uncovered = F.size(F.array_except("value_levels", F.array_intersect("granted", "capable"))) > 0
    return requests.withColumn("outcome", F.when(F.col("user_org") != F.col("org"), "other_organisation").when(~F.col("assigned"), "not_assigned").when(F.col("value_levels").isNull(), "unknown_token").when(F.coalesce("revoked", F.lit(True)), "revoked").when(F.col("expires_at") <= F.col("at"), "expired").when(uncovered, "levels_not_covered").otherwise("allowed"))


#: --- fixed values: roles that protect, and those that a correction may name ---
PROTECTING, CORRECTING = ["client", "plaintiff", "opposing_party"], ["lawyer", "judge"]


def roles(events: DataFrame) -> DataFrame:
    """Roles and protection of each person from (entity_id, seq, role, clears): roles add up and protection stays, until a
    correction to a non-client role starts anew."""
    order = Window.partitionBy("entity_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    clears = F.col("clears") & F.col("role").isin(CORRECTING)
    e = events.filter(~F.col("clears") | clears).withColumn("era", F.sum(clears.cast("int")).over(order))
    last = e.groupBy("entity_id").agg(F.max("era").alias("era"))
    now = e.join(last, ["entity_id", "era"]).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role"))).alias("i"), F.max(F.col("role").isin(PROTECTING) & ~F.col("clears")).alias("protected"))
    return now.select("entity_id", F.array_distinct(F.transform("i", lambda x: x["role"])).alias("roles"), "protected")


def policy_versions(events: DataFrame, run: str = "run_id") -> DataFrame:
    """Adds sequence (from 1) and policy_version (changes so far) to (run_id, at, seq, changes)."""
    order = Window.partitionBy(run).orderBy("at", "seq")
    return events.withColumn("sequence", F.row_number().over(order)).withColumn("policy_version", F.sum(F.col("changes").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def sessions(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Sliding sessions: a key's events, none `minutes` or more after the one before; they end that long after the last."""
    g = events.groupBy("user_id", F.session_window("ts", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n")


#: Seconds that a grant may last, and grants at most that a store holds at a time.
TTL, MOST_GRANTS = (1, 3600), 100


def may_ask(requests: DataFrame, documents: DataFrame, findings: DataFrame) -> DataFrame:
    """requests with refused: the first reason against each that doesn't depend on other requests, or null.

    requests: request_id, doc_id, revision, selected_ids, reveal_ids, ttl; documents: doc_id, analysed, current; findings:
    doc_id, finding_id. Nulls in revision, ttl or documents count against the request.
    """
    asked = requests.select("request_id", "doc_id", F.explode(F.array_union("selected_ids", "reveal_ids")).alias("finding_id"))
    odd = asked.join(findings.select("doc_id", "finding_id").distinct(), ["doc_id", "finding_id"], "left_anti").groupBy("request_id").agg(F.count("*").alias("odd"))
    j = requests.join(documents, "doc_id", "left").join(odd, "request_id", "left")
    refused = (
        F.when(~F.coalesce(F.col("ttl").between(*TTL), F.lit(False)), "invalid_ttl")
        .when(~F.coalesce(F.col("analysed") & (F.col("revision") == F.col("current")), F.lit(False)), "version_changed")
        .when(F.col("odd") > 0, "unknown_finding")
    )
    return j.withColumn("refused", refused).drop("analysed", "current", "odd")


def crowded(requests: DataFrame, grants: DataFrame, most: int) -> DataFrame:
    """requests with stretch (a number, in order of time within its store) and full: whether grants could reach the limit in it.

    Were every request issued, a store's live grants at a moment would be a running sum over starts and ends. Where it falls
    to nothing, a new stretch begins: what comes after doesn't depend on what came before. Where it never exceeds `most`
    within a stretch, each request of it is issued, whatever the others; only full stretches need their order.
    """
    held = grants.select("store", F.lit(None).cast("timestamp").alias("starts"), F.col("expires_at").alias("ends"))
    new = requests.select("store", F.col("at").alias("starts"), (F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ttl"))).alias("ends"))
    far = F.lit("0001-01-01").cast("timestamp")
    both = held.unionByName(new)
    up, down = both.select("store", F.coalesce("starts", far).alias("at"), F.lit(1).alias("n")), both.select("store", F.col("ends").alias("at"), F.lit(-1).alias("n"))
    steps = up.unionByName(down).groupBy("store", "at").agg(F.sum("n").alias("n"))
    live = written(sweep.running(steps, ["store"], ["at"], "n", "live"))
    # The moments at which nothing is left are the ends of stretches: a moment's stretch is how many came before.
    ends = sweep.running(live.withColumn("ends", (F.col("live") == 0).cast("int")), ["store"], ["at"], "ends", "after").withColumn("stretch", F.col("after") - F.col("ends"))
    ends = written(ends.select("store", "at", "live", "stretch"))
    full = ends.groupBy("store", "stretch").agg((F.max("live") > most).alias("full"))
    # An end and a start at one moment: the new grant begins a stretch of its own or goes on with what is still live.
    at = ends.select(F.col("store").alias("e_store"), F.col("at").alias("e_at"), "stretch")
    j = requests.join(at, F.col("store").eqNullSafe(F.col("e_store")) & (F.col("at") == F.col("e_at"))).drop("e_store", "e_at")
    f = full.select(F.col("store").alias("f_store"), F.col("stretch").alias("f_stretch"), "full")
    return j.join(f, F.col("store").eqNullSafe(F.col("f_store")) & (F.col("stretch") == F.col("f_stretch"))).drop("f_store", "f_stretch")


def admit(requests: DataFrame, grants: DataFrame, most: int = MOST_GRANTS) -> DataFrame:
    """requests (store, request_id, at, seq, ttl and more) with issued: whether fewer than `most` grants of the store were live.

    In order of at and seq, each issued request holds a place until it expires, as do grants (store, expires_at) from
    before; a revoked grant holds its place until then, too. A stretch in which the limit can't be reached needs no
    order; in a full one the requests stream, in order, past the at most `most` ends of live grants.
    """
    marked = written(crowded(requests, grants, most))
    key = ["store", "stretch"]
    held = grants.select("store", F.lit(0).cast("bigint").alias("stretch"), F.lit(None).cast("string").alias("request_id"), F.lit(0).cast("bigint").alias("t"), F.lit(None).cast("bigint").alias("seq"), F.unix_micros("expires_at").alias("until"))
    asked = marked.filter("full").select(*key, "request_id", F.unix_micros("at").alias("t"), F.col("seq").cast("bigint").alias("seq"), (F.unix_micros("at") + F.col("ttl") * 1_000_000).alias("until"))
    some = marked.filter("full").select(*key).distinct().withColumnsRenamed({"store": "k_store", "stretch": "k_stretch"})
    held = held.join(some, F.col("store").eqNullSafe(F.col("k_store")) & (F.col("stretch") == F.col("k_stretch")), "left_semi")

    def step(ends: list[int], row: dict) -> Iterator[tuple]:
        if row["request_id"] is None:
            heapq.heappush(ends, row["until"])
            return
        while ends and ends[0] <= row["t"]:
            heapq.heappop(ends)
        ok = len(ends) < most
        if ok:
            heapq.heappush(ends, row["until"])
        yield row["request_id"], ok

    told = sweep.folded_in_order(held.unionByName(asked), key, [F.col("request_id").isNotNull(), "t", "seq", "request_id"], "request_id string, issued boolean", list, step)
    told = told.select(F.col("request_id").alias("t_id"), "issued")
    return marked.join(told, F.col("full") & (F.col("request_id") == F.col("t_id")), "left").withColumn("issued", F.coalesce("issued", F.lit(True))).drop("t_id", "stretch", "full")


def issue(requests: DataFrame, documents: DataFrame, findings: DataFrame, grants: DataFrame, most: int = MOST_GRANTS) -> DataFrame:
    """The first reason against each request to share on its own, or issued; with what stays hidden and the grants it replaces.

    requests: request_id, doc_id, recipient, revision, selected_ids, reveal_ids, ttl, at; documents and findings: see
    may_ask(); grants: token, g_doc, g_recipient, expires_at, revoked. Grants that have expired don't count for the limit of
    `most`. Each request is judged against the grants as given, as if it were the only one; see issue_in_order().
    """
    j = may_ask(requests, documents, findings)
    moments = requests.select("at").distinct()
    live = sweep.live_at(moments, grants.select(F.lit(None).cast("timestamp").alias("starts"), F.col("expires_at").alias("ends")), [])
    same = requests.select("request_id", "doc_id", "recipient", "at").join(grants, (F.col("doc_id") == F.col("g_doc")) & (F.col("recipient") == F.col("g_recipient")) & ~F.col("revoked") & (F.col("expires_at") > F.col("at")))
    replaced = same.groupBy("request_id").agg(F.array_sort(F.collect_list("token")).alias("replaced"))
    j = j.join(live, "at", "left").join(replaced, "request_id", "left")
    outcome = F.coalesce("refused", F.when(F.col("live") >= most, "too_many_grants").otherwise("issued"))
    none = F.array().cast("array<string>")
    gone = F.when(F.col("outcome") == "issued", F.coalesce("replaced", none)).otherwise(none)
    return j.withColumn("outcome", outcome).select("request_id", "outcome", selection(F.col("selected_ids"), F.col("reveal_ids")).alias("hidden"), gone.alias("replaced"))


def issue_in_order(requests: DataFrame, documents: DataFrame, findings: DataFrame, grants: DataFrame, most: int = MOST_GRANTS) -> DataFrame:
    """issue(), with each request seeing the grants that earlier ones were given.

    requests: request_id, doc_id, recipient, revision, selected_ids, reveal_ids, ttl, at, and, where they have them, store
    (whose limit counts; one for all otherwise) and seq (order within a moment; otherwise request_id's). documents and
    findings: see may_ask(). grants from before: token, g_doc, g_recipient, expires_at, revoked, and store like requests.

    Requests are judged in order: each sees the grants that earlier ones were issued, so the one after the `most`th live
    grant of a store is refused; see admit(). An issued grant replaces those of the same document and recipient that are
    live and not revoked: from before, or the last one issued, whose token is its request_id.
    """
    if "store" not in requests.columns:
        requests, grants = requests.withColumn("store", F.lit(0)), grants.withColumn("store", F.lit(0))
    if "seq" not in requests.columns:
        requests = requests.withColumn("seq", F.lit(0))
    judged = written(may_ask(requests, documents, findings))
    some = admit(judged.filter("refused is null").select("store", "request_id", "at", "seq", "ttl"), grants, most).select(F.col("request_id").alias("a_id"), "issued")
    j = written(judged.join(some, F.col("request_id") == F.col("a_id"), "left").drop("a_id").withColumn("outcome", F.coalesce("refused", F.when(F.col("issued"), "issued").otherwise("too_many_grants"))))
    until = F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ttl"))
    order = Window.partitionBy("doc_id", "recipient").orderBy("at", "seq", "request_id")
    own = j.filter("outcome = 'issued'").withColumn("until", until).withColumn("last", F.lag(F.struct("request_id", "until")).over(order))
    own = written(own.select("request_id", "doc_id", "recipient", "at", "last"))
    g = grants.filter(~F.col("revoked")).select("token", F.col("g_doc"), F.col("g_recipient"), "expires_at")
    old = own.filter("last is null").join(g, (F.col("doc_id") == F.col("g_doc")) & (F.col("recipient") == F.col("g_recipient")) & (F.col("expires_at") > F.col("at"))).groupBy("request_id").agg(F.array_sort(F.collect_list("token")).alias("replaced"))
    new = own.filter(F.col("last.until") > F.col("at")).select("request_id", F.array("last.request_id").alias("replaced"))
    none = F.array().cast("array<string>")
    got = j.join(old.unionByName(new).withColumnRenamed("request_id", "r_id"), F.col("request_id") == F.col("r_id"), "left")
    return got.select("request_id", "outcome", selection(F.col("selected_ids"), F.col("reveal_ids")).alias("hidden"), F.coalesce("replaced", none).alias("replaced"))


def identity(requests: DataFrame, runs: DataFrame, sessions_: DataFrame) -> DataFrame:
    """Who asks (run_id, token, at, as_curator): the user, and the first reason against it, or allowed.

    runs: run_id, run_org, run_expires; sessions_: run_id, token, user_id, user_org, session_expires. A session ends with its run.
    """
    j = requests.join(runs, "run_id", "left").join(sessions_, ["run_id", "token"], "left")
    ends = F.least("session_expires", "run_expires")
    outcome = (
        F.when(~F.coalesce(F.col("run_expires") > F.col("at"), F.lit(False)), "no_run")
        .when(~F.coalesce(ends > F.col("at"), F.lit(False)), "no_session")
        .when(F.col("as_curator") & ((F.col("user_id") != "curator") | (F.col("user_org") != F.col("run_org"))), "not_curator")
        .when(F.col("user_org") != F.col("run_org"), "other_organisation")
        .otherwise("allowed")
    )
    return j.withColumn("outcome", outcome)
