"""Link audit over tables of observations: rules, states, streaks, tombstones."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import addresses
from heddle.functions.links import host_suffixes

CONFIRMABLE = ("expired", "content_mismatch")
MAX_HOPS = 5

# Classes of transport errors and the reasons they give.
TRANSPORT_REASONS = {"timeout": "timeout", "canceled": "canceled", "dns": "dns_failure", "tls": "tls_failure", "connection": "connection_failure", "redirect": "redirect_failure", "body": "body_read_failure"}
OTHER_TRANSPORT = "transport_failure"

# Address blocks that may not be fetched.
UNSAFE_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.31.196.0/24", "192.52.193.0/24", "192.88.99.0/24", "192.168.0.0/16",
    "192.175.48.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
# The IPv6 block of public unicast addresses, and blocks inside it that may not be fetched.
PUBLIC_IPV6 = "2000::/3"
UNSAFE_IPV6 = ("2001::/23", "2001:db8::/32", "2002::/16", "2620:4f:8000::/48", "3fff::/20")

def candidates(entries: DataFrame, inspected: str = "link") -> DataFrame:
    """Distinct HTTP links of a catalog: ``inspected`` is the struct of ``links.with_link``."""
    link = F.col(inspected)
    return entries.filter(link["rejection"].isNull() & link["scheme"].isin("http", "https")).select(F.sha2(link["canonical"], 256).alias("sha256"), link["host"].alias("host"), link["canonical"].alias("url")).dropDuplicates(["sha256"])


def match_rule(rows: DataFrame, rules: DataFrame, host: str = "host", how: str = "left") -> DataFrame:
    """``rows`` with ``rule_ord``: the first of ``rules`` (rule_ord, host_suffix) whose suffix is
    the host or a parent domain of it.  Suffixes are keys, so this is an equi-join; hosts
    are matched once each, however many rows they have."""
    hosts = rows.select(F.col(host).alias("_host")).filter(F.col("_host").isNotNull()).distinct()
    each = hosts.select("_host", F.explode(host_suffixes("_host")).alias("host_suffix"))
    found = each.join(rules.select("host_suffix", "rule_ord"), "host_suffix").groupBy("_host").agg(F.min("rule_ord").alias("rule_ord"))
    return rows.join(found, rows[host] == found["_host"], how).drop("_host")


def classify(observations: DataFrame, rules: Sequence[dict] = ()) -> DataFrame:
    """``observations`` (http_status, body, transport_error, rule_ord) with state and reason, by
    fixed precedence: transport errors, gone pages, the rule's dead statuses and bodies,
    blocked, server errors, then the rule's body checks.

    A rule is rule_ord, dead_statuses, dead_body, mismatch_body, required_body; patterns are
    literals, so each is compiled once."""
    status, body, rule = F.col("http_status"), F.coalesce(F.col("body"), F.lit("")), F.col("rule_ord")
    no = F.lit(False)
    dead_status, dead_body, mismatch, missing = no, no, no, no
    for r in rules:
        mine = rule.eqNullSafe(F.lit(r["rule_ord"]))
        if r.get("dead_statuses"):
            dead_status = dead_status | (mine & status.isin(*r["dead_statuses"]))
        for p in r.get("dead_body", ()):
            dead_body = dead_body | (mine & body.rlike(f"(?u){p}"))
        for p in r.get("mismatch_body", ()):
            mismatch = mismatch | (mine & body.rlike(f"(?u){p}"))
        for p in r.get("required_body", ()):
            missing = missing | (mine & ~body.rlike(f"(?u){p}"))
    error = F.coalesce(F.col("transport_error"), F.lit(""))
    named = F.lit(OTHER_TRANSPORT)
    for kind, reason in TRANSPORT_REASONS.items():
        named = F.when(error == kind, reason).otherwise(named)
    ok = status.between(200, 299)
    pair = lambda s, r: F.struct(F.lit(s).alias("state"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    out = (
        F.when(error != "", pair("transient", named))
        .when(status.isin(404, 410), pair("expired", "global_dead_status"))
        .when(dead_status, pair("expired", "dead_status"))
        .when(dead_body, pair("expired", "dead_body"))
        .when(status.isin(401, 403, 429, 451), pair("blocked", "blocked_status"))
        .when(status.between(500, 599), pair("transient", "server_status"))
        .when(ok & mismatch, pair("content_mismatch", "mismatch_body"))
        .when(ok & missing, pair("content_mismatch", "required_body_missing"))
        .when(ok, pair("live", "ok"))
        .otherwise(pair("unknown", "unhandled_http_status"))
    )
    return observations.withColumn("_r", out).withColumns({"state": F.col("_r.state"), "reason": F.col("_r.reason")}).drop("_r")


def advance(current: DataFrame, previous: DataFrame, key: str = "sha256") -> DataFrame:
    """``current`` with ``confirmations``: one more than in ``previous`` for the same state, 1 for
    a new one, 0 for states that need none.  Keys that are not in ``current`` are lost."""
    old = previous.select(F.col(key).alias("_k"), F.col("state").alias("_state"), F.col("confirmations").alias("_n"))
    out = current.join(old, current[key] == F.col("_k"), "left")
    n = F.when(~F.col("state").isin(*CONFIRMABLE), 0).when(F.col("_state") == F.col("state"), F.col("_n") + 1).otherwise(1)
    return out.select(*[current[c] for c in current.columns], n.alias("confirmations"))


def streaks(history: DataFrame, key: str, order: Sequence[str], state: str = "state") -> DataFrame:
    """Per key the last state and how many times in a row it was seen (0 for states that need
    no confirmation).

    One aggregation: the last position, and the last position of another state; so no task
    sorts all rows of a key."""
    at = F.struct(*order)
    last = history.groupBy(key).agg(F.max(F.struct(at.alias("at"), F.col(state).alias("state"))).alias("last")).select(F.col(key).alias("_k"), F.col("last.state").alias("last_state"), F.col("last.at").alias("last_at"))
    joined = history.join(last, history[key] == F.col("_k"))
    other = joined.groupBy(key, "last_state", "last_at").agg(F.max(F.when(F.col(state) != F.col("last_state"), at)).alias("other"))
    back = other.select(F.col(key).alias("_k2"), "last_state", "last_at", "other")
    run = history.join(back, history[key] == F.col("_k2")).groupBy(key, "last_state", "last_at").agg(F.count_if(F.col("other").isNull() | (at > F.col("other"))).alias("run"))
    n = F.when(F.col("last_state").isin(*CONFIRMABLE), F.col("run")).otherwise(F.lit(0))
    return run.select(key, F.col("last_state").alias("state"), n.alias("confirmations"), "last_at")


def new_tombstones(report: DataFrame, tombstones: DataFrame, required: int, checked_at: str = "checked_at") -> DataFrame:
    """Rows to insert: links confirmed often enough that have no tombstone yet."""
    due = report.filter(F.col("state").isin(*CONFIRMABLE) & (F.col("confirmations") >= required))
    return due.join(tombstones.select("sha256").distinct(), "sha256", "left_anti").select("sha256", F.col("state").alias("reason"), F.col(checked_at).alias("confirmed_at"))


def state_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("state").count()


def probe_plan(heads: DataFrame, rules: DataFrame, body_limit: int = 1 << 20) -> DataFrame:
    """What to fetch after a first HEAD: ``heads`` (sha256, http_status, transport_error,
    rule_ord), ``rules`` (rule_ord, dead_statuses, needs_body, body_limit).

    A HEAD that failed in transport ends the probe.  One that the server does not support (405,
    501) and one that says gone (404, 410, or a dead status of the rule) is asked again by
    GET; so is success where the rule has body checks.  Without body checks one byte is
    enough; ``then`` says that a GET refused with 416 is repeated without a range.

    Rules may say ``dead_body`` and ``success_body`` (booleans) for ``needs_body``; then ``read_body`` tells
    whether the GET's body is read: ``always``, ``on_success`` (2xx) or ``never``."""
    if "dead_body" in rules.columns:
        rules = rules.withColumn("needs_body", F.coalesce("dead_body", F.lit(False)) | F.coalesce("success_body", F.lit(False)))
    out = heads.join(rules, "rule_ord", "left")
    status = F.col("http_status")
    arrived = (F.coalesce("transport_error", F.lit("")) == "") & status.isNotNull()
    again = status.isin(405, 501) | status.isin(404, 410) | F.coalesce(F.array_contains("dead_statuses", status), F.lit(False))
    body = F.coalesce("needs_body", F.lit(False)) & (again | status.between(200, 299))
    asked = arrived & (again | body)
    read = [F.when(F.coalesce(asked & F.col("dead_body"), F.lit(False)), "always").when(F.coalesce(asked & F.col("success_body"), F.lit(False)), "on_success").otherwise("never").alias("read_body")] if "dead_body" in rules.columns else []
    return out.select(
        "sha256",
        *read,
        F.coalesce(arrived & (again | body), F.lit(False)).alias("needs_get"),
        F.when(arrived & body, F.coalesce("body_limit", F.lit(body_limit))).when(arrived & again, 1).otherwise(0).cast("long").alias("byte_limit"),
        F.when(arrived & (again | body), "repeat_without_range_on_416").alias("then"),
    )


def redirect_verdict(hops: DataFrame, allowed: DataFrame) -> DataFrame:
    """Per chain (``hops``: chain, hop from 1, origin_host, host, rejection): whether all hops go
    to the origin, a host that ``allowed`` (origin_host, host_suffix) lists or a host below it,
    to links that are not rejected, in ``MAX_HOPS`` hops at most."""
    each = hops.select("chain", "hop", "origin_host", "host", "rejection", F.explode(host_suffixes("host")).alias("host_suffix"))
    listed = each.join(allowed.distinct(), ["origin_host", "host_suffix"], "left_semi").select("chain", "hop").distinct().withColumn("listed", F.lit(True))
    judged = hops.join(listed, ["chain", "hop"], "left")
    fine = (F.col("host") == F.col("origin_host")) | F.coalesce("listed", F.lit(False))
    return judged.groupBy("chain").agg(F.max("hop").alias("hops"), F.count_if(~fine).alias("foreign"), F.count_if(F.col("rejection").isNotNull()).alias("rejected")).select(
        "chain", "hops", F.when(F.col("hops") > MAX_HOPS, "too_many_hops").when(F.col("rejected") > 0, "unsafe_target").when(F.col("foreign") > 0, "foreign_host").otherwise("follow").alias("verdict")
    )


def unsafe_blocks() -> list[str]:
    """The blocks that may not be fetched: listed ones, and all of IPv6 that is not public unicast."""
    around = [str(n) for n in ipaddress.ip_network("::/0").address_exclude(ipaddress.ip_network(PUBLIC_IPV6))]
    return [*UNSAFE_IPV4, *UNSAFE_IPV6, *sorted(around)]


def unsafe_addresses(rows: DataFrame, blocks: DataFrame, host: str = "host", ip: str = "ip") -> DataFrame:
    """Per host whether any of its addresses (texts; what is none is unsafe) is in one of ``blocks``
    (block: a text like ``10.0.0.0/8``, of any length).

    A search down a trie, all its levels at once: an address meets the blocks of each length that
    occurs by its first bits.  Each address is parsed and sought once, however many hosts have it."""
    known = blocks.select(addresses.block("block").alias("b")).filter("b is not null").select("b.*").distinct()
    lengths = sorted(r[0] for r in known.select("bits").distinct().collect())  # 129 at most
    each = rows.select(ip).filter(F.col(ip).isNotNull()).distinct().select(ip, addresses.parse(ip).alias("_a"))
    steps = F.array(*[F.struct(F.lit(n).alias("bits"), addresses.head(F.col("_a"), n).alias("k")) for n in lengths]).cast(f"array<struct<bits:int,k:{addresses.ADDRESS}>>")
    sought = each.filter("_a is not null").select(ip, F.explode(steps).alias("s")).select(ip, "s.bits", "s.k.*")
    met = sought.join(known, ["v", "hi", "lo", "bits"], "left_semi").select(F.col(ip).alias("_bad"))
    bad = met.unionByName(each.filter("_a is null").select(F.col(ip).alias("_bad"))).distinct()
    found = F.col("_bad").isNotNull() | F.col(ip).isNull()
    return rows.join(bad, rows[ip] == F.col("_bad"), "left").groupBy(host).agg(F.max(found).alias("unsafe"))
