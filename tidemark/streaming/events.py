"""Event intake: dedupe, counts and current heads, as batches and as streams."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame) -> DataFrame:
    """Time zone-less timestamps are cast, as watermarks need TIMESTAMP."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def dedupe(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key by time and id."""
    return events.groupBy(*keys).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("copies"))


def dedupe_stream(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return with_event_time(events).withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def daily_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def daily_counts_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    w = F.window("ts", "1 day")
    out = with_event_time(events).withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


def current_heads(batch: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """State after a micro-batch: the newest analysis of each key; one that completes late doesn't displace a newer."""
    return state.unionByName(batch).groupBy(*keys).agg(F.max_by("id", F.struct("created_at", "updated_at", "id")).alias("id"), F.max(F.struct("created_at", "updated_at", "id")).alias("m")).select(*keys, "id", F.col("m.created_at").alias("created_at"), F.col("m.updated_at").alias("updated_at"))


# Actions of a pull request that start an analysis, and the states of a scan in order.
ACTIONS = ("opened", "synchronize", "reopened")
STATES = ("pending", "queued", "ingesting", "scanning", "parsing", "analyzing", "scoring", "completed", "failed")
FINAL = ("completed", "failed")


def pull_requests(events: DataFrame) -> DataFrame:
    """The pull requests to analyse among webhook ``events`` (event_name, payload as JSON text), for batches and streams.

    Other events and actions drop out; a request without its number, repository
    or commits is marked malformed, so that one bad event doesn't stop a stream.
    """
    at = lambda path: F.get_json_object("payload", path)
    wanted = events.where((F.col("event_name") == "pull_request") & at("$.action").isin(*ACTIONS))
    out = wanted.withColumns({
        "owner": F.coalesce(at("$.repository.owner.login"), at("$.repository.owner.name")), "repo": at("$.repository.name"), "pr_number": at("$.pull_request.number").cast("int"),
        "base_sha": at("$.pull_request.base.sha"), "head_sha": at("$.pull_request.head.sha"), "base_branch": at("$.pull_request.base.ref"), "head_branch": at("$.pull_request.head.ref"),
    })
    needed = [F.col(c).cast("string") for c in ("owner", "repo", "pr_number", "base_sha", "head_sha")]
    missing = needed[0].isNull()
    for c in needed:
        missing = missing | c.isNull() | (c == "")
    return out.withColumn("is_malformed", missing)


def signed(events: DataFrame, secret: str, payload: str = "payload", signature: str = "signature") -> DataFrame:
    """``events`` with is_signed: whether the signature (``sha256=`` and the hex HMAC) fits the payload; compared in constant time."""

    @F.pandas_udf("boolean")
    def fits(body: pd.Series, said: pd.Series) -> pd.Series:
        def one(b, s) -> bool:
            if not secret or b is None or not s or not s.startswith("sha256="):
                return False
            want = hmac.new(secret.encode(), b.encode() if isinstance(b, str) else bytes(b), hashlib.sha256).hexdigest()
            return hmac.compare_digest(want.encode(), s[7:].strip().encode())

        return pd.Series([one(b, s) for b, s in zip(body, said)], dtype=bool)

    return events.withColumn("is_signed", fits(F.col(payload), F.col(signature)))


def scan_states(events: DataFrame) -> DataFrame:
    """The state of each scan from its ``events`` (scan_id, status, ts): its first final one, else the latest; of one time the furthest."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), F.col("status")), F.lit(0))
    final = F.col("status").isin(*FINAL)
    out = events.groupBy("scan_id").agg(
        F.min_by(F.when(final, F.col("status")), F.when(final, F.struct("ts", order.alias("o")))).alias("ended"), F.max_by("status", F.struct("ts", order.alias("o"))).alias("last"), F.min("ts").alias("started_at"), F.max("ts").alias("updated_at")
    )
    return out.select("scan_id", F.coalesce("ended", "last").alias("status"), F.col("ended").isNotNull().alias("is_final"), "started_at", "updated_at")
