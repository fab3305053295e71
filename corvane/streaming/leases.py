"""Leases and work items in keyed state, with event-time timers, fencing tokens and compare-and-set."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "target string, agent string, action string, granted boolean, error string, held_by string, token bigint, expires_ms bigint, status string"
STATE = "agent string, expires_ms bigint, token bigint, status string"
#: How late a request may come, and how long a closed item refuses claims here (then the table of items knows).
LATE, CLOSED_MS = "10 minutes", 7 * 86_400_000
LONGEST_TTL_MS = 86_400_000


def needs_state_store(spark: SparkSession) -> None:
    """Keyed state with timers is held in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LeaseProcessor(StatefulProcessor):
    """One target: who holds it until when, under which token.

    acquire: granted where it is free or has run out.  renew, release: by the holder, and where the request names a token,
    with that token only.  claim: acquires and puts the item to work; a closed one is refused.  close: by the holder, ends
    lease and item.  handoff: a message about the item, no lease needed.  Tokens of a target only grow, so whoever acts
    on an old one can be told from the holder.  Event time decides; a timer at the end of each lease removes its state.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", STATE)

    def _set(self, agent: str | None, expires: int, token: int, status: str) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.held.update((agent, expires, token, status))
        self.handle.registerTimer(expires)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.held.get() if self.held.exists() else None
        agent, expires, token, status = tuple(state) if state else (None, 0, 0, "open")
        changed = False
        for r in sorted(rows, key=lambda r: (r.ts, r.agent or "", r.action or "")):
            now = int(r.ts.timestamp() * 1000)
            ttl = r.ttl_ms if r.ttl_ms and r.ttl_ms > 0 else self.ttl_ms
            if agent is not None and expires <= now:
                agent = None
            if status == "in_progress" and agent is None:
                status = "open"
            if not r.agent:
                error = "invalid_agent_id"
            elif r.action in ("acquire", "renew", "claim") and ttl > LONGEST_TTL_MS:
                error = "invalid_ttl"
            elif status == "closed" and r.action in ("claim", "close"):
                error = "invalid_status"
            elif r.action in ("acquire", "claim"):
                error = "already_leased" if agent is not None else None
            elif r.action in ("renew", "release", "close"):
                error = "lease_not_found" if agent is None else "not_owner" if agent != r.agent else "stale_token" if r.token is not None and r.token != token else None
            else:
                error = None if r.action == "handoff" else "invalid_action"
            holder = agent
            if error is None and r.action != "handoff":
                changed = True
                if r.action in ("acquire", "claim"):
                    agent, expires, token, status = r.agent, now + ttl, max(token + 1, now), "in_progress" if r.action == "claim" else status
                elif r.action == "renew":
                    expires = now + ttl
                elif r.action == "release":
                    agent, status = None, "open" if status == "in_progress" else status
                else:
                    agent, expires, status = None, now + CLOSED_MS, "closed"
            live = error is None and agent is not None and r.action != "handoff"
            yield Row(target=key[0], agent=r.agent, action=r.action, granted=error is None, error=error, held_by=holder if error == "already_leased" else None, token=token if live else None, expires_ms=expires if live else None, status=status)
        if changed:  # a released lease stays as a token until its end, so that the next one is larger
            self._set(agent, expires, token, status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        agent, expires, token, status = tuple(self.held.get()) if self.held.exists() else (None, 0, 0, "open")
        if expires <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            if agent is not None:
                yield Row(target=key[0], agent=agent, action="expire", granted=True, error=None, held_by=None, token=token, expires_ms=expires, status="open")

    def close(self) -> None:
        pass


def lease_requests(requests: DataFrame, ttl_ms: int, late: str = LATE) -> DataFrame:
    """What becomes of each request (target, agent, action, ts; ttl_ms and token may follow), and of leases that run out."""
    needs_state_store(requests.sparkSession)
    has = requests.columns
    rows = requests.withWatermark("ts", late).select("target", "agent", "action", "ts", *((F.col(c) if c in has else F.lit(None)).cast("bigint").alias(c) for c in ("ttl_ms", "token")))
    return rows.groupBy("target").transformWithState(LeaseProcessor(ttl_ms), OUT, "Append", "EventTime")


def success_rate(answers: DataFrame) -> DataFrame:
    """The share of claims that were granted; 1 where there was none."""
    claims = answers.where("action = 'claim'")
    return claims.agg(F.coalesce(F.avg(F.col("granted").cast("double")), F.lit(1.0)).alias("claim_lease_success_rate"))
