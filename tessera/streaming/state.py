"""The stateful loops as Structured Streaming: triage queue, capture sessions, event logs. The batch forms in operators/timeline.py are their measure."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.timeline import CAP, DISMISS_DAYS, MERGE_SECONDS, MERGEABLE, QUEUE, TRUNCATED

PAGES, SESSION_SECONDS, PAUSE_MS, ADDRESSES = 200, 2 * 3600, 800, 30
#: Into how many states a queue without a cap is dealt.
PARTS = 64


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts by kind and day with a watermark."""
    return events.withWatermark("t", late).groupBy(F.window("t", width), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "2 hours") -> DataFrame:
    return events.withWatermark("t", late).groupBy(F.session_window("t", gap), "case_id").agg(F.count("*").alias("n")).select("case_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _load(state: GroupState, empty: dict) -> dict:
    return json.loads(state.get[0]) if state.exists else empty


def triage(actions: DataFrame, cap: int | None = QUEUE, parts: int = PARTS) -> DataFrame:
    """Actions (queue, ord, action: found, dismiss, take or forget, k, t) -> queue, k, n, dropped after each batch; the queue's cap bounds the state.

    Without a cap (None) nothing is dropped. A queue's keys then don't depend on each other, so they are dealt to `parts` states by hash, and each of these
    gets every `forget`. An action without a time lets no dismissal lapse; a dismissal without one is as old as the epoch."""
    own = F.array(F.lit(0) if cap is not None else F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int"))
    each = own if cap is not None else F.when(F.col("action") == "forget", F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(own)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = _load(state, {"items": {}, "gone": {}, "dropped": 0})
        for r in pd.concat(list(frames)).sort_values("ord").itertuples():
            now = 0.0 if pd.isna(r.t) else r.t.timestamp()
            s["gone"] = {k: t for k, t in s["gone"].items() if now - t <= DISMISS_DAYS * 86400}
            if r.action == "forget":
                s["gone"] = {}
            elif r.action in ("dismiss", "take"):
                s["items"].pop(r.k, None)
                if r.action == "dismiss":
                    s["gone"].setdefault(r.k, now)
            elif r.k not in s["gone"]:
                s["items"][r.k] = s["items"].get(r.k, 0) + 1
                while cap is not None and len(s["items"]) > cap:
                    s["items"].pop(next(iter(s["items"])))
                    s["dropped"] += 1
        state.update((json.dumps(s),))
        yield pd.DataFrame({"queue": key[0], "k": list(s["items"]), "n": list(s["items"].values()), "dropped": s["dropped"]})

    dealt = actions.select("*", F.explode(each).alias("part")).groupBy("queue", "part")
    return dealt.applyInPandasWithState(step, "queue long, k string, n long, dropped long", "s string", "update", GroupStateTimeout.NoTimeout)


def captures(pages: DataFrame) -> DataFrame:
    """Pages (session, ord, origin, tab, t, found) -> session, ord, accepted, reason: one tab and origin, 200 pages, two hours, 800 ms apart."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        s = _load(state, {})
        for r in pd.concat(list(frames)).sort_values("ord").itertuples():
            now = r.t.timestamp()
            s = s or {"tab": int(r.tab), "origin": r.origin, "start": now, "last": None, "pages": 0}
            tests = (
                ("tab", r.tab != s["tab"]), ("pages", s["pages"] >= PAGES), ("time", now - s["start"] >= SESSION_SECONDS), ("scheme", not r.origin.startswith(("http://", "https://"))), ("origin", r.origin != s["origin"]),
                ("pause", s["last"] is not None and (now - s["last"]) * 1000 < PAUSE_MS),
            )
            reason = next((name for name, no in tests if no), None)
            if reason is None:
                s["last"], s["pages"] = now, s["pages"] + 1
            out.append((key[0], r.ord, reason is None, reason))
        state.update((json.dumps(s),))
        yield pd.DataFrame(out, columns=["session", "ord", "accepted", "reason"])

    return pages.groupBy("session").applyInPandasWithState(step, "session long, ord long, accepted boolean, reason string", "s string", "append", GroupStateTimeout.NoTimeout)


class Log:
    """A case's event log: appending merges, drops and caps."""

    def __init__(self, events: list[dict] | None = None):
        self.events = events or []

    def append(self, e: dict, cap: int = CAP) -> None:
        last = self.events[-1] if self.events else None
        key = lambda x: x.get("source") if x["kind"] == "ioc.added" else x.get("value")
        if last and e["kind"] in MERGEABLE and last["kind"] == e["kind"] and key(last) == key(e) and e["t"] - last["t"] <= MERGE_SECONDS:
            self.events.pop()
            if e["kind"] == "ioc.added":
                e = {**e, "count": (last.get("count") or 0) + (e.get("count") or 0)}
            elif e["kind"] == "verdict.set":
                e = {**e, "from": last.get("from")}
            if e["kind"] == "verdict.set" and e["from"] == e.get("to"):
                return
        self.events.append(e)
        if len(self.events) > cap:
            first = self.events[0]
            gone = first["n"] if first["kind"] == TRUNCATED else 0
            body = self.events[1:] if first["kind"] == TRUNCATED else self.events
            gone, body = gone + len(body) + 1 - cap, body[len(body) + 1 - cap :]
            self.events = [{"t": body[0]["t"], "kind": TRUNCATED, "n": gone}, *body]


def logs(events: DataFrame, cap: int = CAP) -> DataFrame:
    """Events (case_id, ord, t, kind, value, source, count, from, to) -> case_id, n, kind, gone: the log's length, last kind and dropped events after each batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = Log(_load(state, {"events": []})["events"])
        for r in pd.concat(list(frames)).sort_values(["t", "ord"]).to_dict("records"):
            log.append({"t": r["t"].timestamp(), "kind": r["kind"], "value": r["value"], "source": r["source"], "count": int(r["count"]), "from": r["from"], "to": r["to"]}, cap)
        state.update((json.dumps({"events": log.events}),))
        first = log.events[0] if log.events else {"kind": "", "n": 0}
        yield pd.DataFrame({"case_id": [key[0]], "n": [len(log.events)], "kind": [log.events[-1]["kind"] if log.events else None], "gone": [first["n"] if first["kind"] == TRUNCATED else 0]})

    return events.groupBy("case_id").applyInPandasWithState(step, "case_id long, n long, kind string, gone long", "s string", "update", GroupStateTimeout.NoTimeout)
