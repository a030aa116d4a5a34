"""Conversation sessions with a time to live, a bounded number of them and a bounded memory of turns.

A store holds sessions; its commands are walked in order of time, then id. `create` opens a session,
`turn` adds to an open one, `open` does both. Before each command the sessions idle for `ttl` seconds
go; when a full store opens another one, the one that was touched longest ago goes. As which session
goes depends on all of a store, a store is one key of the shuffle: spread sessions over many of them
(`stores`), each with its own bound. In a stream the state of a session is one entry of a map, so that
a batch writes only the sessions that it touched, and a timer empties idle stores.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tallyforge.operators import governance
from tallyforge.streaming.events import LATE

OUTCOMES = (
    "store string, command_id bigint, session_id string, outcome string, turn_index bigint, context_reused boolean, "
    "question string, previous_question string, slots string, turns_kept bigint, evicted string, expired bigint"
)
SESSION = "updated double, touch bigint, next_turn bigint, turns string"


def stores(session: Column | str, n: int) -> Column:
    """One of n stores for each session, by a hash of its id."""
    return F.concat(F.lit("store:"), F.pmod(F.xxhash64(session), F.lit(n)).cast("string"))


@dataclass(frozen=True)
class Limits:
    """Bounds of a store."""

    ttl: float = 1800.0
    sessions: int = 1000
    turns: int = 8

    def __post_init__(self):
        if not 1 <= self.ttl <= 86_400 or self.sessions < 1 or self.turns < 1:
            raise ValueError("a time to live of a second to a day, and at least one session and one turn, are needed")


@dataclass
class Session:
    updated: float = 0.0
    touch: int = 0
    next_turn: int = 0
    turns: list[tuple[str | None, dict[str, str]]] = field(default_factory=list)


class Store:
    """A store's sessions, the one touched longest ago first; `changed` and `gone` name what a step altered."""

    def __init__(self, limits: Limits, sessions: dict[str, Session] | None = None, clock: float = 0.0):
        self.limits, self.sessions, self.clock = limits, sessions or {}, clock
        self.touches = max((x.touch for x in self.sessions.values()), default=0)
        self.changed: set[str] = set()
        self.gone: set[str] = set()

    def _drop(self, name: str) -> None:
        del self.sessions[name]
        self.gone.add(name)
        self.changed.discard(name)

    def _touch(self, name: str, session: Session) -> None:
        self.touches += 1
        session.updated, session.touch = self.clock, self.touches
        self.sessions.pop(name, None)
        self.sessions[name] = session
        self.changed.add(name)
        self.gone.discard(name)

    def expire(self, now: float) -> int:
        """Drops what has been idle for the time to live; a clock never goes back."""
        self.clock = max(self.clock, now)
        idle = []
        for name, session in self.sessions.items():
            if self.clock - session.updated < self.limits.ttl:
                break
            idle.append(name)
        for name in idle:
            self._drop(name)
        return len(idle)

    def step(self, name: str, action: str, at: float, question: str | None, named: dict[str, str]) -> tuple:
        """outcome, turn_index, context_reused, previous question, slots, turns kept, evicted session, expired sessions"""
        expired, evicted, outcome = self.expire(at), None, "appended"
        session = self.sessions.get(name)
        if session is None and action == "turn":
            return "session_not_found", None, False, None, {}, 0, None, expired
        if session is None or action == "create":
            if session is None and len(self.sessions) >= self.limits.sessions:
                evicted = next(iter(self.sessions))
                self._drop(evicted)
            session, outcome = Session(), "created"
            if action == "create":
                self._touch(name, session)
                return outcome, None, False, None, {}, 0, evicted, expired
        before, slots = session.turns[-1] if session.turns else (None, {})
        reused, index, slots = bool(session.turns), session.next_turn, slots | named
        session.turns = [*session.turns, (question, slots)][-self.limits.turns :]
        session.next_turn += 1
        self._touch(name, session)
        return outcome, index, reused, before, slots, len(session.turns), evicted, expired


def _walk(store: str, rows: pd.DataFrame, state: Store) -> pd.DataFrame:
    out = []
    for row in rows.itertuples(index=False):
        named = {k: v for k, v in json.loads(row.slots).items() if v is not None} if isinstance(row.slots, str) else {}
        outcome, index, reused, before, slots, kept, evicted, expired = state.step(row.session_id, row.action, row.at, row.question, named)
        out.append((store, row.command_id, row.session_id, outcome, index, reused, row.question, before, json.dumps(slots, sort_keys=True), kept, evicted, expired))
    return pd.DataFrame(out, columns=[x.split()[0] for x in OUTCOMES.split(", ")], dtype=object)


def _rows(commands: DataFrame) -> DataFrame:
    """The columns that a walk needs: slots as JSON, time as seconds. A null action opens; a null session or time is no command."""
    slots = F.to_json("slots") if dict(commands.dtypes).get("slots", "").startswith(("map", "struct")) else F.lit(None).cast("string")
    return commands.where("session_id is not null and ts is not null").select(
        "store", "command_id", "session_id", F.coalesce("action", F.lit("open")).alias("action"), F.col("ts").cast("double").alias("at"), "ts", "question", slots.alias("slots")
    )


def _answered(outcomes: DataFrame) -> DataFrame:
    """Outcomes with the question in its context and the slots as a map."""
    question = F.when(F.col("outcome") != "session_not_found", governance.contextual_question(F.col("previous_question"), F.col("question")))
    return outcomes.withColumns({"contextual_question": question, "slots": F.from_json("slots", "map<string,string>")}).drop("previous_question")


def replay(commands: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every command (store, command_id, session_id, ts, action, question, and slots if there are any) with its outcome.

    outcome is created, appended or session_not_found; `evicted` names the session that made room,
    `expired` counts those that went for being idle; turn_index counts a session's turns from 0, beyond
    those kept; slots a turn doesn't name stay as they were. Rows come sorted and in batches, so memory
    is bounded by a store's limits. Repeated command ids are commands of their own.
    """
    rows = _rows(commands).repartition("store").sortWithinPartitions("store", "at", "command_id")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = object(), None
        for batch in batches:
            for store, part in batch.groupby("store", sort=False, dropna=False):
                if store != name:
                    name, state = store, Store(limits)
                yield _walk(store, part, state)

    return _answered(rows.mapInPandas(work, OUTCOMES))


class SessionProcessor(StatefulProcessor):
    """A store's sessions in a map state, its clock in a value state, one timer for what goes idle next."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "session_id string", SESSION)
        self.clock = handle.getValueState("clock", "at double")

    def _load(self) -> Store:
        found = [(key[0], Session(x[0], x[1], x[2], [(q, s) for q, s in json.loads(x[3])])) for key, x in self.sessions.iterator()]
        return Store(self.limits, dict(sorted(found, key=lambda e: e[1].touch)), self.clock.get()[0] if self.clock.exists() else 0.0)

    def _save(self, state: Store) -> None:
        for name in state.gone:
            if self.sessions.containsKey((name,)):
                self.sessions.removeKey((name,))
        for name in state.changed:
            x = state.sessions[name]
            self.sessions.updateValue((name,), (x.updated, x.touch, x.next_turn, json.dumps(x.turns)))
        self.clock.update((state.clock,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state.sessions:
            self.handle.registerTimer(int((next(iter(state.sessions.values())).updated + self.limits.ttl) * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self._load()
        batch = pd.concat(list(rows)).sort_values(["at", "command_id"])
        yield _walk(key[0], batch, state)
        self._save(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._load()
        state.expire(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self._save(state)
        return iter(())

    def close(self) -> None:
        pass


def stream(commands: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same for a stream of commands; needs RocksDB as the state store's provider.

    A batch's commands are walked in order; one that is older than its store's clock counts as asked at
    that clock. Equal to `replay` where batches come in order of time.
    """
    rows = _rows(commands.withWatermark("ts", LATE)).groupBy("store")
    return _answered(rows.transformWithStateInPandas(SessionProcessor(limits), OUTCOMES, "append", "eventTime"))
