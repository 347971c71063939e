"""Keyed dialogue state: one draft for each conversation, driven by its turns in order.

A decision opens, updates, cancels, confirms or rejects a draft. Slots are superseded by later values
and every change raises the revision; a confirmation holds for the material it was given for, so any
later change withdraws it. The same step serves batch replay (a fold that holds one draft, whatever the
conversation's length) and a stream, where a conversation's state is a value with a version, ends by a timer
when no turn has come for a while, and late turns are told from new ones.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.operators.fold import fold

VERSION = 1
#: The operations of a decision.
OPERATIONS = ("open", "update", "cancel", "confirm", "reject", "none")
RESULT = "conversation string, turn long, status string, revision long, slots string, confirmed boolean, note string"


@dataclass
class Draft:
    status: str = "empty"  # empty, open, ready, cancelled
    action: str = ""
    slots: dict[str, str] = field(default_factory=dict)
    revision: int = 0
    confirmed_for: str = ""
    last_turn: int = -1
    version: int = VERSION

    def digest(self) -> str:
        return hashlib.sha256(json.dumps([self.action, sorted(self.slots.items())], ensure_ascii=False).encode()).hexdigest()

    @property
    def confirmed(self) -> bool:
        return bool(self.confirmed_for) and self.confirmed_for == self.digest()

    def dump(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @staticmethod
    def load(text: str) -> Draft:
        raw = json.loads(text)
        if raw.get("version") != VERSION:
            raise ValueError(f"state of version {raw.get('version')}")
        return Draft(**raw)


def step(draft: Draft, turn: int, operation: str, action: str | None, slots: dict[str, str] | None) -> str:
    """Applies one decision to the draft; returns a note (empty if it was applied)."""
    if turn <= draft.last_turn:
        return "late_turn"
    draft.last_turn = turn
    slots = {k: v for k, v in (slots or {}).items() if k}
    if operation not in OPERATIONS:
        return "unknown_operation"
    if operation == "none":
        return ""
    if operation == "open":
        note = "replaced" if draft.status in ("open", "ready") else ""
        draft.status, draft.action, draft.slots, draft.confirmed_for = "open", action or "", {k: v for k, v in slots.items() if v is not None}, ""
        draft.revision += 1
        return note
    if draft.status not in ("open", "ready"):
        return "no_draft"
    if operation == "update":
        new = dict(draft.slots)
        for k, v in slots.items():
            if v is None:
                new.pop(k, None)
            else:
                new[k] = v
        if new == draft.slots and (not action or action == draft.action):
            return "unchanged"
        draft.slots, draft.action, draft.status = new, action or draft.action, "open"
        draft.revision += 1
    elif operation == "cancel":
        draft.status, draft.confirmed_for = "cancelled", ""
        draft.revision += 1
    elif operation == "confirm":
        draft.confirmed_for, draft.status = draft.digest(), "ready"
    elif operation == "reject":
        draft.confirmed_for, draft.status = "", "open"
    return ""


def missing_slots(draft: Draft, required: list[str]) -> list[str]:
    """The required slots that are not filled, in the order they are asked for."""
    return [x for x in required if not draft.slots.get(x)]


def next_step(draft: Draft, operation: str, required: list[str]) -> str:
    """What the system does after a turn: NO_ACTION, ASK_USER, CHECK_CONFIRMATION_BINDING, REQUEST_CONFIRMATION or READY_TO_FINALIZE."""
    if operation == "none" or draft.status in ("empty", "cancelled"):
        return "NO_ACTION"
    if operation == "confirm":
        return "CHECK_CONFIRMATION_BINDING"
    if missing_slots(draft, required):
        return "ASK_USER"
    return "READY_TO_FINALIZE" if draft.confirmed else "REQUEST_CONFIRMATION"


def _applied(draft: Draft, row: dict) -> tuple:
    slots = json.loads(row["slots"]) if row["slots"] else None
    note = step(draft, int(row["turn"]), row["operation"], row["action"], slots)
    return row["conversation"], row["turn"], draft.status, draft.revision, json.dumps(draft.slots, sort_keys=True, ensure_ascii=False), draft.confirmed, note


_INPUT = ("conversation", "turn", "operation", "action", "slots")


def replay(decisions: DataFrame) -> DataFrame:
    """The state after each turn of (conversation, turn, operation, action, slots as JSON)."""
    return fold(decisions.select(*_INPUT), "conversation", ["turn"], Draft, _applied, RESULT)


def replay_steps(decisions: DataFrame, required: list[str]) -> DataFrame:
    """(conversation, turn, status, next): the draft's status after each turn, and what the system does then."""

    def run(draft: Draft, row: dict) -> tuple:
        out = _applied(draft, row)
        return row["conversation"], row["turn"], draft.status, "STATE_REJECTED" if out[-1] in ("no_draft", "unknown_operation", "late_turn") else next_step(draft, row["operation"], required)

    return fold(decisions.select(*_INPUT), "conversation", ["turn"], Draft, run, "conversation string, turn long, status string, next string")


def upgraded(text: str) -> Draft:
    """A stored draft of this version, or of version 0 (which had no digest of what was confirmed): its confirmation lapses."""
    raw = json.loads(text)
    if raw.get("version") == 0:
        known = {k: raw[k] for k in ("status", "action", "slots", "revision", "last_turn") if k in raw}
        return Draft(**{**known, "status": "open" if known.get("status") == "ready" else known.get("status", "empty")})
    return Draft.load(text)


class _Follower(StatefulProcessor):
    """A conversation's draft over a stream; it ends `idle` after the latest turn's time."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.draft = handle.getValueState("draft", "text string")
        self.ends = handle.getValueState("ends", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        draft = upgraded(self.draft.get()[0]) if self.draft.exists() else Draft()
        ends = self.ends.get()[0] if self.ends.exists() else None
        turns = pd.concat(list(rows), ignore_index=True).sort_values("turn", kind="stable")
        turns["slots"] = turns["slots"].astype(object).where(turns["slots"].notna(), None)
        out = [_applied(draft, r) for r in turns.to_dict("records")]
        self.draft.update((draft.dump(),))
        if self.idle_ms is None:
            yield pd.DataFrame(out, columns=_COLUMNS)
            return
        latest = int(turns["at"].max().timestamp() * 1000) + self.idle_ms
        if ends is None or latest > ends:
            if ends is not None:
                self.handle.deleteTimer(ends)
            self.handle.registerTimer(latest)
            self.ends.update((latest,))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        draft = upgraded(self.draft.get()[0])
        self.draft.clear()
        self.ends.clear()
        yield pd.DataFrame([(key[0], draft.last_turn, "expired", draft.revision, json.dumps(draft.slots, sort_keys=True, ensure_ascii=False), draft.confirmed, "expired")], columns=_COLUMNS)

    def close(self) -> None:
        return


_COLUMNS = [x.split()[0] for x in RESULT.split(", ")]
STORE = "spark.sql.streaming.stateStore.providerClass"


def follow(decisions: DataFrame, idle: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The same over a stream; turns older than the state are noted as late_turn.

    With an event time `at`, a conversation without a turn for `idle` yields a last row of status expired, and its state is dropped; a
    turn after that begins anew. The watermark follows `late` behind. The session needs RocksDB state; it
    is chosen here where another provider isn't set.
    """
    spark = decisions.sparkSession
    if "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    if "at" not in decisions.columns:
        return decisions.select(*_INPUT).groupBy("conversation").transformWithStateInPandas(_Follower(None), RESULT, "Append", "None")
    rows = decisions.select(*_INPUT, "at").withWatermark("at", late)
    return rows.groupBy("conversation").transformWithStateInPandas(_Follower(idle_ms), RESULT, "Append", "EventTime")
