"""Dialog state over a stream of turns, kept by session in Spark's state store.

A session opens with a reset (which comes before the turns of its micro-batch) and goes on with turns 1, 2, 3 ...; its memory is a value and lists of typed
rows in the state store, and a turn changes only what it touches. Turns are parsed by Column expressions before they
are dealt. A turn that comes before its predecessors waits in a list until they are there; one that has been taken in is not taken
in again. A turn of a session without a reset changes nothing and is answered with an error. With ``idle_ms``, a
timer closes a session that has been silent for so long: what waits is taken in, its last state is given out
and its memory freed.

States can start from a table of folded states, so a stream can go on where a batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnlight.functions import fixed as X
from tarnlight.operators.dialog import TURN, as_turn, parsed_turns

_SLOT = "attribute string, variants array<string>, status string, turn_set long, weight double, budget_max double, stagnant boolean"
_SAID = "phrase string, normal string, attribute string, turn_seen long, weight double, kind string"
_MAIN = "turn long, category string, override_events long, asked array<string>, exhausted array<string>, deferred array<string>"
_NEED = "phrase string, normal string, attribute string, value string, bare boolean, amount double"
_WAITS = f"turn long, asked string, category string, requirements array<struct<{_NEED.replace(' ', ':').replace(',:', ',')}>>, is_override boolean, no_preference_for string, is_deflection boolean, is_unclear boolean"
NO_RESET = "a session must be reset before its turns"


def _colon(ddl: str) -> str:
    return ddl.replace(", ", ",").replace(" ", ":")


#: What a session's group gives out, besides the session: its state after the turns that came, or an error.
OUT = (
    f"turn long, category string, override_events long, evidence array<struct<{_colon(_SAID)}>>, slots array<struct<{_colon(_SLOT)}>>, "
    "primary_constraints array<struct<attribute:string,value:string>>, asked array<string>, exhausted array<string>, deferred array<string>, closed boolean, error string"
)


def take_in(state: dict, t: dict) -> None:
    """Folds a parsed turn into a state (the fields of dialog.STATE): see dialog.observed, of which this is the row-at-a-time form."""
    state["turn"], asked, declined = t["turn"], t["asked"], t["no_preference_for"]
    slots, touched = {s["attribute"]: s for s in state["slots"]}, set()
    known = {p["attribute"]: p["value"] for p in state["primary_constraints"]}

    def slot(attribute: str, **more) -> dict:
        return {"attribute": attribute, "variants": [], "status": "confirmed", "turn_set": t["turn"], "weight": 1.0, "budget_max": None, "stagnant": False} | more

    def add(names: str, *values: str | None) -> None:
        state[names] = list(dict.fromkeys([*state[names], *(v for v in values if v is not None)]))

    for r in t["requirements"] or []:
        if r["normal"] == "" or any(e["normal"] == r["normal"] for e in state["evidence"]):
            continue
        a = r["attribute"]
        if t["is_override"]:
            state["evidence"] = [e | {"weight": X.SUPERSEDED_WEIGHT} if e["attribute"] == a else e for e in state["evidence"]]
        state["evidence"].append({"phrase": r["phrase"], "normal": r["normal"], "attribute": a, "turn_seen": t["turn"], "weight": 1.0, "kind": "attribute" if r["bare"] else "phrase"})
        if r["bare"]:
            known[a] = r["value"]
        old = slots.get(a) if slots.get(a, {}).get("status") == "confirmed" else None
        variants = list(old["variants"]) if old else []
        if r["value"] and r["value"] not in variants:
            variants.insert(0 if t["is_override"] else len(variants), r["value"])
        amount = r["amount"] if a == "budget" and r["amount"] is not None else old and old["budget_max"]
        slots[a] = slot(a, variants=variants, budget_max=amount)
        touched.add(a)
    add("asked", asked)
    state["deferred"] = []
    if declined is not None and t["is_deflection"]:
        add("deferred", declined, asked)
    elif declined is not None:
        slots[declined] = slots.get(declined, slot(declined)) | {"status": "no_pref"}
        add("exhausted", declined, asked)
    elif not t["is_unclear"] and not t["is_override"] and asked is not None and not touched:
        add("exhausted", asked)
        if asked in X.CATCH_ALL_ATTRIBUTES:
            slots[asked] = slots.get(asked, slot(asked)) | {"stagnant": True}
    for a, s in slots.items():
        if a not in touched and s["status"] != "no_pref":
            slots[a] = s | {"weight": max(X.MIN_WEIGHT, s["weight"] * X.DECAY)}
    state["slots"], state["primary_constraints"] = list(slots.values()), [{"attribute": a, "value": v} for a, v in known.items()]
    state["category"] = t["category"] if t["category"] is not None else state["category"]
    state["override_events"] += bool(t["is_override"])


class Sessions(StatefulProcessor):
    """The state of one session after another, as the state store hands them out."""

    LISTS = (("evidence", _SAID), ("slots", _SLOT), ("primary_constraints", "attribute string, value string"))

    def __init__(self, session: str, idle_ms: int | None):
        self.session, self.idle_ms = session, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.main = handle.getValueState("main", _MAIN)
        self.lists = {name: handle.getListState(name, ddl) for name, ddl in self.LISTS}
        self.waiting = handle.getListState("waiting", _WAITS)
        self.timer = handle.getValueState("timer", "at long")

    def _read(self) -> dict | None:
        if not self.main.exists():
            return None
        state = dict(zip(("turn", "category", "override_events", "asked", "exhausted", "deferred"), self.main.get(), strict=True))
        for name in ("asked", "exhausted", "deferred"):
            state[name] = list(state[name] or [])
        for name, ddl in self.LISTS:
            fields = [f.split()[0] for f in ddl.split(", ")]
            state[name] = [dict(zip(fields, row, strict=True)) for row in self.lists[name].get()]
        for s in state["slots"]:
            s["variants"] = list(s["variants"] or [])
        return state

    def _write(self, state: dict) -> None:
        self.main.update(tuple(state[c] for c in ("turn", "category", "override_events", "asked", "exhausted", "deferred")))
        for name, _ in self.LISTS:
            self.lists[name].clear()
            if state[name]:
                self.lists[name].put([tuple(row.values()) for row in state[name]])

    def _free(self) -> None:
        for kept in (self.main, self.waiting, self.timer, *self.lists.values()):
            kept.clear()

    def _told(self, key: tuple, state: dict | None, closed: bool = False, error: str | None = None) -> Row:
        names = [f.split()[0] for f in _MAIN.split(", ")[:3]]
        given = {c: state[c] if state else None for c in (*names, "evidence", "slots", "primary_constraints", "asked", "exhausted", "deferred")}
        rows = {c: [Row(**r) for r in given[c]] if given[c] is not None else None for c in ("evidence", "slots", "primary_constraints")}
        return Row(**{self.session: key[0]}, **(given | rows), closed=closed, error=error)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self._write(initialState.asDict(recursive=True)["state"])

    def _wake(self, now: int) -> None:
        if self.idle_ms is not None:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            self.timer.update((now + self.idle_ms,))
            self.handle.registerTimer(now + self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        turns = [row.asDict(recursive=True)["t"] for row in rows]
        if None in turns:  # a reset comes before the turns of its batch; what the session said before is gone
            self._free()
            state = {"turn": 0, "category": None, "override_events": 0, "asked": [], "exhausted": [], "deferred": [], "evidence": [], "slots": [], "primary_constraints": []}
        else:
            state = self._read()
        waiting = {t["turn"]: t for t in turns if t is not None}
        if state is None:
            yield self._told(key, None, error=NO_RESET)
            return
        held = [dict(zip(TURN_FIELDS, w, strict=True)) for w in self.waiting.get()]
        for w in held:
            w["requirements"] = [dict(zip(NEED_FIELDS, q, strict=True)) for q in w["requirements"] or []]
            waiting.setdefault(w["turn"], w)
        yield from self._go_on(key, state, waiting)
        self._wake(timerValues.getCurrentProcessingTimeInMs() if self.idle_ms is not None else 0)

    def _go_on(self, key: tuple, state: dict, waiting: dict) -> Iterator[Row]:
        while state["turn"] + 1 in waiting:
            take_in(state, waiting.pop(state["turn"] + 1))
        self._write(state)
        self.waiting.clear()
        left = [waiting[k] for k in sorted(waiting) if k > state["turn"]]
        if left:
            self.waiting.put([tuple([tuple(q[f] for f in NEED_FIELDS) for q in w[c] or []] if c == "requirements" else w[c] for c in TURN_FIELDS) for w in left])
        yield self._told(key, state)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._read()
        if state is not None:
            for w in sorted(self.waiting.get()):
                turn = dict(zip(TURN_FIELDS, w, strict=True))
                turn["requirements"] = [dict(zip(NEED_FIELDS, q, strict=True)) for q in turn["requirements"] or []]
                take_in(state, turn)
            yield self._told(key, state, closed=True)
        self._free()


TURN_FIELDS = ("turn", "asked", "category", "requirements", "is_override", "no_preference_for", "is_deflection", "is_unclear")
NEED_FIELDS = ("phrase", "normal", "attribute", "value", "bare", "amount")
assert set(TURN_FIELDS) == set(TURN)


def dialog_states(events: DataFrame, session: str = "session_id", idle_ms: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """events: a stream of session, turn (null: a reset), message, asked. A row for each session of a micro-batch, see OUT.

    start: session, state (see dialog.folded) of sessions that have spoken before. The session's
    state store provider must be RocksDB's.
    """
    kind = events.schema[session].dataType.simpleString()
    rows = parsed_turns(events).select(*as_turn(session)).withColumn("t", F.when(F.col("t.turn").isNotNull(), F.col("t")))
    return rows.groupBy(session).transformWithState(
        Sessions(session, idle_ms), f"{session} {kind}, {OUT}", "Update", "none" if idle_ms is None else "processingTime", start.select(session, "state").groupBy(session) if start is not None else None,
    )
