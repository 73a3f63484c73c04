"""Keyed dialog state over a stream: the same states as the batch, whatever the micro-batches are."""

import random
import time

import pytest

from tarnlight.operators import dialog
from tarnlight.streaming.dialog import NO_RESET, dialog_states, take_in

SCHEMA = "session_id string, turn long, message string, asked string"
SAID = [
    "I'm looking for Wrist Watches. A key requirement is: steel band.", "I'm looking for Hats, but I'm still exploring.", "For that, what matters is: Color: red; under $40.", "wool",
    "For that, what matters is: Material: alloy; Brand: acme.", "Actually, ignore my earlier preference. What I need is: leather.", "I don't have an additional preference for color.",
    "I don't have a preference for size; please use your judgment.", "Those options are not quite right yet. Ask me about one specific attribute.", "", "budget around $12.5", "Color: blue", "cotton", "wool",
]
ASKED = [None, None, "other", "feature", "color", "size", "material", "budget"]


def history(seed, sessions=12):
    rng = random.Random(seed)
    return [(f"s{k}", t + 1, rng.choice(SAID), rng.choice(ASKED)) for k in range(sessions) for t in range(rng.randint(1, 7))]


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def batch(spark, rows):
    return {r.session_id: r.state.asDict(recursive=True) for r in dialog.folded(spark.createDataFrame(rows, SCHEMA), "session_id").collect()}


class Stream:
    def __init__(self, spark, path, **more):
        self.spark, self.path, self.more, self.seen = spark, path, more, []
        spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/in")

    def send(self, *batches):
        """Each batch of rows as one micro-batch, by a query of its own that goes on from the checkpoint."""
        for rows in batches:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
            source = self.spark.readStream.schema(SCHEMA).parquet(f"{self.path}/in")
            writer = dialog_states(source, **self.more).writeStream.outputMode("update").option("checkpointLocation", f"{self.path}/checkpoint")
            query = writer.trigger(availableNow=True).foreachBatch(lambda out, _: self.seen.extend(r.asDict(recursive=True) for r in out.collect())).start()
            query.awaitTermination()
        return self.seen

    def states(self):
        return {r["session_id"]: {k: v for k, v in r.items() if k not in ("session_id", "closed", "error")} for r in self.seen if r["error"] is None}


def test_turn_by_turn_is_the_fold(spark):
    rows = history(1, 60)
    want = batch(spark, rows)
    parsed = dialog.parsed_turns(spark.createDataFrame(rows, SCHEMA)).select(*dialog.as_turn("session_id")).collect()
    states = {}
    for r in sorted(parsed, key=lambda r: r.t.turn):
        start = {"turn": 0, "category": None, "override_events": 0, "evidence": [], "slots": [], "primary_constraints": [], "asked": [], "exhausted": [], "deferred": []}
        take_in(states.setdefault(r.session_id, start), r.t.asDict(recursive=True))
    assert states == want


def test_advance_is_the_fold(spark, tmp_path):
    """A table of states that takes in one turn after another."""
    rows = history(2)
    states = spark.createDataFrame([], f"session_id string, state {dialog.STATE}")
    for turn in range(1, 8):
        now = spark.createDataFrame([r for r in rows if r[1] == turn], SCHEMA)
        dialog.advance(states, now, "session_id").write.parquet(f"{tmp_path}/{turn}")
        states = spark.read.parquet(f"{tmp_path}/{turn}")
    assert {r.session_id: r.state.asDict(recursive=True) for r in states.collect()} == batch(spark, rows)


def test_shuffled_batches_and_restarts(spark, tmp_path):
    rows = history(3)
    resets = [(s, None, None, None) for s in sorted({r[0] for r in rows})]
    late = rows[:]
    random.Random(4).shuffle(late)
    stream = Stream(spark, str(tmp_path))
    stream.send([*late[:10], *resets], late[10:25], late[25:], late[:5])  # the last turns come a second time
    assert stream.states() == batch(spark, rows)


def test_turns_without_reset_and_new_sessions(spark, tmp_path):
    stream = Stream(spark, str(tmp_path))
    stream.send([("a", 1, "wool", None), ("b", None, None, None), ("b", 1, "wool", None)], [("a", 2, "red", None), ("b", None, None, None), ("b", 1, "cotton", None)])
    errors = [r for r in stream.seen if r["error"]]
    assert [r["session_id"] for r in errors] == ["a", "a"] and {r["error"] for r in errors} == {NO_RESET} and all(r["slots"] is None for r in errors)
    assert [e["phrase"] for e in stream.states()["b"]["evidence"]] == ["cotton"]


def test_goes_on_from_a_batch(spark, tmp_path):
    rows = history(5)
    start = dialog.folded(spark.createDataFrame([r for r in rows if r[1] <= 2], SCHEMA), "session_id")
    stream = Stream(spark, str(tmp_path), start=start)
    stream.send([r for r in rows if r[1] > 2])
    want = batch(spark, rows)
    assert stream.states() and all(want[s] == state for s, state in stream.states().items())
    assert not any(r["error"] for r in stream.seen)


def test_silent_sessions_are_closed(spark, tmp_path):
    rows = [("a", None, None, None), ("a", 1, "wool", None), ("a", 3, "red", None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    writer = dialog_states(source, idle_ms=500).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint")
    query = writer.trigger(processingTime="1 second").foreachBatch(lambda out, _: seen.extend(out.collect())).start()
    try:
        until = time.time() + 40
        while time.time() < until and not any(r.closed for r in seen):
            time.sleep(0.2)
    finally:
        query.stop()
    assert [(r.turn, r.closed) for r in seen][:2] == [(1, False), (3, True)] and [e.phrase for e in seen[1].evidence] == ["wool", "red"]
