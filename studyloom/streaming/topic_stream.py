"""Topic states from a stream of learning events, in event time: late and repeated rows give what a replay gives.

A key's state is the fold of all events up to its horizon, the newest event less the delay, and the events after it, sorted: a late
row takes its place among those, and what a batch puts out is the fold over all of them. Ids that a key has seen are kept for good. State
lies in RocksDB, so it need not fit in memory. No watermark is set: Spark would drop the rows that come later than it, and here they count.

Keys are dealt to buckets by hash, and a bucket's keys share one state and one call a batch: a call for each key costs far more than its work.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.folds import STATE, topic_history, topic_step

EVENT = ["delta", "weight", "signal", "days", "attempt", "right", "flagged"]
NAMES = [c.split()[0] for c in STATE.split(", ")]
#: A key without settled events.
BLANK = (0, 0.0, 0.0, 0.0, 0, 0, 0, 0.0, 0.0, 0.0, False, 0)


def _packed(columns: dict) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pydict(columns)
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all()


def _rows(table: pa.Table) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in table.columns)))


def _columns(names: list[str], rows: list[tuple]) -> dict:
    return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}


class TopicStates(StatefulProcessor):
    """Emits the states of a bucket's keys after each batch that brings them a new event. Times are microseconds.

    Its state is three tables in Arrow's form: the keys with their settled states, in order of arrival; the events after the horizons,
    by the key's place; and the ids seen, by the key's place. It grows with a bucket's keys and ids.
    """

    def __init__(self, keys: list[str], delay: int):
        self.keys, self.delay = keys, delay

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "states binary, recent binary, seen binary")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows))  # a bucket's rows of one micro-batch, whose size the source bounds
        pdf = pdf.sort_values(["ts", "known", "event_id"], kind="stable")
        states, recent, seen = [], {}, (np.empty(0, np.int32), np.empty(0, np.int64))
        if held := self.held.get():
            states = _rows(_unpacked(held[0]))
            for place, *event in _rows(_unpacked(held[1])):
                recent.setdefault(place, []).append(tuple(event))
            seen = tuple(c.to_numpy() for c in _unpacked(held[2]).columns)
        nk = len(self.keys)
        places = {s[:nk]: n for n, s in enumerate(states)}
        at = np.array([places.setdefault(k, len(places)) for k in zip(*(pdf[k].tolist() for k in self.keys))], np.int32)
        states += [(*k, *BLANK, None, 0) for k in list(places)[len(states) :]]
        fresh, seen = self._new(at, pdf["known"].to_numpy(bool), pdf["event_id"].to_numpy(np.int64), seen)
        if not fresh.any():
            return
        pdf, at = pdf[fresh], at[fresh].tolist()
        stamps = pdf["ts"].astype("datetime64[us]").astype("int64").tolist()
        ids = [i if k else None for i, k in zip(pdf["event_id"].tolist(), pdf["known"].tolist())]
        values = zip(*[pdf[c].astype(t).tolist() for c, t in zip(EVENT, (float, float, float, int, bool, bool, bool))])
        events = {}
        for place, *event in zip(at, stamps, ids, values):
            events.setdefault(place, []).append((event[0], event[1], *event[2]))
        out = []
        for place, mine in events.items():
            *state, until, late = states[place][nk:]
            state, until, late, waiting, last = self._after(tuple(state) if state[0] else None, until, late, recent.pop(place, []), mine)
            states[place] = (*states[place][:nk], *(state or BLANK), until, late)
            if waiting:
                recent[place] = waiting
            out.append((*states[place][:nk], *last, late))
        names = ["place", "ts", "event_id", *EVENT]
        waiting = [(place, *e) for place, es in recent.items() for e in es]
        self.held.update((_packed(_columns([*self.keys, *NAMES, "until", "late"], states)), _packed(_columns(names, waiting)), _packed({"place": seen[0], "event_id": seen[1]})))
        yield pd.DataFrame(out, columns=[*self.keys, *NAMES, "late"])

    @staticmethod
    def _new(at: np.ndarray, known: np.ndarray, ids: np.ndarray, seen: tuple) -> tuple[np.ndarray, tuple]:
        """Which rows have an id that their key has not seen, the first of each id, and the ids seen after; rows without an id are all new."""
        n, here = len(seen[0]), np.flatnonzero(known)
        place, number = np.concatenate([seen[0], at[here]]), np.concatenate([seen[1], ids[here]])
        order = np.lexsort((number, place))  # stable: of equal ones the held comes first, then the earliest
        place, number = place[order], number[order]
        first = np.ones(len(order), bool)
        first[1:] = (place[1:] != place[:-1]) | (number[1:] != number[:-1])
        fresh = ~known
        new = order[first]
        fresh[here[new[new >= n] - n]] = True
        return fresh, (place[first], number[first])

    def _after(self, state, until, late, held, events) -> tuple:
        """A key's settled state, horizon, number of late events and events after the horizon, and its state over all events."""
        for e in [e for e in events if until is not None and e[0] <= until]:
            # its place is settled: it counts now, but doesn't move the next review
            after = topic_step(state, *e[2:])
            state, late = (*after[:-1], state[-1]) if state else after, late + 1
        held = sorted(held + [e for e in events if until is None or e[0] > until], key=lambda e: (e[0], e[1] is not None, e[1] or 0))
        until = max(x for x in (until, held[-1][0] - self.delay if held else None) if x is not None)
        ripe = sum(e[0] <= until for e in held)
        for e in held[:ripe]:
            state = topic_step(state, *e[2:])
        last = state
        for e in held[ripe:]:
            last = topic_step(last, *e[2:])
        return state, until, late, held[ripe:], last

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession, stores: int | None = None):
    """Streams that start inside keep their state in RocksDB, in so many stores: one for each core unless given. A stream keeps the number it began with.

    Every batch opens and saves every store, whether it has rows or not, so a store a partition of Spark's usual 200 costs more than the work.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": str(stores or spark.sparkContext.defaultParallelism),
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def topic_states(events: DataFrame, keys: list[str], delay: str = "12 hours", buckets: int = 256) -> DataFrame:
    """A stream from learning.updates -> the keys, the state (folds.STATE) and late, of each key that a batch brought something new.

    Run it in update mode inside rocksdb(). A row that is no more than delay older than its key's newest one counts in its place; late is
    how many came after their place was settled: those count when they come, and repaired() puts them right. An event id counts once
    for a key, however late it comes again; rows without an id count each. A row without a time or key has to be gone. A worker holds
    one bucket at a time: some 200 bytes for each of its keys and 12 for each of their ids. A stream keeps the number of buckets it began with.
    """
    spark = events.sparkSession
    micros = spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {delay})").first()[0]
    kinds = dict(events.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), STATE, "late long"])
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows = events.select(bucket.alias("__bucket"), *keys, "ts", F.col("event_id").isNotNull().alias("known"), F.coalesce("event_id", F.lit(0)).cast("long").alias("event_id"), *EVENT)
    return rows.groupBy("__bucket").transformWithStateInPandas(TopicStates(keys, micros), schema, "Update", "None")


def repaired(states: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """The last states of a stream with the keys that had late rows replayed from all events, each id once."""
    behind = states.where("late > 0").select(*keys)
    rows = events.join(behind, keys, "left_semi")
    once = rows.where("event_id IS NOT NULL").withColumn("__r", F.struct("ts", *EVENT)).groupBy(*keys, "event_id").agg(F.min("__r").alias("r")).select(*keys, "event_id", "r.*")
    again = topic_history(once.unionByName(rows.where("event_id IS NULL").select(*once.columns)), keys)
    last = again.groupBy(*keys).agg(F.max_by(F.struct(*NAMES), "version").alias("s")).select(*keys, "s.*")
    return states.where("late = 0").drop("late").unionByName(last)
