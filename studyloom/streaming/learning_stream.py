"""Learning events as a stream: each event counts once, and state is updated batch by batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout


def counted_once(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream without repeated event ids, as far as they come within the delay of each other."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def state_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps (user_id, events, total, last) under path, one folder a batch; a batch that is run again rewrites its own folder only.

    An event id counts once, however late it comes again: the ids written are kept under path + ".ids". Of rows of one id in a
    batch the earliest counts; rows without an id count each.
    """
    ids = f"{path}.ids"

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("event_id", "ts", "user_id", "value")
        new = rows.where("event_id IS NOT NULL").groupBy("event_id").agg(F.min(F.struct("ts", "user_id", "value")).alias("row")).select("event_id", "row.*")
        if number > 0:
            new = new.join(batch.sparkSession.read.parquet(ids).where(F.col("batch") < number).select("event_id"), "event_id", "left_anti")
        new.select("event_id").write.mode("overwrite").parquet(f"{ids}/batch={number}")
        new.unionByName(rows.where("event_id IS NULL")).groupBy("user_id").agg(F.count("*").alias("events"), F.sum("value").alias("total"), F.max("ts").alias("last")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(deltas: DataFrame) -> DataFrame:
    """The state from all batches' partial sums."""
    return deltas.groupBy("user_id").agg(F.sum("events").alias("events"), F.sum("total").alias("total"), F.max("last").alias("last"))


def mastery_stream(events: DataFrame) -> DataFrame:
    """A stream from learning.updates -> (user_id, topic, mastery, events) of every key that a batch touched (output mode update).

    Events count in order of arrival, so a late one changes mastery but not the order of what came before; a replay
    with learning.fold_mastery gives the order of event time. State is two numbers a key, kept together for all topics of a user, as a call for
    each key would cost more than its work. Repeated ids have to be gone (counted_once).
    """

    def step(key, frames, state):
        held = {t: (m, n) for t, m, n in zip(*state.get)} if state.exists else {}
        touched = {}
        # a user's rows of one micro-batch may come in several frames
        rows = pd.concat([pdf[["topic", "ts", "event_id", "delta"]] for pdf in frames]).sort_values(["ts", "event_id"])
        for topic, delta in zip(rows["topic"].tolist(), rows["delta"].tolist()):
            topic = None if pd.isna(topic) else int(topic)
            mastery, n = touched.get(topic) or held.get(topic) or (0.5, 0)
            touched[topic] = (max(0.0, min(1.0, mastery + delta)), n + 1)
        held |= touched
        state.update((list(held), [float(m) for m, _ in held.values()], [n for _, n in held.values()]))
        yield pd.DataFrame({"user_id": pd.Series([key[0]] * len(touched), dtype=object), "topic": pd.Series(list(touched), dtype=object), "mastery": [round(float(m), 6) for m, _ in touched.values()], "events": [n for _, n in touched.values()]})

    rows = events.select("user_id", "topic", "ts", "event_id", "delta")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, topic int, mastery double, events long", "topics array<int>, mastery array<double>, events array<long>", "update", GroupStateTimeout.NoTimeout)


def turn_windows(messages: DataFrame, turns: int = 12, budget: int = 2400, least: int = 2, clip: int = 900) -> DataFrame:
    """A stream of messages(conv_id, turn, text) -> (conv_id, first, turns, tokens): the newest turns that fit, as memory.token_window, after each batch (output mode update).

    State is a list of the last turns' sizes, at most as many as a window has.
    """

    def step(key, frames, state):
        held = [(int(a), int(b)) for a, b in zip(*state.get)] if state.exists else []
        for pdf in frames:
            held += [(int(t), min(clip, max(1, (len(x or "") + 3) // 4))) for t, x in zip(pdf["turn"], pdf["text"])]
        held = sorted(held)[-turns:]
        state.update(([t for t, _ in held], [n for _, n in held]))
        kept, total = [], 0
        for t, n in held[::-1]:
            if total + n > budget and len(kept) >= least:
                break
            kept.append(t)
            total += n
        yield pd.DataFrame({"conv_id": [key[0]], "first": [kept[-1]], "turns": [len(kept)], "tokens": [total]})

    rows = messages.select("conv_id", "turn", "text")
    return rows.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, first long, turns long, tokens long", "turns array<long>, sizes array<long>", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Runs a stream of updates over what there is and gives the last row of each key; a batch that is run again rewrites its own folder only."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, "s.*")
