"""Conversation memory and work queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens_message
from .retrieval import nearest_by_owner


def token_window(messages: DataFrame, turns: int = 12, budget: int = 2400, least: int = 2, clip: int = 900) -> DataFrame:
    """messages(conv_id, turn, text) -> the newest turns that fit: at most turns, and within budget once least are taken."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    m = messages.withColumn("tokens", F.least(tokens_message(F.coalesce("text", F.lit(""))), F.lit(clip)))
    m = m.withColumn("n", F.row_number().over(w)).withColumn("sum", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return m.where((F.col("n") <= turns) & ((F.col("sum") <= budget) | (F.col("n") <= least))).select("conv_id", "turn", "tokens")


def water_marks(messages: DataFrame, high: int = 3200, low: int = 1400) -> DataFrame:
    """(conv_id, turn, state): where a conversation has over high tokens, the newest within low (one at least) are kept and the rest evicted."""
    every = Window.partitionBy("conv_id")
    w = every.orderBy(F.desc("turn"))
    m = messages.withColumn("tokens", tokens_message(F.coalesce("text", F.lit(""))))
    m = m.withColumn("all", F.sum("tokens").over(every)).withColumn("n", F.row_number().over(w)).withColumn("sum", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return m.select("conv_id", "turn", F.when(F.col("all") <= high, "whole").when((F.col("sum") <= low) | (F.col("n") == 1), "kept").otherwise("evicted").alias("state"))


def recall_rank(memories: DataFrame, now: str, half_life: float = 14.0, least: float = 0.55) -> DataFrame:
    """memories(id, similarity, updated, confidence) -> score of similarity, recency (halved each half life) and confidence, best first."""
    age = (F.to_timestamp(F.lit(now)).cast("double") - F.col("updated").cast("double")) / 86400
    recency = F.coalesce(F.exp(-F.log(F.lit(2.0)) * F.greatest(age, F.lit(0.0)) / half_life), F.lit(0.5))
    score = 0.6 * F.col("similarity") + 0.2 * recency + 0.2 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    return memories.where(F.col("similarity") >= least).select("id", F.round(score, 6).alias("score"))


def evict(memories: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """The rows beyond capacity of each key: least confident first, then longest unused."""
    w = Window.partitionBy(*keys)
    order = w.orderBy("confidence", "last_used", "id")
    return memories.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= F.col("__n") - capacity).drop("__n", "__r")


def round_robin(tasks: DataFrame, slots: tuple[int, ...] = (0, 1, 0, 1, 0, 2, 1, 2), bucket: str = "day") -> DataFrame:
    """tasks(task_id, priority 0-2, enqueued) -> position when each priority is served at its slots of a cycle of eight (all queues full).

    Tasks are ranked within buckets of time; the sums of the buckets before give the rest of the rank, so no task ranks a whole priority.
    """
    places = F.create_map(*[x for p in range(3) for x in (F.lit(p), F.array(*[F.lit(k) for k, s in enumerate(slots) if s == p]))])
    t = tasks.withColumn("__b", F.date_trunc(bucket, "enqueued"))
    sizes = t.groupBy("priority", "__b").agg(F.count("*").alias("__c"))
    sizes = sizes.withColumn("__before", F.sum("__c").over(Window.partitionBy("priority").orderBy("__b")) - F.col("__c")).select(F.col("priority").alias("__p"), F.col("__b").alias("__s"), "__before")
    inside = F.row_number().over(Window.partitionBy("priority", "__b").orderBy("enqueued", "task_id")) - 1
    t = t.withColumn("__i", inside).join(sizes, (F.col("priority") == F.col("__p")) & F.col("__b").eqNullSafe(F.col("__s"))).select("task_id", "priority", (F.col("__before") + F.col("__i")).alias("r"))
    mine = F.element_at(places, F.col("priority"))
    return t.select("task_id", "priority", (F.floor(F.col("r") / F.size(mine)) * len(slots) + F.get(mine, (F.col("r") % F.size(mine)).cast("int"))).cast("long").alias("position"))


def consolidate(candidates: DataFrame, memories: DataFrame, keys: list[str], same: float = 0.90, update: float = 0.78) -> DataFrame:
    """candidates and memories(keys, id, digest, vector, confidence) -> decision for each candidate: SKIP, UPDATE or ADD, with the closest memory.

    keys are owner and type. Equal digests are looked up, the closest memory comes from blocks of an owner's rows (nearest_by_owner).
    """
    equal = memories.groupBy(*keys, "digest").agg(F.min("id").alias("equal"))
    c = candidates.select(*keys, "id", "digest", "confidence").join(equal, [*keys, "digest"], "left")
    near = nearest_by_owner(candidates.select(*keys, "id", "vector"), memories.select(*keys, F.col("id").alias("memory"), "vector", F.col("confidence").alias("__c")), keys, 1)
    closest = near.where("score > 0").select(*keys, "id", F.struct("memory", "__c", F.col("score").alias("s")).alias("b"))
    g = c.join(closest, [*keys, "id"], "left")
    best = F.coalesce("b.s", F.lit(0.0))
    verdict = F.when(F.col("equal").isNotNull(), "SKIP").when(best >= same, F.when(F.col("confidence") > F.col("b.__c"), "UPDATE").otherwise("SKIP")).when(best >= update, "UPDATE").otherwise("ADD")
    found = F.when(F.col("equal").isNotNull(), F.col("equal")).when(best >= update, F.col("b.memory"))
    return g.select(*keys, "id", verdict.alias("decision"), found.alias("memory"), F.when(F.col("equal").isNotNull(), 1.0).otherwise(best).alias("similarity"))


def backlog(messages: DataFrame, marks: DataFrame, high: int = 3200, extract: int = 120) -> DataFrame:
    """messages(conv_id, turn, text), marks(conv_id, covered, extracted) -> tokens after each mark and whether maintenance is due."""
    t = tokens_message(F.coalesce("text", F.lit("")))
    after = lambda c: F.sum(F.when(F.col("turn") > F.coalesce(c, F.lit(-1)), t).otherwise(0))
    g = messages.join(marks, "conv_id", "left").groupBy("conv_id").agg(after("covered").alias("uncovered"), after("extracted").alias("unextracted"))
    return g.withColumn("due", (F.col("uncovered") > high) | (F.col("unextracted") >= extract))


def merge_evidence(parts: DataFrame, keys: list[str]) -> DataFrame:
    """parts(keys, source, call, place) -> each source once, where it first came, numbered anew."""
    first = parts.groupBy(*keys, "source").agg(F.min(F.struct("call", "place")).alias("__f"))
    return first.select(*keys, "source", F.row_number().over(Window.partitionBy(*keys).orderBy("__f", "source")).alias("index"))


def transcript(messages: DataFrame) -> DataFrame:
    """Messages of a conversation in order as one array of role and text, with how many each role has."""
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    g = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", rank.alias("r"), "role", "text"))).alias("m"), F.count_if(F.col("role") == "user").alias("asked"))
    return g.select("conv_id", "asked", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))


def stale_tasks(tasks: DataFrame, now: str, minutes: int, retries: int) -> DataFrame:
    """tasks(task_id, status, updated, retried): work in progress without a sign for so long goes back to the queue, or fails after so many retries."""
    late = (F.col("status") == "PROCESSING") & (F.col("updated") < F.to_timestamp(F.lit(now)) - F.make_dt_interval(mins=F.lit(minutes)))
    again = F.col("retried") < retries
    # Both columns in one step: whether a task is late depends on its old status.
    return tasks.withColumns({"status": F.when(late, F.when(again, "RETRYING").otherwise("FAILED")).otherwise(F.col("status")), "retried": F.when(late & again, F.col("retried") + 1).otherwise(F.col("retried"))})


def active_or_recent(tasks: DataFrame, keys: list[str], recent: int = 100) -> DataFrame:
    """All active tasks and the latest of each owner, once each."""
    w = Window.partitionBy(*keys).orderBy(F.desc("created"), F.desc("task_id"))
    return tasks.withColumn("__r", F.row_number().over(w)).where(F.col("active") | (F.col("__r") <= recent)).drop("__r")


def tiered(rows: DataFrame, keys: list[str], required: Column, order: list[Column], most: int) -> DataFrame:
    """All required rows, then others in order while there is room."""
    w = Window.partitionBy(*keys).orderBy(required.desc(), *order)
    return rows.withColumn("place", F.row_number().over(w)).where(required | (F.col("place") <= most))


def by_depth(rows: DataFrame, keys: list[str], page: str, order: list[Column], most: int) -> DataFrame:
    """The first row of every page, then the second of every page, and so on, up to most."""
    r = rows.withColumn("__d", F.row_number().over(Window.partitionBy(*keys, page).orderBy(*order)))
    return r.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("__d", page))).where(F.col("place") <= most).drop("__d")


def advanced_marks(marks: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """marks and rows(keys, at, id) -> the marks after the rows: the later pair of time and id, so a mark never goes back."""
    return marks.select(*keys, "at", "id").unionByName(rows.select(*keys, "at", "id")).groupBy(*keys).agg(F.max(F.struct("at", "id")).alias("m")).select(*keys, "m.*")


def task_priority(kind: Column, interactive: list[str], background: list[str]) -> Column:
    return F.when(kind.isin(interactive), 0).when(kind.isin(background), 2).otherwise(1)
