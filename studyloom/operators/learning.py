"""Learning memory and study analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle
from .folds import fold_rows
from .retrieval import top


def updates(events: DataFrame) -> DataFrame:
    """events(kind, correct, hint, grade, difficulty) -> with delta of mastery, weight of evidence, signal, days to the next review, attempt, right and flagged. The numbers are fixed values."""
    mult = F.when(F.col("difficulty") == "EASY", 0.75).when(F.col("difficulty") == "HARD", 1.35).otherwise(1.0)
    grade = lambda a, h, g, e: F.when(F.col("grade") == "AGAIN", a).when(F.col("grade") == "HARD", h).when(F.col("grade") == "GOOD", g).otherwise(e)
    kind = F.col("kind")
    answer = F.when(F.col("correct"), 0.06).otherwise(-0.10) * mult * F.when(F.col("hint") & F.col("correct"), 0.55).otherwise(1.0)
    delta = F.when(kind == "MASTERED", 0.20).when(kind == "CONFUSED", -0.16).when(kind == "REVIEW", grade(-0.08, 0.012, 0.035, 0.055)).when(kind == "ANSWER", answer).otherwise(0.005)
    weight = F.when(kind == "MASTERED", 2.0).when(kind == "CONFUSED", 2.0).when(kind == "REVIEW", grade(1.0, 0.8, 1.0, 1.2)).when(kind == "ANSWER", mult * F.when(F.col("hint"), 0.65).otherwise(1.0)).otherwise(0.15)
    signal = F.when(kind == "MASTERED", 1.0).when(kind == "CONFUSED", -1.0).when(kind == "REVIEW", grade(-1.0, 0.2, 0.7, 1.0)).when(kind == "ANSWER", F.when(F.col("correct"), 1.0).otherwise(-1.0)).otherwise(0.05)
    days = F.when(kind == "MASTERED", 14).when(kind == "CONFUSED", 1).when(kind == "REVIEW", grade(1, 2, 5, 10)).when(kind == "ANSWER", F.when(F.col("correct"), 5).otherwise(1)).otherwise(3)
    right = F.when(kind == "REVIEW", F.col("grade") != "AGAIN").otherwise(F.coalesce("correct", F.lit(False)))
    attempt = kind.isin("REVIEW", "ANSWER")
    return events.withColumns({"delta": delta, "weight": weight, "signal": signal, "days": days.cast("long"), "attempt": attempt, "right": right, "flagged": (kind == "CONFUSED") | (attempt & ~right)})


def ingest(events: DataFrame, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """Each key once (the earliest row by time and id); keys that are known already are left out."""
    first = events.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id"))).where("__r = 1").drop("__r")
    return first.join(known.select(*keys).distinct(), keys, "left_anti") if known is not None else first


def fold_mastery(events: DataFrame, keys: list[str], bucket: str = "day") -> DataFrame:
    """Mastery from 0.5 by each delta, kept in 0..1 after every step, in order of time and id; attempts and the current streak.

    "Add d, then clip" composes: any run of events acts as x -> min(hi, max(lo, x + s)). So a key's events are first folded within each
    bucket of time, in parallel, and then its buckets in order: no task holds all events of a key, however many it has.
    """
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("streak"))
    one = lambda acc, e: F.struct(
        clip(acc["lo"] + e["delta"]).alias("lo"), clip(acc["hi"] + e["delta"]).alias("hi"), (acc["s"] + e["delta"]).alias("s"),
        (acc["n"] + 1).alias("n"), F.when(e["correct"], acc["streak"] + 1).otherwise(0).cast("long").alias("streak"),
    )
    g = events.groupBy(*keys, F.date_trunc(bucket, "ts").alias("__b")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "delta", "correct"))).alias("e"))
    runs = g.select(*keys, "__b", F.aggregate("e", start, one).alias("r"))
    first = F.struct(F.lit(0.5).alias("mastery"), F.lit(0).cast("long").alias("events"), F.lit(0).cast("long").alias("streak"))
    join = lambda acc, x: F.struct(
        F.least(x["r"]["hi"], F.greatest(x["r"]["lo"], acc["mastery"] + x["r"]["s"])).alias("mastery"), (acc["events"] + x["r"]["n"]).alias("events"),
        (x["r"]["streak"] + F.when(x["r"]["streak"] == x["r"]["n"], acc["streak"]).otherwise(0)).alias("streak"),
    )
    whole = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__b", "r"))).alias("b")).select(*keys, F.aggregate("b", first, join).alias("s"))
    return whole.select(*keys, F.round("s.mastery", 6).alias("mastery"), "s.events", "s.streak")


def weighted_mastery(states: DataFrame, keys: list[str]) -> DataFrame:
    """Mean mastery by weight of evidence (0.1 at least), with the usual companions."""
    w = F.greatest(F.col("weight"), F.lit(0.1))
    return states.groupBy(*keys).agg(F.round(F.sum(F.col("mastery") * w) / F.sum(w), 6).alias("mastery"), F.max("last").alias("last"), F.sum("attempts").alias("attempts"), F.bool_or("review").alias("review"))


def review_cards(reviews: DataFrame) -> DataFrame:
    """reviews(card, ts, event_id, grade) -> spaced-repetition state after all reviews of a card, by the SM-2 rule. The numbers are fixed values."""
    quality, factor = {"AGAIN": 1, "HARD": 3, "GOOD": 4, "EASY": 5}, {"HARD": 0.8, "EASY": 1.3}

    def step(state, grade):
        ease, reps, days = state
        q = quality.get(grade, 5)
        ease = max(1.3, ease + 0.1 - (5 - q) * (0.08 + 0.02 * (5 - q)))
        if q == 1:
            return (round(ease, 4), 0, 1.0), []
        reps += 1
        base = {1: 1.0, 2: 6.0}.get(reps, float(round(days * ease)))
        return (round(ease, 4), reps, max(1.0, min(36500.0, float(round(base * factor[grade])) if grade in factor else base))), []

    finish = lambda s: [(s[0], s[1], int(s[2]), "REVIEW" if s[1] >= 2 else "LEARNING")]
    return fold_rows(reviews, ["card"], ["ts", "event_id"], ["grade"], "ease double, reps long, days long, status string", lambda: (2.5, 0, 0.0), step, finish)


def apportion(groups: DataFrame, keys: list[str], seats: str, weight: str, part: str) -> DataFrame:
    """Largest remainders: seats of each key over its parts by weight; ties go to the heavier part, then the first."""
    w = Window.partitionBy(*keys)
    exact = F.col(seats) * F.col(weight) / F.sum(weight).over(w)
    g = groups.withColumn("__floor", F.floor(exact + 1e-9)).withColumn("__rest", F.round(exact - F.floor(exact + 1e-9), 9))
    order = w.orderBy(F.desc("__rest"), F.desc(weight), F.col(part))
    extra = F.row_number().over(order) <= F.col(seats) - F.sum("__floor").over(w)
    return g.withColumn("given", (F.col("__floor") + extra.cast("long")).cast("long")).drop("__floor", "__rest")


#: Links whose pairs a task counts at a time.
LINK_BLOCK = 500_000


def cooccurrence(links: DataFrame, first: float = 0.4, more: float = 0.02) -> DataFrame:
    """links(artifact, topic) -> edges (a, b, artifacts, weight), a < b; weight grows with each artifact that has both, to 1 at most.

    Links are dealt by artifact to as many tasks as their number asks for, so what a task counts does not grow with the table.
    """
    rows = links.where("artifact IS NOT NULL AND topic IS NOT NULL").select("artifact", "topic")
    t = rows.repartition(max(1, -(-rows.count() // LINK_BLOCK)), "artifact").groupBy("artifact").agg(F.sort_array(F.collect_set("topic")).alias("t"))
    pairs = t.select("t", F.posexplode("t").alias("n", "a")).select("a", F.explode(F.slice("t", F.col("n") + 2, F.size("t"))).alias("b"))
    g = pairs.groupBy("a", "b").agg(F.count("*").alias("artifacts"))
    return g.withColumn("weight", F.round(F.least(F.lit(1.0), first + more * (F.col("artifacts") - 1)), 6))


def reachable(edges: DataFrame, start: DataFrame, depth: int = 4) -> DataFrame:
    """edges(a, b), start(node) -> (node, depth): least number of steps from any start. Each step is one join with what is new, and is written."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    last = settle(start.select("node", F.lit(0).alias("depth")).distinct())
    seen = last
    for k in range(1, depth + 1):
        fresh = last.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        last = settle(fresh.withColumn("depth", F.lit(k)))
        seen = seen.unionByName(last)
    return seen


def topic_paths(edges: DataFrame, starts: DataFrame, depth: int = 4, most: int = 200) -> DataFrame:
    """edges(a, b, weight), starts(start) -> (start, a, b, weight, depth, path, rank): the last edge of each path without a repeated node, by depth, weight and path, the first `most` of each start.

    A start that has that many paths needs none that are longer, so one that goes on has fewer; and of a node's edges the heaviest
    most + depth are enough, as depth nodes at most are on the path already. So each level has a bounded number of rows for a start, however
    many edges its nodes have. Levels are written; a start without edges has no rows; edges given twice are paths of their own.
    """
    near = settle(top(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b", "weight"), ["a"], [F.desc("weight"), F.col("b")], most + depth, "__p").drop("__p"))
    level = starts.select("start").distinct().join(near, F.col("start") == F.col("a")).withColumn("path", F.array("a", "b"))
    found = None
    for d in range(1, depth + 1):
        level = settle(level.withColumn("depth", F.lit(d)))
        if level.isEmpty():
            break
        best = top(level, ["start"], [F.desc("weight"), F.col("path")], most)
        found = best.drop("rank") if found is None else found.unionByName(best.drop("rank"))
        going = found.groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") < most).select("start")
        end = level.join(going, "start", "left_semi").select("start", "path", F.col("b").alias("end"))
        level = end.join(near, F.col("end") == F.col("a")).where(~F.array_contains("path", F.col("b"))).select("start", "a", "b", "weight", F.concat("path", F.array("b")).alias("path"))
    if found is None:
        found = level.withColumn("depth", F.lit(0))
    return top(found, ["start"], [F.col("depth"), F.desc("weight"), F.col("path")], most).select("start", "a", "b", "weight", "depth", "path", "rank")


def quiz_results(answers: DataFrame) -> DataFrame:
    """answers(attempt, topic, awarded (null: not graded), possible) -> totals, what is left to grade, weak topics by ratio."""
    per = answers.groupBy("attempt", "topic").agg(F.sum("awarded").alias("got"), F.sum("possible").alias("of"), F.count_if(F.col("awarded").isNull()).alias("left"))
    ratio = F.round(F.coalesce(F.col("got"), F.lit(0.0)) / F.col("of"), 4)
    weak = F.when((F.col("of") > 0) & (ratio < 0.7), F.struct(ratio.alias("ratio"), F.col("topic").alias("topic")))
    g = per.groupBy("attempt").agg(F.round(F.coalesce(F.sum("got"), F.lit(0.0)), 4).alias("total"), F.sum("left").alias("ungraded"), F.sort_array(F.collect_list(weak)).alias("w"))
    return g.select("attempt", "total", "ungraded", F.array_join(F.transform("w", lambda x: x["topic"].cast("string")), ",").alias("weak_topics"))
