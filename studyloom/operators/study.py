"""Study analytics: profiles, plans, item targets, grading, quality gates, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_up, jaccard, tokens
from ..sources.shared import settle
from .retrieval import top


def mistakes(events: DataFrame, keys: list[str]) -> DataFrame:
    """events(keys, mistake_type, summary, ts, event_id) -> one row for each kind of mistake: how often, first and last seen, last event."""
    kind = F.upper(F.coalesce(F.col("mistake_type"), F.lit("UNCLASSIFIED")))
    e = events.withColumn("mistake", F.sha2(F.concat_ws("\n", kind, F.lower(F.coalesce("summary", F.lit("")))), 256))
    return e.groupBy(*keys, "mistake").agg(F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


def top_mistakes(found: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The k most frequent mistakes of each key, in order, as one array."""
    best = top(found, keys, [F.desc("occurrences"), F.col("mistake")], k)
    return best.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "mistake"))), lambda x: x["mistake"]).alias("top"))


def weak_topics(states: DataFrame, topic: str, least: float = 0.75) -> DataFrame:
    """states(topic, mastery, evidence, needs_review) -> weak or flagged states only, joined by topic: weighted mastery, weakness and reasons."""
    w = F.greatest(F.col("evidence"), F.lit(0.1))
    g = states.where((F.col("mastery") < least) | F.col("needs_review")).groupBy(topic).agg((F.sum(F.col("mastery") * w) / F.sum(w)).alias("m"), F.bool_or("needs_review").alias("due"), F.count("*").alias("states"))
    reasons = F.concat_ws(",", F.when(F.col("m") < least, "low mastery"), F.when(F.col("due"), "needs review"))
    return g.select(topic, F.round("m", 6).alias("mastery"), F.round(1 - F.col("m"), 4).alias("weakness"), "states", reasons.alias("reasons"))


def preferences(events: DataFrame, keys: list[str], value: str, least: int = 5) -> DataFrame:
    """Behaviour as preference: the latest value, how many events in a row showed it (evidence), its confidence, and whether that is enough to show."""
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    e = events.withColumn("__n", F.row_number().over(w)).withColumn("__new", ~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.col("__n") == 1))
    g = e.groupBy(*keys).agg(F.max_by(value, "__n").alias(value), (F.max("__n") - F.max(F.when(F.col("__new"), F.col("__n"))) + 1).cast("long").alias("evidence"))
    return g.withColumn("confidence", F.least(F.lit(0.95), F.col("evidence") / 10)).withColumn("visible", F.col("evidence") >= least)


def edge_means(links: DataFrame) -> DataFrame:
    """links(a, b, weight) -> running mean of an edge's weight by evidence, which is the plain mean."""
    return links.where("a <> b").groupBy("a", "b").agg(F.round(F.avg("weight"), 6).alias("weight"), F.count("*").alias("evidence"))


def stale(states: DataFrame, now: str, days: int = 30, confidence: float = 0.25) -> DataFrame:
    """States of little confidence without activity for max(30, days) days."""
    return states.where((F.col("confidence") < confidence) & (F.col("last") < F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(max(30, days)))))


def variant(key: Column, names: list[str]) -> Column:
    """The experiment variant of a key, by its SHA-256."""
    return F.get(F.array(*map(F.lit, names)), (F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % len(names)).cast("int"))


def study_plan(due: DataFrame, weak: DataFrame, key: str, minutes: int, due_first: bool = True, review: int = 15, practice: int = 20, take: int = 12) -> DataFrame:
    """due and weak(key, topic, place, in_goal): the first 12 of each by place, those of the goal first, each topic once, in blocks until the minutes (10 to 480) are used up."""
    budget = max(10, min(480, minutes))
    lists = [(due, "REVIEW", review), (weak, "PRACTICE", practice)]
    rows = None
    for tier, (d, action, block) in enumerate(lists if due_first else lists[::-1]):
        part = top(d, [key], [F.col("place"), F.col("topic")], take, "__r").select(key, "topic", F.lit(tier).alias("__t"), (~F.col("in_goal")).alias("__g"), "__r", F.lit(action).alias("action"), F.lit(block).alias("__b"))
        rows = part if rows is None else rows.unionByName(part)
    order = [F.col("__t"), F.col("__g"), F.col("__r")]
    once = top(rows, [key, "topic"], order, 1, "__k")
    w = Window.partitionBy(key).orderBy(*order)
    once = once.withColumn("__s", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__b")).withColumn("step", F.row_number().over(w))
    return once.where(F.col("__s") < budget).select(key, "step", "topic", "action", F.least(F.col("__b"), budget - F.col("__s")).cast("long").alias("minutes"))


def item_targets(groups: DataFrame, key: str, per_1000: float, most: int) -> DataFrame:
    """groups(key, group_index, tokens) -> how many items each group gets: one at least, in proportion to its tokens, most in all (or one a group)."""
    w = Window.partitionBy(key)
    n, total = F.count("*").over(w), F.sum("tokens").over(w)
    g = groups.withColumn("__n", n).withColumn("__t", total)
    g = g.withColumn("__all", F.least(F.greatest(F.lit(most), F.col("__n")), F.greatest(F.col("__n"), F.bround(F.col("__t") / 1000 * per_1000, 0))))
    raw = (F.col("__all") - F.col("__n")) * F.col("tokens") / F.when(F.col("__t") > 0, F.col("__t")).otherwise(F.col("__n"))
    g = g.withColumn("__raw", raw).withColumn("__rest", F.round(F.col("__raw") - F.floor(F.col("__raw")), 9))
    extra = F.row_number().over(w.orderBy(F.desc("__rest"), "group_index")) <= F.col("__all") - F.col("__n") - F.sum(F.floor("__raw")).over(w)
    return g.select(key, "group_index", "tokens", (1 + F.floor("__raw") + extra.cast("long")).cast("long").alias("items"))


def cited_pages(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """citations(item, source), sources(source, page_start, page_end) -> every (item, page) cited, once."""
    return citations.join(sources, "source").select("item", F.explode(F.sequence("page_start", "page_end")).alias("page")).distinct()


def grade_objective(questions: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """questions(key, expected, points, objective), answers(key, given): trimmed upper-case equality; missing answers get none; free texts wait."""
    same = F.upper(F.trim("expected")) == F.upper(F.trim("given"))
    j = questions.join(answers, key, "left")
    return j.select(*key, F.when(~F.col("objective") & F.col("given").isNotNull(), None).when(same, F.col("points")).otherwise(0.0).alias("awarded"), (~F.col("objective") & F.col("given").isNotNull()).alias("waits"))


def artifact_gate(items: DataFrame, key: str, digest: str, grounded: Column, confident: Column, expected: Column) -> DataFrame:
    """An artifact passes with all expected items, all grounded and confident, and no two of equal digest.

    Digests are counted by (key, digest) first, so a repeated item of a large artifact never meets all others in one task.
    """
    per = items.groupBy(key, digest).agg(F.count("*").alias("n"), F.count_if(~grounded).alias("u"), F.count_if(~confident).alias("c"), F.max(expected).alias("e"))
    g = per.groupBy(key).agg(F.sum("n").alias("items"), F.sum("u").alias("ungrounded"), F.sum("c").alias("unsure"), (F.sum("n") - F.count("*")).alias("repeated"), F.max("e").alias("__e"))
    ok = (F.col("items") >= F.col("__e")) & (F.col("ungrounded") == 0) & (F.col("unsure") == 0) & (F.col("repeated") == 0)
    return g.withColumn("passes", ok).drop("__e")


def review_priority(ratio: Column, due: Column) -> Column:
    """Up to 100 for what is not mastered and up to 30 for due cards, three each."""
    return F.round((1 - ratio) * 100 + F.least(F.lit(30.0), 3 * due), 4)


def task_score(urgency: Column, importance: Column, effort: Column) -> Column:
    return half_up((0.45 * urgency + 0.55 * importance) / F.sqrt(F.greatest(effort, F.lit(0.25))), 6)


def claim_support(claims: DataFrame, least: float = 0.35) -> DataFrame:
    """claims(id, claim, evidence) -> share of the claim's terms found in its evidence; too little is flagged."""
    c = F.array_distinct(tokens(F.col("claim")))
    share = F.when(F.size(c) > 0, F.size(F.array_intersect(c, tokens(F.col("evidence")))) / F.size(c)).otherwise(0.0)
    s = claims.select("id", F.round(share, 6).alias("overlap"))
    return s.withColumn("unsupported", F.col("overlap") < least)


def finished_groups(saved: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Groups with at least as many saved sections as expected: what a resumed run skips."""
    return saved.groupBy(*keys).agg(F.count("*").alias("saved")).join(expected, keys).where("saved >= expected").select(*keys)


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes(node, parent), roots(node) -> (node, root, depth) of all descendants, level by level until one is empty. A tree, so no node is met twice; each level is written."""
    level = settle(roots.join(nodes.select("node"), "node", "left_semi").select("node", F.col("node").alias("root"), F.lit(0).alias("depth")))
    out, k = level, 0
    while not level.isEmpty():
        k += 1
        level = settle(nodes.join(level.select(F.col("node").alias("parent"), "root"), "parent").select("node", "root", F.lit(k).alias("depth")))
        out = out.unionByName(level)
    return out


def retrieval_quality(hits: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """hits(query_id, id, rank), expected(query_id, id) -> recall at k and reciprocal rank of each query that expects something."""
    found = expected.distinct().join(hits, ["query_id", "id"], "left")
    g = found.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count_if(F.col("rank") <= k).alias("got"), F.min("rank").alias("first"))
    return g.select("query_id", F.round(F.col("got") / F.least(F.col("wanted"), F.lit(k)), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def token_similarity(a: Column, b: Column) -> Column:
    return F.round(jaccard(F.array_distinct(tokens(a)), F.array_distinct(tokens(b))), 6)
