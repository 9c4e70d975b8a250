"""Predicates, aggregates and status rules over the records of a workspace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_up
from ..sources.shared import settle
from .retrieval import top


def matching(rows: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows with the term in any of the columns, in any case; an empty term filters nothing, and then no predicate is planned."""
    term = term.strip().lower()
    return rows.where(reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(term) for c in columns])) if term else rows


def among(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """Rows whose key is wanted; an empty list filters nothing."""
    return rows.where(F.col(key).isin(wanted)) if wanted else rows


def excerpt(text: Column, size: int) -> Column:
    return F.substring(text, 1, size)


def alive(rows: DataFrame, expires: str, now: str) -> DataFrame:
    """Rows that never expire or do so after now."""
    return rows.where(F.col(expires).isNull() | (F.col(expires) > F.to_timestamp(F.lit(now))))


def after_mark(rows: DataFrame, mark: DataFrame, owner: str, at: str, key: str) -> DataFrame:
    """Rows behind their owner's mark(owner, at, key), compared as a pair; owners without a mark give all."""
    m = mark.select(owner, F.struct(F.col(at), F.col(key)).alias("__m"))
    return rows.join(m, owner, "left").where(F.col("__m").isNull() | (F.struct(at, key) > F.col("__m"))).drop("__m")


def pipeline_status(documents: DataFrame, tasks: DataFrame, key: str) -> DataFrame:
    """documents(key, has_result), tasks(key, status, created, task_id): what a user sees of a step, from its latest task and its result."""
    last = tasks.groupBy(key).agg(F.max_by("status", F.struct("created", "task_id")).alias("__s"))
    busy = F.col("__s").isin("PENDING", "PROCESSING", "RETRYING")
    shown = F.when(busy, "PROCESSING").when(F.col("has_result"), "READY").when(F.col("__s") == "FAILED", "FAILED").otherwise("NOT_STARTED")
    return documents.join(last, key, "left").select(key, shown.alias("status"))


def json_fields(rows: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Named fields of a JSON column, each cast to its type; what is missing or can't be cast is null."""
    return rows.select("*", *[F.get_json_object(column, f"$.{name}").try_cast(kind).alias(name) for name, kind in fields.items()])


def chunk_scope(chunks: DataFrame, order: DataFrame, ids: DataFrame | None = None, section: str = "") -> DataFrame:
    """chunks(doc_id, id, chunk_index, section) of the documents in order(doc_id, place), optionally only those in ids(id) or whose section holds a word; with place in that order."""
    c = chunks.join(order, "doc_id")
    c = c.join(ids.select("id").distinct(), "id", "left_semi") if ids is not None else c
    return matching(c, section, ["section"])


def argument_errors(arguments: Column, schema: dict[str, tuple[str, bool, tuple[str, ...]]]) -> Column:
    """Names of what is wrong with a JSON object against schema(name -> (type, required, allowed values)): unknown, missing, wrong type, not allowed."""
    keys = F.json_object_keys(arguments)
    known = F.array(*map(F.lit, sorted(schema)))
    shape = {"integer": "^-?[0-9]+$", "number": "^-?[0-9]+([.][0-9]+)?([eE][-+]?[0-9]+)?$", "boolean": "^(true|false)$", "string": "(?s).*"}
    errors = [F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit("unknown "), k))]
    for name, (kind, required, allowed) in sorted(schema.items()):
        v = F.get_json_object(arguments, f"$.{name}")
        wrong = ~v.rlike(shape[kind])
        if allowed:
            wrong = wrong | ~v.isin(*allowed)
        rule = F.when(v.isNull(), F.lit(f"missing {name}") if required else F.lit(None)).when(wrong, F.lit(f"wrong {name}"))
        errors.append(F.array_compact(F.array(rule)))
    return F.when(keys.isNull(), F.array(F.lit("no object"))).otherwise(F.concat(*errors))


def redacted(arguments: Column, pattern: str = "(?i)(key|token|secret|password)") -> Column:
    """A map with the values of telling keys hidden."""
    return F.transform_values(arguments, lambda k, v: F.when(k.rlike(pattern), F.lit("[redacted]")).otherwise(v))


def attempt_counts(answers: DataFrame, key: str) -> DataFrame:
    """answers(key, correct, topic, digest, score, of, ms): counts with filters, distinct and repeated ones, mean guarded ratio, mean time of what was timed."""
    d = answers.groupBy(key, "digest").agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("w"), F.sum(F.when(F.col("of") > 0, F.col("score") / F.col("of"))).alias("r"), F.count_if(F.col("of") > 0).alias("rn"), F.sum("ms").alias("ms"), F.count("ms").alias("mn"))
    g = d.groupBy(key).agg(F.sum("n").alias("answers"), F.sum("w").alias("wrong"), F.count("*").alias("different"), F.sum("r").alias("r"), F.sum("rn").alias("rn"), F.sum("ms").alias("ms"), F.sum("mn").alias("mn"))
    safe = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return g.select(key, "answers", "wrong", "different", (F.col("answers") - F.col("different")).alias("repeated"), half_up(safe("r", "rn"), 6).alias("mean_ratio"), half_up(safe("ms", "mn"), 6).alias("mean_ms"))


def topic_performance(answers: DataFrame, least: float = 0.75, often: int = 2) -> DataFrame:
    """answers(topic, correct, score, of) -> per topic: answers, wrong ones, mean ratio, weakness, whether weak or often wrong; with the mean over all answers."""
    ratio = F.avg(F.when(F.col("of") > 0, F.col("score") / F.col("of")))
    g = answers.groupBy("topic").agg(F.count("*").alias("answers"), F.count_if(~F.col("correct")).alias("wrong"), F.coalesce(ratio, F.lit(0.0)).alias("r"))
    whole = g.agg((F.sum(F.col("r") * F.col("answers")) / F.sum("answers")).alias("all"))
    r = half_up(F.col("r"), 6)
    out = g.crossJoin(F.broadcast(whole))  # one row
    return out.select("topic", "answers", "wrong", r.alias("ratio"), half_up(1 - F.col("r"), 4).alias("weakness"), (F.col("r") < least).alias("weak"), (F.col("wrong") >= often).alias("often_wrong"), half_up(F.col("all"), 6).alias("overall"))


def distribution(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def matching_chunks(documents: DataFrame, chunks: DataFrame, term: str) -> DataFrame:
    """documents(doc_id, title, created), chunks(doc_id, content) -> documents with the term in their title or a chunk, titles first, then by matching chunks."""
    hit = F.lower("content").contains(term.lower())
    n = chunks.where(hit).groupBy("doc_id").agg(F.count("*").alias("matching"))
    d = documents.join(n, "doc_id", "left").withColumn("matching", F.coalesce("matching", F.lit(0))).withColumn("titled", F.lower("title").contains(term.lower())).where("titled OR matching > 0")
    return d.select("doc_id", "titled", "matching", "created")


def next_version(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The version that the next row of each wanted key gets."""
    last = rows.groupBy(*keys).agg(F.max("version").alias("v"))
    return wanted.join(last, keys, "left").select(*keys, (F.coalesce("v", F.lit(0)) + 1).alias("version"))


def usage(calls: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in columns])


def clamped(value: int | None, default: int, most: int, least: int = 1) -> int:
    return max(least, min(most, default if value is None else value))


def first_rows(rows: DataFrame, order: list[Column], limit: int | None, default: int = 8, most: int = 30) -> DataFrame:
    """The first rows in order, as many as asked for within bounds."""
    return rows.orderBy(*order).limit(clamped(limit, default, most))


def coverage(found: Column, required: Column) -> Column:
    """Struct of the share of required that was found (1 if nothing is), what was covered and what is missing, each once."""
    want = F.array_distinct(required)
    covered = F.array_sort(F.array_intersect(want, found))
    share = F.when(F.size(want) > 0, F.size(covered) / F.size(want)).otherwise(1.0)
    return F.struct(half_up(share, 6).alias("ratio"), covered.alias("covered"), F.array_sort(F.array_except(want, found)).alias("missing"))


def updated_from(target: DataFrame, rows: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """target with column set to an aggregate of the rows of equal key; keys without rows keep their value."""
    g = rows.groupBy(key).agg(value.alias("__v"))
    return target.join(g, key, "left").withColumn(column, F.coalesce("__v", column)).select(*target.columns)


def with_titles(rows: DataFrame, titles: DataFrame, key: str, default: str = "Untitled") -> DataFrame:
    """rows with the title of their key, or the default; a plain left join, which Spark broadcasts where titles are small."""
    return rows.join(titles.select(key, "title"), key, "left").withColumn("title", F.coalesce("title", F.lit(default)))


def topic_key(topic: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(topic, "\\s+", " ")))


def confidence(value: Column) -> Column:
    """A number or its text, also as a percentage, to 0..1; null where it is none of these."""
    n = value.cast("string").try_cast("double")
    n = F.when((n > 1) & (n <= 100), n / 100).otherwise(n)
    return F.when(n.between(0, 1), n)


def merged_expectations(parts: DataFrame, keys: list[str]) -> DataFrame:
    """parts(keys, expected map<string, long>) -> one map: for each name the largest value."""
    e = parts.select(*keys, F.explode("expected").alias("name", "n")).groupBy(*keys, "name").agg(F.max("n").alias("n"))
    return e.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("expected"))


def goals(rows: DataFrame, key: str) -> DataFrame:
    """Latest state of each goal(key, goal, priority, deadline, status, at), priority kept in 0..100, with its place: high priority first, then early deadline, none last."""
    last = top(rows, [key, "goal"], [F.desc("at")], 1, "__n").drop("__n").withColumn("priority", F.greatest(F.lit(0), F.least(F.lit(100), F.col("priority"))))
    w = Window.partitionBy(key).orderBy(F.desc("priority"), F.asc_nulls_last("deadline"), "goal")
    return last.where("status = 'ACTIVE'").withColumn("place", F.row_number().over(w)).select(key, "goal", "priority", "deadline", "place")


def interactions(links: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """links(key, artifact, topic), events(artifact, correct) -> each linked artifact with how often it was used, and how often with success."""
    e = events.groupBy("artifact").agg(F.count("*").alias("uses"), F.count_if("correct").alias("good"))
    return links.dropDuplicates([key, "artifact"]).join(e, "artifact", "left").select(key, "artifact", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("good", F.lit(0)).alias("good"))


def trend(history: DataFrame, keys: list[str], limit: int = 50) -> DataFrame:
    """The newest states of each key, newest first; limit is kept in 2..500."""
    return top(history, keys, [F.desc("version")], clamped(limit, 50, 500, 2), "place")


def corrected(states: DataFrame, corrections: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """states(key, mastery, version), corrections(key, mastery, expected, reason) -> (states after, log); a correction counts only if its expected version is the state's."""
    c = corrections.select(key, F.col("expected").alias("version"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mastery"))).alias("__to"), "reason")
    j = states.join(c, [key, "version"], "left")
    log = j.where("__to IS NOT NULL").select(key, F.col("mastery").alias("before"), F.col("__to").alias("after"), "reason", (F.col("version") + 1).alias("version"))
    after = j.select(key, F.coalesce("__to", "mastery").alias("mastery"), F.when(F.col("__to").isNotNull(), F.col("version") + 1).otherwise(F.col("version")).alias("version"))
    return after, log


def attempt_events(answers: DataFrame, questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Graded answers(attempt, question, correct) of finished attempts(attempt, user, at, finished) with their questions' topic as learning events, one each."""
    a = answers.where("correct IS NOT NULL").join(questions.select("question", "topic", "difficulty"), "question").join(attempts.where("finished").select("attempt", "user", "at"), "attempt")
    return a.select("user", F.concat_ws(":", F.lit("quiz"), "attempt", "question").alias("event"), topic_key(F.col("topic")).alias("topic"), "correct", "difficulty", "at")


def feedback_events(feedback: DataFrame) -> DataFrame:
    """feedback(id, user, topic, kind): what a remark says, as an event for a topic or a preference. The pairs are fixed values."""
    kind = F.col("kind")
    event = F.when(kind == "TOO_HARD", "CONFUSED").when(kind == "ALREADY_KNOWN", "MASTERED")
    wish = F.when(kind == "TOO_EASY", "HARD").when(kind == "MORE_PRACTICE", "MORE")
    return feedback.select("id", "user", "topic", event.alias("event"), wish.alias("preference")).where("event IS NOT NULL OR preference IS NOT NULL")


def fan_out(activity: DataFrame, topics: DataFrame, most: int = 20) -> DataFrame:
    """activity(id, doc), topics(doc, topic, at): an event for each of a document's latest topics."""
    last = top(topics, ["doc"], [F.desc("at"), F.col("topic")], most, "__n").drop("__n")
    return activity.join(last.select("doc", "topic"), "doc").select("id", "doc", "topic")


def document_list(documents: DataFrame, notes: DataFrame, tasks: DataFrame) -> DataFrame:
    """documents(doc_id), notes(doc_id, version, status), tasks(doc_id, status, created, task_id) -> each document with the status of its latest note and of its embeddings."""
    n = notes.groupBy("doc_id").agg(F.max_by("status", "version").alias("note"))
    t = tasks.groupBy("doc_id").agg(F.max_by("status", F.struct("created", "task_id")).alias("embedding"))
    return documents.select("doc_id").join(n, "doc_id", "left").join(t, "doc_id", "left").select("doc_id", F.coalesce("note", F.lit("NOT_STARTED")).alias("note"), F.coalesce("embedding", F.lit("NOT_STARTED")).alias("embedding"))


def days_later(at: Column, days: Column) -> Column:
    """A time some days on; parts of a day round up."""
    return at + F.make_dt_interval(days=F.ceil(days).cast("int"))


def minutes_before(now: str, minutes: Column) -> Column:
    return F.to_timestamp(F.lit(now)) - F.make_dt_interval(mins=minutes)


def attempt_results(attempts: DataFrame, answers: DataFrame) -> DataFrame:
    """attempts(attempt, status, total), answers(attempt, number, given, awarded) -> each attempt with its answers in order."""
    a = answers.groupBy("attempt").agg(F.sort_array(F.collect_list(F.struct("number", "given", "awarded"))).alias("answers"))
    return attempts.join(a, "attempt", "left").select("attempt", "status", "total", F.coalesce("answers", F.array().cast("array<struct<number:int,given:string,awarded:double>>")).alias("answers"))


def learning_profile(states: DataFrame, keys: list[str]) -> DataFrame:
    """states(keys, mastery, attempts, needs_review) -> topics, attempts, plain mean mastery and how many need review."""
    return states.groupBy(*keys).agg(F.count("*").alias("topics"), F.sum("attempts").alias("attempts"), half_up(F.avg("mastery"), 9).alias("mastery"), F.count_if("needs_review").alias("due"))


def of_key(rows: DataFrame, key: str, values: DataFrame, order: list[Column]) -> DataFrame:
    """The rows of the given keys, each key's in order and numbered; the filter is a semi-join, so a scan by key reads no others where the table is laid out by it."""
    mine = rows.join(values.select(key).distinct(), key, "left_semi")
    return mine.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def percentiles_by_index(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """rows(key, value) -> a row for each key: the value at index share * (n - 1), rounded half up, of its values in order, for each named share.

    Rows with a null value don't count; a key without others is absent, a null key is one key. Values are sorted by ranges that one key may fill many of, and
    written; the ranges' counts tell in which one an index lies, and only those are ranked. So no task has a whole key, however large it is.
    """
    spark = rows.sparkSession
    v = rows.where(F.col(value).isNotNull()).select(F.struct(F.col(key).alias("k")).alias("__k"), F.col(value).alias("__v")).groupBy("__k", "__v").agg(F.count("*").alias("__c"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cut = settle(v.repartitionByRange(parts, "__k", "__v").withColumn("__p", F.spark_partition_id()))
    w = Window.partitionBy("__k")
    per = cut.groupBy("__k", "__p").agg(F.sum("__c").alias("__in"))
    per = per.withColumn("__n", F.sum("__in").over(w)).withColumn("__before", F.sum("__in").over(w.orderBy("__p")) - F.col("__in"))
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(s)).alias("share")) for n, s in shares.items()]))
    at = per.withColumn("__s", asked).withColumn("__i", F.floor(F.col("__s.share") * (F.col("__n") - 1) + 0.5) - F.col("__before")).where("__i >= 0 AND __i < __in")
    hit = cut.join(at.select("__k", "__p").distinct(), ["__k", "__p"], "left_semi")
    hit = hit.withColumn("__upto", F.sum("__c").over(Window.partitionBy("__k", "__p").orderBy("__v")))
    found = hit.join(at.select("__k", "__p", "__s.name", "__i"), ["__k", "__p"]).where("__i < __upto AND __i >= __upto - __c")
    return found.groupBy("__k").agg(*[F.max(F.when(F.col("name") == n, F.col("__v"))).alias(n) for n in shares]).select(F.col("__k.k").alias(key), *shares)
