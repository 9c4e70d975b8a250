"""Generated study material and conversations: validation, acceptance, versions, grading, reports, memory steps and task states."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, half_up
from ..sources.shared import settle
from .folds import fold_rows
from .records import confidence
from .retrieval import nearest_by_owner, top

#: Shares of easy, medium and hard items, and what material may consist of.
DIFFICULTY_MIX = {"EASY": 0.3, "MEDIUM": 0.5, "HARD": 0.2}
QUESTION_TYPES = ["MULTIPLE_CHOICE", "TRUE_FALSE", "SHORT_ANSWER", "NUMERIC", "ESSAY"]
MEMORY_TYPES = ["FACT", "GOAL", "PREFERENCE", "PROGRESS"]
#: What an error says that may go away when tried again.
RETRYABLE = ["429", "500", "502", "503", "504", "timeout", "timed out", "temporarily", "connection reset", "overloaded", "rate limit"]


def sequence_ratio(a: Column, b: Column) -> Column:
    """Twice the matching characters over all characters, by longest matching blocks (Ratcliff and Obershelp); a null is empty."""

    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])

    return F.pandas_udf(ratios, "double")(a, b)


#: Characters that similar_sequences counts one by one; any set gives right results, frequent ones exclude more.
COUNTED = "abcdefghijklmnopqrstuvwxyz 0123456789"


def similar_sequences(pairs: DataFrame, least: float) -> DataFrame:
    """pairs(a, b, others) -> those with a sequence ratio of least or more (above 0), with the ratio. Texts are compared whole; a null is empty.

    A match takes a character of both texts, so lengths bound the ratio, and so do the counts of each character. What a bound
    excludes never leaves the JVM; blocks are matched for the rest only.
    """
    a, b = F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))
    known = lambda t: F.array(*[F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in COUNTED])
    counts = lambda t: F.get(F.transform(F.array(known(t)), lambda k: F.array_append(k, F.length(t) - F.aggregate(k, F.lit(0), lambda s, x: s + x))), 0)
    reached = lambda matched: 2 * matched >= least * F.col("__n") - 1e-9
    near = pairs.withColumn("__n", F.length(a) + F.length(b)).where(reached(F.least(F.length(a), F.length(b))))
    both = F.aggregate(F.zip_with(counts(a), counts(b), lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return near.where(reached(both)).withColumn("ratio", sequence_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= least).drop("__n")


def alike_texts(a: str, b: str, least: float) -> bool:
    """Whether the sequence ratio is least or more; its upper bounds first."""
    if 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return False
    m = SequenceMatcher(None, a, b)
    return m.quick_ratio() >= least and m.ratio() >= least


def accepted_candidates(candidates: DataFrame, keys: list[str], most: int, least: float = 0.5, alike: float = 0.86) -> DataFrame:
    """candidates(keys, position, text, confidence, sources array) -> those taken in order: sure enough, with a source, unlike those taken before, up to most.

    A fold over each group in order of position, then text; its state are the texts taken, most at most, so a group of any size needs no more memory. A null text is empty.
    """

    def step(kept, position, text):
        plain = " ".join((text or "").casefold().split())
        if len(kept) >= most or any(alike_texts(plain, k, alike) for k in kept):
            return kept, []
        return [*kept, plain], [(position,)]

    good = candidates.where((F.col("confidence") >= least) & (F.size("sources") > 0)).select(*keys, F.col("position").cast("long").alias("position"), "text")
    return fold_rows(good, keys, ["position", "text"], ["position", "text"], "position long", list, step)


def repaired(text: str | None) -> str | None:
    """A model's JSON as valid JSON, or null: fences cut off, lone backslashes doubled, raw line breaks inside strings escaped, what is open closed."""
    if text is None:
        return None
    body = text.strip()
    if body.startswith("```"):
        body = body.strip("`").removeprefix("json").strip()

    def sound(s: str) -> str | None:
        try:
            return json.dumps(json.loads(s), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return None

    if (found := sound(body)) is not None:
        return found
    out, inside, open_marks, k = [], False, [], 0
    while k < len(body):
        c = body[k]
        if inside and c == "\\":
            follows = body[k + 1 : k + 2]
            known = follows in ('"', "\\", "/", "b", "f", "n", "r", "t") or (follows == "u" and all(x in "0123456789abcdefABCDEF" for x in body[k + 2 : k + 6]) and len(body) >= k + 6)
            out.append(c + follows if known else "\\\\")
            k += 2 if known else 1
            continue
        if c == '"':
            inside = not inside
        elif inside and c in "\n\r\t":
            c = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}[c]
        elif not inside and c in "{[":
            open_marks.append("}" if c == "{" else "]")
        elif not inside and c in "}]" and open_marks:
            open_marks.pop()
        out.append(c)
        k += 1
    return sound("".join(out) + ('"' if inside else "") + "".join(reversed(open_marks)))


def repaired_json(text: Column) -> Column:
    return F.pandas_udf(lambda t: t.map(repaired), "string")(text)


def mix_counts(total: Column, mix: dict[str, float] = DIFFICULTY_MIX) -> Column:
    """Array of (part, n) that adds up to total: shares rounded down, the rest to the largest remainders, the first of equal ones."""
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.floor(total * v + 1e-9).alias("n"), half_up(total * v - F.floor(total * v + 1e-9), 9).alias("rest"), F.lit(i).alias("i")) for i, (k, v) in enumerate(mix.items())])
    order = F.transform(F.array_sort(F.transform(parts, lambda p: F.struct((-p["rest"]).alias("r"), p["i"].alias("i")))), lambda p: p["i"])
    left = total - F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s + p["n"])
    return F.transform(parts, lambda p: F.struct(p["part"].alias("part"), (p["n"] + (F.array_position(order, p["i"]) <= left).cast("long")).cast("long").alias("n")))


def question_errors(q: DataFrame) -> Column:
    """What is wrong with a question(type, difficulty, stem, topic, answer, points, weights array, options array, rationales, sources array, confidence)."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    total = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w)
    choice = F.col("type") == "MULTIPLE_CHOICE"
    rules = [
        (~F.col("type").isin(QUESTION_TYPES) | ~F.col("difficulty").isin(*DIFFICULTY_MIX), "kind"), (blank("stem") | blank("topic") | blank("answer"), "empty"), (F.col("points") <= 0, "points"),
        ((F.size("weights") == 0) | (F.abs(total - F.col("points")) > 0.01), "rubric"), (choice & ((F.size("options") < 2) | ~F.array_contains("options", F.col("answer"))), "options"),
        (choice & (F.col("rationales") != F.size("options") - 1), "rationales"), ((F.size("sources") == 0) | F.exists("sources", lambda s: s < 0), "sources"), (confidence(F.col("confidence")).isNull(), "confidence"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for bad, name in rules]))


def split_valid(rows: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with errors for quarantine)."""
    x = rows.withColumn("errors", errors)
    return x.where(F.size("errors") == 0).drop("errors"), x.where(F.size("errors") > 0)


def passed(awarded: Column, most: Column, share: float = 0.6) -> Column:
    return F.when(most > 0, awarded / most >= share).otherwise(False)


def assembled_notes(sections: DataFrame, key: str) -> DataFrame:
    """sections(key, group, number, title, content, sources array) -> each note's Markdown in order of group and number, and its sources in order of first mention."""
    s = sections.withColumn("index", F.col("group") * 1000 + F.col("number"))
    ordered = F.sort_array(F.collect_list(F.struct("index", "title", "content", "sources")))
    g = s.groupBy(key).agg(ordered.alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n\n"), F.trim(x["content"]))), "\n\n")
    return g.select(key, F.size("s").alias("sections"), text.alias("markdown"), F.array_distinct(F.flatten(F.transform("s", lambda x: x["sources"]))).alias("sources"))


def generation_report(groups: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """groups(key, group, expected), items(key, group, warnings array) -> groups done, items, share covered, and how often each warning came."""
    i = items.groupBy(key, "group").agg(F.count("*").alias("n"), F.flatten(F.collect_list("warnings")).alias("w"))
    j = groups.join(i, [key, "group"], "left")
    g = j.groupBy(key).agg(F.count("*").alias("groups"), F.count_if(F.coalesce("n", F.lit(0)) >= F.col("expected")).alias("done"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"))
    w = items.select(key, F.explode("warnings").alias("w")).groupBy(key, "w").agg(F.count("*").alias("c"))
    w = w.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("w", "c"))), lambda x: F.concat(x["w"], F.lit("="), x["c"].cast("string"))), ",").alias("warnings"))
    return g.join(w, key, "left").select(key, "groups", "done", "items", half_up(F.col("done") / F.col("groups"), 4).alias("coverage"), F.coalesce("warnings", F.lit("")).alias("warnings"))


def requests_resolved(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """requests(id, scope, options), existing(artifact, scope, options, status, version) -> the artifact still in work on the same to reuse (the latest), else the version that a new one gets."""
    same = F.sha2(F.concat_ws("|", "scope", "options"), 256)
    e, r = existing.withColumn("__k", same), requests.withColumn("__k", same)
    running = e.where(F.col("status").isin("GENERATING", "PARTIAL")).groupBy("__k").agg(F.max_by("artifact", F.struct("version", "artifact")).alias("reuse"))
    last = existing.groupBy("scope").agg(F.max("version").alias("v"))
    j = r.join(running, "__k", "left").join(last, "scope", "left")
    return j.select("id", "reuse", F.when(F.col("reuse").isNull(), F.coalesce("v", F.lit(0)) + 1).alias("version"))


def failed_status(status: Column, done: Column) -> Column:
    """What a failed generation becomes: a finished one stays; with something done it is partial."""
    return F.when(status == "READY", status).when(done > 0, "PARTIAL").otherwise("FAILED")


def recalled_memories(queries: DataFrame, memories: DataFrame, latest: int = 3, k: int = 5, least: float = 0.55) -> DataFrame:
    """queries(id, owner, vector), memories(owner, memory, vector, updated) -> an owner's closest memories from least on, or its latest ones where the query has no vector."""
    # a query's id stands for one query, whatever its owners
    q = queries.where("vector IS NOT NULL")
    near = nearest_by_owner(q.select("owner", "id", "vector"), memories.select("owner", "memory", "vector"), ["owner"], k).where(F.col("score") >= least)
    near = top(near.drop("rank"), ["id"], [F.desc("score"), F.col("memory")], k).select("id", "memory", F.col("score").alias("similarity"), "rank")
    last = top(memories, ["owner"], [F.desc("updated"), F.col("memory")], latest)
    return near.unionByName(queries.where("vector IS NULL").select("id", "owner").join(last, "owner").select("id", "memory", F.lit(None).cast("double").alias("similarity"), "rank"))


def memory_errors(c: DataFrame, known: DataFrame, least: float = 0.5) -> DataFrame:
    """c(id, type, content, confidence, message, days), known(message) -> with error (null: none), kept (sound and sure enough) and the days it lives (null: for good)."""
    seen = known.select(F.col("message"), F.lit(True).alias("__known")).distinct()
    # those without a message need no look-up, and would all meet in one task
    j = c.where("message IS NOT NULL").join(seen, "message", "left").unionByName(c.where("message IS NULL").withColumn("__known", F.lit(None).cast("boolean")))
    error = (
        F.when(~F.coalesce(F.col("type").isin(MEMORY_TYPES), F.lit(False)), "type").when(F.coalesce(F.trim("content") == "", F.lit(True)), "content").when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence")
        .when(F.col("message").isNotNull() & F.col("__known").isNull(), "message")
    )
    return j.select("id", error.alias("error"), (error.isNull() & (F.col("confidence") >= least)).alias("kept"), F.when(F.col("days") > 0, F.col("days")).alias("days"))


def preference_values(rows: DataFrame, rules: DataFrame, most: int = 200) -> DataFrame:
    """rows(id, key, value), rules(key, allowed array or null) -> with the accepted value (capitals where values are listed) or what is wrong."""
    j = rows.join(F.broadcast(rules.withColumn("__r", F.lit(True))), "key", "left")  # a table of setting names
    v = F.trim("value")
    error = F.when(F.col("__r").isNull(), "unknown").when(F.coalesce(v == "", F.lit(True)), "empty").when(F.length(v) > most, "long").when(F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.upper(v)), "value")
    return j.select("id", F.when(error.isNull(), F.when(F.col("allowed").isNotNull(), F.upper(v)).otherwise(v)).alias("value"), error.alias("error"))


def note_sections(rows: DataFrame) -> DataFrame:
    """rows(group, number, kind, sources array, warnings array) -> kind from the known ones, index, warnings each once in order."""
    kind = F.upper(F.regexp_replace(F.trim("kind"), "[^A-Za-z]+", "_"))
    known = kind.isin("CONCEPT", "EXAMPLE", "FORMULA", "SUMMARY", "EXERCISE")
    return rows.withColumns({"kind": F.when(known, kind).otherwise("CONCEPT"), "index": F.col("group") * 1000 + F.col("number"), "warnings": F.array_distinct("warnings")})


def requested_counts(rows: DataFrame) -> DataFrame:
    """rows(id, easy, medium, hard as text, types array) -> counts, their total, known question types and what is wrong."""
    n = {c: F.col(c).try_cast("long") for c in ("easy", "medium", "hard")}
    bad = F.greatest(*[F.col(c).isNotNull() & (v.isNull() | (v < 0)) for c, v in n.items()])
    total = sum((F.coalesce(v, F.lit(0)) for v in n.values()), F.lit(0).cast("long"))
    types = F.array_intersect(F.array_distinct(F.transform("types", lambda t: F.upper(F.trim(t)))), F.array(*map(F.lit, QUESTION_TYPES)))
    return rows.select("id", *[F.coalesce(v, F.lit(0)).alias(c) for c, v in n.items()], total.alias("total"), types.alias("types"), F.when(bad, "count").when(total <= 0, "none").when(F.size(types) == 0, "types").alias("error"))


def to_grade(answers: DataFrame, grades: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """answers(keys, free, awarded), grades(keys, points, at) -> (free answers without a grade yet, answers after: the first grade of an ungraded answer counts)."""
    waiting = answers.where(F.col("free") & F.col("awarded").isNull())
    first = grades.groupBy(*keys).agg(F.min_by("points", "at").alias("__p"))
    after = answers.join(first, keys, "left").withColumn("awarded", F.coalesce("awarded", F.when(F.col("free"), F.col("__p")))).drop("__p")
    return waiting, after


def scopes(requests: DataFrame, documents: DataFrame, chunks: DataFrame, most_documents: int = 8, most_chunks: int = 200) -> DataFrame:
    """requests(id, docs array, chunk_ids array), documents(doc_id, ready, title), chunks(chunk_id, doc_id) -> whether all documents are ready and all chunks theirs, and a title of the first three."""
    d = requests.select("id", F.posexplode(F.array_distinct("docs")).alias("p", "doc_id")).join(documents.where("ready").select("doc_id", "title"), "doc_id")
    g = d.groupBy("id").agg(F.count("*").alias("found"), F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("p", "title"))), 1, 3), lambda x: x["title"]), ", ").alias("title"))
    c = requests.select("id", "docs", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id")).join(chunks, "chunk_id").where(F.array_contains("docs", F.col("doc_id"))).groupBy("id").agg(F.count("*").alias("mine"))
    j = requests.join(g, "id", "left").join(c, "id", "left")
    n, m = F.size(F.array_distinct("docs")), F.size(F.array_distinct("chunk_ids"))
    return j.select("id", (n.between(1, most_documents) & (F.coalesce("found", F.lit(0)) == n) & (m <= most_chunks) & (F.coalesce("mine", F.lit(0)) == m)).alias("valid"), F.coalesce("title", F.lit("")).alias("title"))


def saved_answers(answers: DataFrame, changes: DataFrame, questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """answers(attempt, question, given, awarded), changes(attempt, question, given, at), questions(quiz, question), attempts(attempt, quiz) -> answers after: the last change counts, is not graded, and must be to a question of the attempt's quiz."""
    mine = changes.join(attempts, "attempt").join(questions, ["quiz", "question"], "left_semi")
    last = mine.groupBy("attempt", "question").agg(F.max_by("given", "at").alias("given")).withColumn("awarded", F.lit(None).cast("double"))
    return answers.join(last, ["attempt", "question"], "left_anti").select("attempt", "question", "given", "awarded").unionByName(last)


def sendable(messages: DataFrame, documents: DataFrame, most: int = 20000) -> DataFrame:
    """messages(id, text, docs array), documents(doc_id): whether a message has 1 to most characters and all its documents are known."""
    d = messages.select("id", F.explode(F.array_distinct("docs")).alias("doc_id")).join(documents, "doc_id", "left_semi").groupBy("id").agg(F.count("*").alias("known"))
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    j = messages.join(d, "id", "left")
    title = F.when(n > 40, F.concat(F.substring(collapse(F.col("text")), 1, 40), F.lit("…"))).otherwise(collapse(F.col("text")))
    return j.select("id", (n.between(1, most) & (F.coalesce("known", F.lit(0)) == F.size(F.array_distinct("docs")))).alias("valid"), title.alias("title"))


def conversation_states(events: DataFrame) -> DataFrame:
    """events(conv, at, kind, value, sources array) -> each conversation's last status and sources (sorted, each once) and when it changed."""
    g = events.groupBy("conv").agg(F.max_by(F.when(F.col("kind") == "status", F.col("value")), F.when(F.col("kind") == "status", F.col("at"))).alias("status"), F.max_by("sources", F.when(F.col("kind") == "sources", F.col("at"))).alias("s"), F.max("at").alias("changed"))
    return g.select("conv", F.coalesce("status", F.lit("ACTIVE")).alias("status"), F.array_sort(F.array_distinct(F.coalesce("s", F.array().cast("array<bigint>")))).alias("sources"), "changed")


def superseded(memories: DataFrame, changes: DataFrame, touched: DataFrame) -> DataFrame:
    """memories(memory, status, used), changes(memory), touched(memory, at): active memories that are replaced become so, and what was read carries its last time."""
    t = touched.groupBy("memory").agg(F.max("at").alias("__t"))
    c = changes.select("memory").distinct().withColumn("__c", F.lit(True))
    j = memories.join(c, "memory", "left").join(t, "memory", "left")
    return j.select("memory", F.when(F.col("__c") & (F.col("status") == "ACTIVE"), "SUPERSEDED").otherwise(F.col("status")).alias("status"), F.greatest("used", "__t").alias("used"))


def compression_step(marked: DataFrame, summaries: DataFrame) -> DataFrame:
    """marked(conv_id, turn, state) of water_marks, summaries(conv_id, version, through) -> summaries after: what was evicted beyond the last one makes the next version, through its last turn."""
    out = marked.where("state = 'evicted'").join(summaries, "conv_id", "left").where(F.col("turn") > F.coalesce("through", F.lit(-1)))
    g = out.groupBy("conv_id").agg(F.max("turn").alias("__to"), F.count("*").alias("evicted"))
    j = summaries.join(g, "conv_id", "full")
    return j.select("conv_id", (F.coalesce("version", F.lit(0)) + F.col("__to").isNotNull().cast("int")).alias("version"), F.coalesce("__to", "through").alias("through"), F.coalesce("evicted", F.lit(0)).alias("evicted"))


def vector_text(v: Column) -> Column:
    """A vector of floats as text in brackets, six digits each; a half goes to the even digit, as C has it (Java's format rounds it up).

    A float times a million is exact as a double, so only true halves count as such.
    """
    six = lambda x: F.format_string("%.6f", F.rint(x.cast("double") * 1e6) / 1e6)
    return F.concat(F.lit("["), F.array_join(F.transform(v, six), ","), F.lit("]"))


def parsed_vector(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def task_states(tasks: DataFrame, events: DataFrame, most: int = 500) -> DataFrame:
    """tasks(task), events(task, at, kind, message) -> each task's state from its latest event, with progress and a shortened message."""
    last = events.groupBy("task").agg(F.max_by(F.struct("kind", "message"), "at").alias("e"), F.max("at").alias("updated"))
    kind = F.col("e.kind")
    status = F.when(kind == "start", "PROCESSING").when(kind == "done", "COMPLETED").when(kind == "error", "FAILED").otherwise("PENDING")
    return tasks.join(last, "task", "left").select("task", status.alias("status"), F.when(kind == "done", 100).when(kind == "start", 10).otherwise(0).alias("progress"), F.when(kind == "error", F.substring("e.message", 1, most)).alias("message"), "updated")


def trace_steps(steps: DataFrame, most: int = 60) -> DataFrame:
    """steps(run, step, tool, observation): steps of a run in order as JSON, observations clipped."""
    text = F.col("observation")
    clipped = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)
    one = F.struct("step", "tool", clipped.alias("observation"))
    return steps.groupBy("run").agg(F.count("*").alias("steps"), F.to_json(F.sort_array(F.collect_list(one))).alias("trace"))


def retry_plan(errors: DataFrame, most: int = 4, first: float = 1.0, longest: float = 30.0) -> DataFrame:
    """errors(id, message, attempt) -> whether it is worth another try, and after how many seconds (doubled each time)."""
    low = F.lower(F.coalesce("message", F.lit("")))
    again = F.greatest(*[low.contains(m) for m in RETRYABLE]) & (F.col("attempt") < most)
    return errors.select("id", again.alias("again"), F.when(again, F.least(F.lit(longest), first * F.pow(F.lit(2.0), F.col("attempt") - 1))).alias("seconds"))


def source_text(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """chunks(keys, index, title, page, content) -> one text with a tagged entry for each chunk, in order."""
    entry = F.concat(F.lit("[source "), F.col("index").cast("string"), F.lit(" | "), F.coalesce("title", F.lit("untitled")), F.lit(" | page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("]\n"), F.trim("content"))
    return chunks.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", entry.alias("e")))), lambda x: x["e"]), "\n\n").alias("text"))


def chosen_actions(plans: DataFrame) -> DataFrame:
    """plans(id, tasks array, candidates array, recommended) -> numbered tasks and whether the recommended action was a candidate."""
    numbered = F.transform("tasks", lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t))
    return plans.select("id", F.array_join(numbered, "\n").alias("tasks"), F.coalesce(F.array_contains("candidates", F.col("recommended")), F.lit(False)).alias("valid"))


def retried(artifacts: DataFrame, wanted: DataFrame) -> DataFrame:
    """artifacts(artifact, status, scope as JSON), wanted(artifact): what may be generated again, with its stored documents and count."""
    a = artifacts.join(wanted.select("artifact").distinct(), "artifact", "left_semi").where(F.col("status").isin("PARTIAL", "FAILED"))
    return a.select("artifact", F.from_json("scope", "docs array<bigint>, n int").alias("s")).select("artifact", "s.docs", "s.n")


def jumps(nodes: DataFrame) -> list[DataFrame]:
    """nodes(node, parent) of a forest -> tables (at, to) of jumps by 1, 2, 4 ... levels up, as far as any node can jump; each written."""
    found = [settle(nodes.where("parent IS NOT NULL").select(F.col("node").alias("at"), F.col("parent").alias("to")))]
    while not found[-1].isEmpty():
        if len(found) > 62:
            raise ValueError("parents form a cycle")
        last = found[-1]
        found.append(settle(last.select("at", F.col("to").alias("mid")).join(last.select(F.col("at").alias("mid"), "to"), "mid").select("at", "to")))
    return found[:-1]


def moves_checked(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """nodes(node, parent), moves(node, target) -> whether each move is allowed: not into itself or its own subtree.

    Jumps of 2^k levels give the depth of both ends; the target is lifted by the difference, bit by bit, and must not have come to the
    node. So a tree of any depth d takes about 3 log d joins. Parents form a forest; a node without a row has no parent.
    """
    found = jumps(nodes)
    wanted = settle(moves.select("node", "target").where("node IS NOT NULL AND target IS NOT NULL").distinct())
    depths = wanted.select(F.col("node").alias("of")).unionByName(wanted.select(F.col("target").alias("of"))).distinct().select("of", F.col("of").alias("at"), F.lit(0).cast("long").alias("depth"))
    for k, table in reversed(list(enumerate(found))):
        met = depths.join(table, "at", "left")
        depths = settle(met.select("of", F.coalesce("to", "at").alias("at"), (F.col("depth") + F.when(F.col("to").isNotNull(), 1 << k).otherwise(0)).alias("depth")))
    depth = lambda c: depths.select(F.col("of").alias(c), F.col("depth").alias(f"__{c}"))
    at = wanted.join(depth("node"), "node").join(depth("target"), "target").where("__target >= __node").select("node", "target", F.col("target").alias("at"), (F.col("__target") - F.col("__node")).alias("left"))
    for k, table in enumerate(found):
        bit = F.col("left").bitwiseAND(F.lit(1 << k).cast("long")) != 0
        at = settle(at.where(~bit).unionByName(at.where(bit).join(table, "at").select("node", "target", F.col("to").alias("at"), "left")))
    bad = at.where("at = node").select("node", "target", F.lit(True).alias("__bad"))
    return moves.join(bad, ["node", "target"], "left").select("node", "target", F.col("__bad").isNull().alias("allowed"))


def unfiled(notes: DataFrame, deleted: DataFrame) -> DataFrame:
    """notes(note, folder), deleted(node): notes of deleted folders stay, without a folder."""
    d = deleted.select(F.col("node").alias("folder"), F.lit(True).alias("__d")).distinct()
    return notes.join(d, "folder", "left").select("note", F.when(F.col("__d").isNull(), F.col("folder")).alias("folder"))


def missing_or_due(cards: DataFrame, states: DataFrame, now: str) -> DataFrame:
    """cards(card), states(card, status, due): cards never reviewed, or due and not put aside; new ones first, then by due date."""
    at = F.to_timestamp(F.lit(now))
    j = cards.join(states, "card", "left").where(F.col("due").isNull() | ((F.col("due") <= at) & (F.coalesce("status", F.lit("NEW")) != "SUSPENDED")))
    return j.select("card", "due")


def claimed(tasks: DataFrame, running: DataFrame, priorities: list[int], most: int) -> DataFrame:
    """tasks(task_id, priority, position) in order of round_robin, running(task_id): the next tasks of the allowed priorities to take, as many as there is room for beside those running."""
    free = tasks.where(F.col("priority").isin(priorities)).join(running.select("task_id"), "task_id", "left_anti")
    used = running.select("task_id").distinct().agg(F.count("*").alias("u"))
    return free.orderBy("position", "task_id").limit(most).crossJoin(F.broadcast(used)).withColumn("__n", F.row_number().over(Window.partitionBy("u").orderBy("position", "task_id"))).where(F.col("__n") <= most - F.col("u")).select("task_id", "priority", "position")


def resumed_waiters(waiters: DataFrame, finished: DataFrame) -> DataFrame:
    """waiters(run, task), finished(task, status): runs all of whose tasks have ended, with how many of them failed."""
    j = waiters.dropDuplicates(["run", "task"]).join(finished.dropDuplicates(["task"]), "task", "left")
    g = j.groupBy("run").agg(F.bool_and(F.col("status").isNotNull()).alias("ended"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    return g.where("ended").select("run", "failed")


def abbreviated(title: Column, most: int = 60, default: str = "New conversation") -> Column:
    t = collapse(F.coalesce(title, F.lit("")))
    return F.when(t == "", default).when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def edited_section(text: Column, heading: str, body: Column, expected: Column) -> Column:
    """A Markdown text with the part under a heading replaced, up to the next heading of its rank or above; unchanged if the text's digest isn't the expected one or there is no such heading."""
    rank = len(heading) - len(heading.lstrip("#"))
    lined = F.concat(F.lit("\n"), text, F.lit("\n"))
    start = F.locate("\n" + heading + "\n", lined)
    rest = F.substring(lined, start + len(heading) + 2, F.length(lined))
    stop = F.regexp_instr(F.concat(F.lit("\n"), rest), F.lit(f"\n#{{1,{rank}}} "))
    tail = F.when(stop > 0, F.substring(rest, stop, F.length(rest))).otherwise("")
    head = F.substring(text, F.lit(1), F.greatest(start - 1, F.lit(0)))
    made = F.concat(head, F.lit(heading + "\n"), body, F.lit("\n"), tail)
    return F.when((F.sha2(text, 256) == expected) & (start > 0), F.regexp_replace(made, "\n+$", "")).otherwise(text)


def expanded(queries: DataFrame, expander: Callable[[str], str | None]) -> DataFrame:
    """queries(query_id, query) -> with the answer that a model supposes and its error; a failing model leaves the answer empty and never fails the query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers, errors = [], []
            for q in pdf["query"]:
                try:
                    answers.append(expander(q or "") or None)
                    errors.append(None)
                except Exception as e:  # whatever the model's client raises
                    answers.append(None)
                    errors.append(str(e)[:200])
            yield pd.DataFrame({"query_id": pdf["query_id"], "supposed": answers, "error": errors})

    return queries.select("query_id", "query").mapInPandas(run, f"query_id {dict(queries.dtypes)['query_id']}, supposed string, error string")


def expiry(states: DataFrame, now: str, days: int = 30, least: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """states(id, confidence, last, active) -> (states after, log) of one scheduled run: unsure ones without activity for max(30, days) days are put to rest."""
    gone = F.coalesce(F.col("active") & (F.col("confidence") < least) & (F.col("last") < F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(max(30, days)))), F.lit(False))
    return states.withColumn("active", F.col("active") & ~gone), states.where(gone).select("id", F.lit("expired").alias("reason"), F.col("confidence").alias("before"))
