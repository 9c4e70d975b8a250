"""Folds over each key's rows in order, for rules whose next state needs the last one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import collapse


def fold_rows(rows: DataFrame, keys: list[str], order: list, values: list[str], schema: str, start: Callable, step: Callable, finish: Callable | None = None) -> DataFrame:
    """Feeds every key's values in order to step(state, *values) -> (state, rows out); finish(state) -> rows out at a key's end.

    Rows are shuffled by key and sorted within partitions, which spills; tasks then read Arrow batches and carry one state from row to row.
    So a key with very many rows needs time in one task, but no memory beyond its state. Null keys are a key of their own.
    """
    spec = StructType([rows.schema[k] for k in keys] + StructType.fromDDL(schema).fields)
    arrow, nk = to_arrow_schema(spec), len(keys)

    def run(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for row in zip(*batch.to_pydict().values()):
                if key is None or row[:nk] != key:
                    if key is not None and finish:
                        out += [key + r for r in finish(state)]
                    key, state = row[:nk], start()
                state, made = step(state, *row[nk:])
                out += [key + r for r in made]
            yield pack(out)
        if key is not None and finish:
            yield pack([key + r for r in finish(state)])

    def pack(out):
        cols = zip(*out) if out else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.select(*keys, *values).mapInArrow(run, spec)


def source_groups(chunks: DataFrame, keys: list[str], order: str, target: int, most: int, section: str | None = None) -> DataFrame:
    """chunks(keys, order, tokens[, section]) -> (keys, order, group_index): consecutive chunks are packed until target; a group
    with more than one chunk has no more than most tokens, a longer chunk has one of its own, and a new section starts a new group."""

    def step(state, at, tokens, title):
        number, size, last = state
        if size is not None and ((section and title != last) or size + tokens > most):
            number, size = number + 1, None
        size = (size or 0) + tokens
        made = [(at, number)]
        return ((number + 1, None, title) if size >= target else (number, size, title)), made

    title = F.trim(F.coalesce(F.col(section), F.lit(""))) if section else F.lit("")
    c = chunks.select(*keys, F.col(order).cast("long").alias(order), F.coalesce("tokens", F.lit(0)).cast("long").alias("__t"), title.alias("__s"))
    return fold_rows(c, keys, [order], [order, "__t", "__s"], f"`{order}` long, group_index long", lambda: (0, None, None), step)


#: Tokens from which a changed section ends a chunk, from which a new page does, and that a chunk may have at most; pages a chunk may span;
#: tokens and blocks that are repeated in the next chunk, and from how many tokens code and formulas are not.
CHUNK = {"least": 80, "target": 450, "most": 800, "span": 3, "overlap": 80, "tail": 2, "solid": 120}


def chunk_members(blocks: DataFrame, rule: dict = CHUNK) -> DataFrame:
    """blocks(doc_id, position, page, section, kind, tokens) -> (doc_id, chunk, position): which blocks each chunk has, repeated ones included.

    State is a few sums of the open chunk and its last repeatable blocks, never its blocks. A chunk that ended for its size or for a new
    page hands its last blocks on: the last one alone if it has enough tokens, else the last two.
    """
    def ended(size, low, high, at, title, page, section, tokens) -> str | None:
        """Why the open chunk can't take the next block."""
        if size + tokens > rule["most"]:
            return "size"
        if size >= rule["target"] and page != at:
            return "page"
        if max(page, high) - min(page, low) >= rule["span"]:
            return "span"
        return "section" if section and title and section != title and size >= rule["least"] else None

    def step(state, position, page, section, kind, tokens):
        number, now, last = state
        if now is None and tokens > rule["most"]:
            return (number + 1, None, []), [(number, position)]
        size, low, high = now[:3] if now else (0, page, page)
        made = []
        if now and (why := ended(*now, page, section, tokens)):
            number += 1
            last = [] if why in ("span", "section") else last[-1:] if last and last[-1][2] >= rule["overlap"] else last
            made = [(number, r[0]) for r in last]
            size, low, high = sum(r[2] for r in last), min((r[1] for r in last), default=page), max((r[1] for r in last), default=page)
        if kind not in ("CODE", "FORMULA") or tokens <= rule["solid"]:
            last = [*last, (position, page, tokens)][-rule["tail"] :]
        return (number, (size + tokens, min(low, page), max(high, page), page, section), last), [*made, (number, position)]

    b = blocks.select("doc_id", F.col("position").cast("long").alias("position"), F.col("page").cast("long").alias("page"), "section", "kind", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    return fold_rows(b, ["doc_id"], ["position"], ["position", "page", "section", "kind", "tokens"], "chunk long, position long", lambda: (0, None, []), step)


def native_chunks(blocks: DataFrame, rule: dict = CHUNK) -> DataFrame:
    """blocks(doc_id, position, page, section, kind, tokens, text) -> (doc_id, chunk, first, last, blocks, tokens, page_start, page_end, section, kind, content).

    Of a document's chunks of equal content (white space apart) the first stays. kind is the most frequent one but headings, the first met if several are.
    """
    rows = chunk_members(blocks, rule).join(blocks, ["doc_id", "position"])
    kinds = rows.where("kind <> 'HEADING'").groupBy("doc_id", "chunk", "kind").agg(F.count("*").alias("n"), F.min("position").alias("p"))
    main = kinds.groupBy("doc_id", "chunk").agg(F.max_by("kind", F.struct("n", -F.col("p"))).alias("kind"))
    title = F.when(F.col("section") != "", F.struct("position", "section"))
    c = rows.groupBy("doc_id", "chunk").agg(
        F.min("position").alias("first"), F.max("position").alias("last"), F.count("*").alias("blocks"), F.sum("tokens").alias("tokens"), F.min("page").alias("page_start"), F.max("page").alias("page_end"),
        F.min(title)["section"].alias("section"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n\n").alias("content"),
    )
    once = c.withColumn("__d", F.sha2(collapse(F.col("content")), 256)).withColumn("__r", F.row_number().over(Window.partitionBy("doc_id", "__d").orderBy("chunk"))).where("__r = 1").drop("__r", "__d")
    out = once.join(main, ["doc_id", "chunk"], "left").withColumn("kind", F.coalesce("kind", F.lit("HEADING")))
    return out.withColumn("chunk", (F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk")) - 1).cast("long"))


def within_budget(items: DataFrame, keys: list[str], tokens: Column, count: int, budget: int) -> DataFrame:
    """items(keys, rank) -> those taken in order of rank, up to count: an item that would pass the budget is left out and the next one tried; the first is always taken."""

    def step(state, rank, size):
        n, total = state
        if n >= count or (n and total + size > budget):
            return state, []
        return (n + 1, total + size), [(rank, n, size)]

    i = items.select(*keys, F.col("rank").cast("long").alias("rank"), tokens.cast("long").alias("__t"))
    return fold_rows(i, keys, ["rank"], ["rank", "__t"], "rank long, position long, tokens long", lambda: (0, 0), step)


def greedy_distinct(texts: DataFrame, group: str, least: float = 0.88) -> DataFrame:
    """texts(group, position, text, tokens array) -> those kept: each goes against the ones kept before it in its group, by Jaccard similarity of token sets."""

    def step(kept, position, words):
        w = frozenset(words or ())
        for k in kept:
            if w == k or (min(len(w), len(k)) >= least * max(len(w), len(k)) and len(w & k) >= least * len(w | k)):
                return kept, []
        kept.append(w)
        return kept, [(position,)]

    t = texts.select(group, F.col("position").cast("long").alias("position"), "tokens")
    return fold_rows(t, [group], ["position"], ["position", "tokens"], "position long", list, step)


STATE = "version long, mastery double, confidence double, evidence double, attempts long, correct_streak long, wrong_streak long, trend double, stability double, calibration double, needs_review boolean, review_days long"


def topic_step(s: tuple | None, delta: float, weight: float, signal: float, days: int, attempt: bool, right: bool, flagged: bool) -> tuple:
    """A topic's state, as STATE, after one more event; None before the first. The numbers are fixed values."""
    clip = lambda x: max(0.0, min(1.0, x))
    ok, bad = attempt and right, attempt and not right
    gain = max(1.0, weight * 2)
    if s is None:
        m = clip(0.5 + delta)
        return (1, m, max(0.0, min(1.0, weight * 0.08) - (0.02 if attempt else 0.0)), weight, int(attempt), int(ok), int(bad), signal,
                min(365.0, 1 + gain) if ok else 1.0, 0.1 if attempt else 0.0, flagged or m < 0.7, days)
    n, m0, conf, ev, tries, oks, bads, trend, stable, cal, _, _ = s
    miss = abs(m0 - (1 if ok else 0)) if attempt else 0.0
    m = clip(m0 + delta)
    grown = min(365.0, stable + gain)
    return (n + 1, m, clip(conf + weight * 0.08 - miss * 0.04), ev + weight, tries + int(attempt), oks + 1 if ok else 0 if bad else oks, bads + 1 if bad else 0 if ok else bads,
            trend * 0.7 + signal * 0.3, max(1.0, stable * 0.55) if bad else grown if ok else stable, cal * 0.8 + miss * 0.2 if attempt else cal,
            m < 0.7 or bad, -int(-grown // 1) if ok else days)


def topic_history(events: DataFrame, keys: list[str]) -> DataFrame:
    """events from learning.updates -> the state of each key after each of its events, in order of time and id: event_id and STATE."""

    def step(s, event, *values):
        s = topic_step(s, *values)
        return s, [(s[0], event, *s[1:])]

    cols = ["event_id", "delta", "weight", "signal", "days", "attempt", "right", "flagged"]
    return fold_rows(events, keys, ["ts", "event_id"], cols, STATE.replace("version long", "version long, event_id long"), lambda: None, step)


def estimate(text: str) -> int:
    """As functions.text.tokens_retrieval, for texts cut within a fold."""
    return max(-(-len(text) // 4), -(-len(text.split()) * 13 // 10)) if text.strip() else 0


def shortened(text: str, budget: int) -> str:
    """The text if it fits, else cut at white space and shortened by tenths until it does."""
    if estimate(text) <= budget:
        return text
    size = 4 * budget
    while size > 0:
        cut = text[:size]
        space = max(cut.rfind(c) for c in " \n\t")
        cut = (cut[:space] if space > 0 and not text[size : size + 1].isspace() else cut).rstrip()
        if estimate(cut) <= budget:
            return cut
        size = int(size * 0.9)
    return ""


def context_items(candidates: DataFrame, keys: list[str], count: int = 8, budget: int = 6000, each: int = 1400) -> DataFrame:
    """candidates(keys, rank, sources array, content) -> cited items in order until count or budget is reached.

    An item whose first source is in an earlier item is left out; contents are cut to what is left of the budget.
    """

    def step(state, rank, sources, content):
        n, total, used = state
        if n >= count or total >= budget or (sources and sources[0] in used):
            return state, []
        text = shortened(content or "", min(each, budget - total))
        if not text.strip():
            return state, []
        used.update(sources or ())
        size = estimate(text)
        return (n + 1, total + size, used), [(rank, f"S{n + 1}", text, size, len(text) < len(content))]

    c = candidates.select(*keys, F.col("rank").cast("long").alias("rank"), F.transform("sources", lambda x: x.cast("string")).alias("sources"), "content")
    return fold_rows(c, keys, ["rank"], ["rank", "sources", "content"], "rank long, citation string, content string, tokens long, truncated boolean", lambda: (0, 0, set()), step)


#: Coordinates that bound a similarity before all of them are multiplied.
HEAD = 16


class Memories:
    """The active memories of one owner and type, in the order in which they came, with unit vectors in growing arrays."""

    def __init__(self):
        self.ids, self.confidence, self.size = [], [], None
        self.by_digest: dict = {}
        self.live = np.zeros(64, bool)
        self.full = self.tail = None

    def add(self, key, digest, vector, confidence) -> None:
        at = len(self.ids)
        self.ids.append(key)
        self.confidence.append(confidence)
        if digest is not None:
            self.by_digest.setdefault(digest, []).append(at)
        if at == len(self.live):
            self.live = np.concatenate([self.live, np.zeros(at, bool)])
        self.live[at] = True
        unit = self.unit(vector)
        if unit is None:
            return
        if self.full is None:
            self.size, self.full, self.tail = len(unit), np.zeros((64, len(unit))), np.zeros(64)
        while at >= len(self.full):
            self.full, self.tail = np.concatenate([self.full, np.zeros_like(self.full)]), np.concatenate([self.tail, np.zeros_like(self.tail)])
        if len(unit) == self.size:
            self.full[at], self.tail[at] = unit, np.linalg.norm(unit[HEAD:])

    @staticmethod
    def unit(vector):
        v = np.asarray(vector if vector is not None else [], float)
        norm = np.linalg.norm(v) if len(v) else 0.0
        return v / norm if norm > 0 else None

    def equal(self, digest) -> int | None:
        """The first live memory of a digest."""
        return next((at for at in self.by_digest.get(digest, []) if self.live[at]), None) if digest is not None else None

    def closest(self, vector, least: float) -> tuple[int, float] | None:
        """The first of the most similar live memories, if its cosine, rounded to six digits, is least or more.

        The product of the first coordinates and of the norms of the rest bounds a cosine; only memories whose bound reaches least are met.
        """
        unit = self.unit(vector)
        if unit is None or self.full is None or len(unit) != self.size:
            return None
        n = min(len(self.ids), len(self.full))
        bound = self.full[:n, :HEAD] @ unit[:HEAD] + self.tail[:n] * np.linalg.norm(unit[HEAD:])
        near = np.flatnonzero(self.live[:n] & (bound >= least - 1e-6))
        if not len(near):
            return None
        cos = np.round(self.full[near] @ unit, 6)
        best = int(np.argmax(cos))
        return (int(near[best]), float(cos[best])) if cos[best] >= least else None


def consolidated(candidates: DataFrame, memories: DataFrame, keys: list[str], same: float = 0.90, update: float = 0.78) -> DataFrame:
    """candidates(keys, place, id, digest, vector, confidence), memories(keys, id, digest, vector, confidence) -> (keys, id, decision, memory, similarity), candidate by candidate.

    keys are owner and type. Each candidate meets what the ones before it left: ADD appends it, UPDATE takes the closest memory out and
    appends it, SKIP leaves all as it is. An equal digest skips; else a cosine of `same` or more updates if the candidate is surer and skips
    if not, one of `update` or more updates. Memories come by id, candidates by place and id; null vectors and digests meet nothing,
    and memory and similarity are null for ADD. A task reads one key's rows in order; its state is the key's live memories.
    """

    def step(state, fresh, key, digest, vector, confidence):
        if not fresh:
            state.add(key, digest, vector, confidence)
            return state, []
        at = state.equal(digest)
        if at is not None:
            return state, [(key, "SKIP", state.ids[at], 1.0)]
        hit = state.closest(vector, update)
        decision = "ADD" if hit is None else "SKIP" if hit[1] >= same and not confidence > state.confidence[hit[0]] else "UPDATE"
        if decision != "SKIP":
            if hit:
                state.live[hit[0]] = False
            state.add(key, digest, vector, confidence)
        return state, [(key, decision, state.ids[hit[0]] if hit else None, hit[1] if hit else None)]

    kind = dict(candidates.dtypes)["id"]
    rest = ["id", "digest", "vector", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence")]
    old = memories.select(*keys, F.lit(False).alias("__fresh"), F.lit(0).cast("long").alias("__place"), *rest)
    new = candidates.select(*keys, F.lit(True).alias("__fresh"), F.col("place").cast("long").alias("__place"), *rest)
    return fold_rows(old.unionByName(new), keys, ["__fresh", "__place", "id"], ["__fresh", "id", "digest", "vector", "confidence"], f"id {kind}, decision string, memory {kind}, similarity double", Memories, step)
