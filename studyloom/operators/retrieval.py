"""Hybrid retrieval: recall channels, rank fusion, deduplication, reranking, context, evidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import collapse, exact_signal, half_up, preview, tokens, tokens_retrieval

#: How much a channel's rank counts, and the rank offset of reciprocal rank fusion.
CHANNEL_WEIGHTS = {"vector": 1.0, "lexical": 1.0, "exact": 1.2}
RRF_OFFSET = 60
#: Least channel scores, and length of an evidence text.
LEAST = {"exact": 0.25, "lexical": 0.01, "vector": 0.48}
LEAST_TEXT = 20
#: Phrases of pages without content, words that say nothing of a query, and words that are no search terms.
BLANK_PAGES = ["completely blank", "no visible text", "no discernible content", "image region is blank", "the page is blank"]
VAGUE = ["explain", "help", "this", "that", "it", "thing", "topic", "concept", "什么意思", "是什么", "解释", "这个", "怎么", "为什么"]
STOP_WORDS = "a an and are as at be by can do does explain for from how in is it of on or the to what when where which why with".split()
#: What counts as an exact signal in a query, with the group that holds it.
SIGNALS = [
    ('["\u201c\u201d]([^"\u201c\u201d]{2,120})["\u201c\u201d]', 1), (r"\b\d+(?:\.\d+){1,4}\b", 0), (r"\b(?:[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+|[A-Za-z]{2,}\d+[A-Za-z0-9_]*)\b", 0),
    (r"\b[A-Za-z]+\[[^\]\n]{1,80}\](?:\^\d+)?", 0), (r"\b[OΘΩ]\([^\)\n]{1,80}\)", 0), (r"\\[A-Za-z]{2,}(?:\{[^\}\n]{1,80}\})?", 0),
]
#: Words that don't count when a query's words are looked for in a candidate.
RERANK_STOP_WORDS = "a an and are as at be by for from how in is it of on or that the to what when where which why with".split()
#: Vectors of a query set that meet all rows at once; larger sets go in blocks.
QUERY_BLOCK = 2000
#: Queries whose scores a task holds at a time.
QUERY_TILE = 32


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank; a row limit by group lets Spark drop rows before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def _query_blocks(queries: DataFrame, size: int) -> list[DataFrame]:
    """A query set in blocks of about so many rows; each block meets all rows at once, so what a task gets is bounded."""
    blocks = max(1, -(-queries.count() // size))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]


def vector_recall(queries: DataFrame, vectors: DataFrame, k: int = 30) -> DataFrame:
    """queries(query_id, query), vectors(id, vector) -> (query_id, id, score, rank): exact nearest neighbours by cosine.

    The query set goes to the vectors block by block as a matrix of unit rows; a task multiplies batches of vectors with it
    and passes on its best k a query. Vectors of another length or without length score 0. If vectors are binary, they are 16-bit floats
    (vector_index.packed), and queries are rounded to such too: both sides at half precision, multiplied at full.
    """
    out, halves = None, dict(vectors.dtypes)["vector"] == "binary"
    for part in _query_blocks(queries.where("query IS NOT NULL"), QUERY_BLOCK):
        rows = part.select("query_id", "query").collect()  # at most about QUERY_BLOCK
        if not rows:
            continue

        def score(batches, rows=rows):
            ids = np.array([r.query_id for r in rows])
            size = max(len(r.query) for r in rows)
            fits = np.array([len(r.query) == size for r in rows])
            q = np.array([r.query if len(r.query) == size else [0.0] * size for r in rows], float)
            if halves:
                q = np.clip(np.nan_to_num(q), -65504, 65504).astype(np.float16).astype(float)
            norm = np.linalg.norm(q, axis=1, keepdims=True)
            q = np.divide(q, norm, out=np.zeros_like(q), where=norm > 0)
            best = {}
            for pdf in batches:
                if halves:
                    pdf = pdf.assign(vector=pdf["vector"].map(lambda v: np.frombuffer(v, np.float16)))
                good = pdf["vector"].map(lambda v: v is not None and len(v) == size).to_numpy(bool)
                v = np.zeros((len(pdf), size))
                if good.any():
                    v[good] = np.stack(pdf["vector"][good].to_numpy())
                n = np.linalg.norm(v, axis=1, keepdims=True)
                unit = np.divide(v, n, out=np.zeros_like(v), where=n > 0).T
                for lo in range(0, len(ids), QUERY_TILE):  # a batch's scores are held for one tile of queries at a time
                    s = np.round(q[lo : lo + QUERY_TILE] @ unit, 6)
                    s[~fits[lo : lo + QUERY_TILE]] = 0.0
                    key = np.broadcast_to(pdf["id"].to_numpy(), s.shape)
                    if lo in best:
                        s, key = np.hstack([best[lo][0], s]), np.hstack([best[lo][1], key])
                    order = np.lexsort((key, -s))[:, :k]
                    best[lo] = np.take_along_axis(s, order, 1), np.take_along_axis(key, order, 1)
            for lo, (s, key) in best.items():
                yield pd.DataFrame({"query_id": np.repeat(ids[lo : lo + QUERY_TILE], s.shape[1]), "id": key.ravel(), "score": s.ravel() + 0.0})

        kinds = dict(part.dtypes) | {"id": dict(vectors.dtypes)["id"]}
        found = vectors.where("vector IS NOT NULL").select("id", "vector").mapInPandas(score, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
        best = top(found, ["query_id"], [F.desc("score"), F.col("id")], k)
        out = best if out is None else out.unionByName(best)
    return out if out is not None else top(queries.select("query_id", F.lit(None).cast(dict(vectors.dtypes)["id"]).alias("id"), F.lit(0.0).alias("score")).limit(0), ["query_id"], [F.col("id")], k)


#: Queries and rows of one owner that a task compares at a time, and queries whose scores it holds at once.
OWNER_QUERIES, OWNER_ROWS, OWNER_TILE = 4096, 16_384, 64


def _nearest(keys: list[str], kept: list[str], k: int):
    """From a block of queries and one of rows, both of one owner: each query's k best rows."""

    def matrix(vectors: pd.Series, size: int) -> np.ndarray:
        m = np.zeros((len(vectors), size))
        fits = vectors.map(lambda v: v is not None and len(v) == size).to_numpy(bool)
        if fits.any():
            m[fits] = np.stack(vectors[fits].to_numpy())
        return m

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=[*keys, "id", *kept, "score"], dtype=object)
        if not len(queries) or not len(rows):
            return empty
        rows = rows.sort_values("memory", kind="stable", ignore_index=True)
        found = []
        lengths = queries["vector"].map(lambda v: 0 if v is None else len(v))
        for size in lengths.unique():
            mine = queries[lengths == size]
            q, v = matrix(mine["vector"], int(size)), matrix(rows["vector"], int(size))
            nq, nv = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
            for lo in range(0, len(q), OWNER_TILE):
                norm = nq[lo : lo + OWNER_TILE, None] * nv
                dot = q[lo : lo + OWNER_TILE] @ v.T
                s = np.round(np.divide(dot, norm, out=np.zeros_like(dot), where=~(norm <= 0)), 6) + 0.0
                s[np.isnan(s)] = np.inf  # as Spark orders them
                worst = np.partition(s, -k, axis=1)[:, -k, None] if s.shape[1] > k else np.full((len(s), 1), -np.inf)
                r, c = np.nonzero(s >= worst)
                order = np.lexsort((c, -s[r, c], r))  # rows stand by memory
                r, c = r[order], c[order]
                first = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, c = r[first], c[first]
                found.append(pd.concat([mine[["id"]].iloc[lo + r].reset_index(drop=True), rows[kept].iloc[c].reset_index(drop=True), pd.DataFrame({"score": s[r, c]})], axis=1))
        return pd.concat(found, ignore_index=True).assign(**{key: queries[key].iloc[0] for key in keys})[empty.columns.tolist()]

    return run


def nearest_by_owner(queries: DataFrame, memories: DataFrame, keys: list[str], k: int) -> DataFrame:
    """queries(keys, id, vector), memories(keys, memory, vector[, more]) -> (keys, id, memory[, more], score, rank): the k closest memories of a query's owner by cosine, of equal ones the smaller memory.

    All pairs of an owner are compared, so work is quadratic in an owner's rows: both sides go in blocks to a grid for each owner, a task multiplies
    one block of queries with one of memories and passes on the best k a query. Vectors that are null, have a null in them, or have another length or none score 0.
    """
    whole = F.when(~F.exists("vector", lambda x: x.isNull()), F.col("vector")).alias("vector")
    kept = [c for c in memories.columns if c not in (*keys, "vector")]
    blocks = lambda df, size, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    grid = blocks(memories, OWNER_ROWS, "__ms").join(blocks(queries, OWNER_QUERIES, "__qs"), keys)
    cell = lambda df, by, n, other: df.join(grid, keys).withColumn(n, F.pmod(F.xxhash64(by), F.col(f"{n}s")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
    own = [F.col(c).alias(c) for c in (*keys, "__q", "__m")]  # both sides come from the grid, and a cogroup tells them apart by column
    q = cell(queries.select(*keys, "id", whole), "id", "__q", "__m").select(*own, "id", "vector")
    m = cell(memories.select(*keys, *kept, whole), "memory", "__m", "__q").select(*own, *kept, "vector")
    kinds = dict(queries.dtypes) | {c: t for c, t in memories.dtypes if c in kept}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "id", *kept)) + ", score double"
    found = q.groupBy(*keys, "__q", "__m").cogroup(m.groupBy(*keys, "__q", "__m")).applyInPandas(_nearest(keys, kept, k), schema)
    best = top(found, [*keys, "id"], [F.desc("score"), F.col("memory")], k)
    return best.withColumn("score", F.when(F.col("score") == float("inf"), float("nan")).otherwise(F.col("score")))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def exact_recall(signals: DataFrame, texts: DataFrame, k: int = 15) -> DataFrame:
    """signals(query_id, signal), texts(id, title, text): 2 points for a signal in the title, else 1.5 in the normalised text.

    Normalising keeps what is contained, so a signal in the text itself is in the normalised one too. Signals go to the texts in blocks of
    a bounded number, as two automata that find all of a block's signals in one pass over a title or text. An empty signal is in every one.
    """
    n = signals.groupBy("query_id").agg(F.count("*").alias("n"))
    t = texts.select("id", "title", F.lower("text").alias("__lower"))
    kinds = dict(signals.dtypes) | dict(texts.dtypes)
    schema = StructType([StructField("query_id", signals.schema["query_id"].dataType), StructField("id", texts.schema["id"].dataType), StructField("points", DoubleType())])
    arrow, hits = to_arrow_schema(schema), None
    for part in _query_blocks(signals.where("signal IS NOT NULL").select("query_id", "signal", exact_signal(F.col("signal")).alias("norm")), QUERY_BLOCK):
        rows = [tuple(r) for r in part.collect()]  # at most about QUERY_BLOCK
        found = t.mapInArrow(lambda batches, rows=rows: _signal_hits(batches, rows, arrow), schema) if rows else None
        hits = found if hits is None else hits.unionByName(found) if found is not None else hits
    if hits is None:
        hits = n.select("query_id", F.lit(None).cast(kinds["id"]).alias("id"), F.lit(0.0).alias("points")).limit(0)
    scored = hits.groupBy("query_id", "id").agg(F.sum("points").alias("points")).join(n, "query_id").select("query_id", "id", F.round(F.least(F.lit(1.0), F.col("points") / (2 * F.col("n"))), 6).alias("score"))
    return top(scored, ["query_id"], [F.desc("score"), F.col("id")], k)


def _automaton(patterns: list[str]):
    """Finds which of the patterns a string has, as a set of their numbers; one pass, whatever their number."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for k, p in enumerate(patterns):
        places.setdefault(p, []).append(k)
    always = places.pop("", [])
    machine = ahocorasick.Automaton()
    for p, numbers in places.items():
        machine.add_word(p, numbers)
    machine.make_automaton()

    def found(text: str | None) -> set[int]:
        if text is None:
            return set()
        return {*always, *(k for numbers in {id(v): v for _, v in machine.iter(text)}.values() for k in numbers)} if places else {*always}

    return found


#: Texts that a task holds as strings at a time.
TEXT_TILE = 256
#: What functions.text.exact_signal makes of a text in lower case, as bytes, of which other characters have none of these.
BRACKETS, WHITE = bytes.maketrans(b"[]{}", b"()()"), b" \t\n\x0b\f\r"


def _signal_hits(batches, rows, schema):
    """(query_id, id, points) of each text (id, title, text in lower case) of the Arrow batches that has any of the signals rows (query_id, signal, norm)."""
    in_title, in_text = _automaton([r[1] for r in rows]), _automaton([r[2] for r in rows])
    for batch in batches:
        for lo in range(0, batch.num_rows, TEXT_TILE):
            out = []
            keys, titles, texts = batch.slice(lo, TEXT_TILE).columns
            for key, title, text in zip(keys.to_pylist(), titles.to_pylist(), texts.cast(pa.binary()).to_pylist()):
                norm = text if text is None else text.translate(BRACKETS, WHITE).decode()
                named, points = in_title(title), {}
                for k in named | in_text(norm):
                    points[rows[k][0]] = points.get(rows[k][0], 0.0) + (2.0 if k in named else 1.5)
                out += [(q, key, p) for q, p in points.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def fuse(candidates: DataFrame) -> DataFrame:
    """candidates(query_id, channel, id, score, rank) -> weighted reciprocal rank fusion, scaled to the query's best."""
    weight = F.coalesce(*[F.when(F.col("channel") == c, w) for c, w in CHANNEL_WEIGHTS.items()])
    g = candidates.groupBy("query_id", "id").agg(F.sum(weight / (RRF_OFFSET + F.col("rank"))).alias("raw"), F.max("score").alias("evidence"), F.count("*").alias("channels"))
    scaled = g.withColumn("fused", F.round(F.col("raw") / F.max("raw").over(Window.partitionBy("query_id")), 6)).drop("raw")
    return scaled.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), F.desc("evidence"), F.col("id"))))


def quality_filter(candidates: DataFrame) -> DataFrame:
    """Rows with one sufficient channel score (columns exact, lexical, vector; null is none) and a long enough text that does not say that its page is blank."""
    good = [F.coalesce(F.col(c) >= v, F.lit(False)) for c, v in LEAST.items()]
    text = collapse(F.col("text"))
    blank = F.greatest(*[F.lower(text).contains(p) for p in BLANK_PAGES])
    return candidates.where((good[0] | good[1] | good[2]) & (F.length(text) >= LEAST_TEXT) & ~blank)


def rerank(candidates: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """candidates(query_id, id, fused, channels), queries(query_id, query), texts(id, title, text): blends fused score and term coverage; keeps the first two and what either supports.

    Titles and texts are cut into words once each, only for texts that are candidates, however many queries name them.
    """
    telling = lambda c: F.array_distinct(F.filter(tokens(F.col(c)), lambda w: (F.length(w) > 1) & ~w.isin(RERANK_STOP_WORDS)))
    q = queries.select("query_id", telling("query").alias("__q"))
    named = texts.join(candidates.select("id").distinct(), "id", "left_semi").select("id", telling("title").alias("__t"), telling("text").alias("__x"))
    share = lambda c: F.when(F.size("__q") > 0, F.size(F.array_intersect("__q", c)) / F.size("__q")).otherwise(0.0)
    out = candidates.join(named, "id").join(q, "query_id").withColumn("coverage", half_up(0.65 * share("__t") + 0.35 * share("__x"), 6)).drop("__t", "__x", "__q")
    out = out.withColumn("combined", half_up(0.75 * F.col("fused") + 0.25 * F.col("coverage"), 6))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("combined"), F.col("id"))))
    return out.where((F.col("rank") <= 2) | (F.col("channels") > 1) | (F.col("fused") >= 0.45) | (F.col("coverage") >= 0.2))


def near_pairs(texts: DataFrame, group: str, least: int = 88) -> DataFrame:
    """texts(group, position, text) -> pairs of one group whose token sets have a Jaccard similarity of least percent or more.

    Sets meet only through a shared token among their longest ones (prefix filter by length, then by the word; any order that all sets share is exact, and long words are rare, with nothing counted or shuffled for it), so groups are never crossed; positions and
    sizes ride through that join, and sets are fetched for the pairs that are left.
    """
    t = texts.select(group, "position", F.array_distinct(tokens(F.col("text"))).alias("s")).where(F.size("s") > 0)
    n = F.size("s")
    first = F.slice(F.array_sort(F.transform("s", lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), 1, (n - F.ceil(n * least / 100) + 1).cast("int"))
    heads = t.select(group, "position", n.alias("n"), F.explode(first).alias("h")).select(group, "position", "n", F.col("h.w").alias("w"))
    side = lambda p, m: heads.select(group, "w", F.col("position").alias(p), F.col("n").alias(m))
    close = (F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= least * F.greatest("na", "nb"))
    met = side("a", "na").join(side("b", "nb"), [group, "w"]).where(close).select(group, "a", "b").distinct()
    sets = lambda p: t.select(group, F.col("position").alias(p), F.col("s").alias(f"s{p}"))
    pairs = met.join(sets("a"), [group, "a"]).join(sets("b"), [group, "b"])
    both, every = F.size(F.array_intersect("sa", "sb")), F.size(F.array_union("sa", "sb"))
    return pairs.where(100 * both >= least * every).select(group, "a", "b", F.round(both / every, 6).alias("similarity"))


def grade(items: DataFrame) -> DataFrame:
    """items(query_id, rank, score, is_document) -> evidence grade of each query."""
    g = items.groupBy("query_id").agg(F.min_by("score", "rank").alias("first"), F.bool_or("is_document").alias("doc"), F.count("*").alias("n"))
    level = F.when((F.col("first") >= 0.6) & (F.col("doc") | (F.col("n") >= 2)), "SUFFICIENT").when(F.col("first") >= 0.52, "WEAK").otherwise("INSUFFICIENT")
    return g.select("query_id", level.alias("grade"), F.col("n").alias("items"))


def neighbours(chunks: DataFrame) -> DataFrame:
    """chunks(doc_id, chunk_index, content) -> with the contents before and after it, where the index is adjacent."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    near = lambda f, d: F.when(f("chunk_index").over(w) == F.col("chunk_index") + d, f("content").over(w))
    return chunks.withColumn("context", F.concat_ws("\n\n", near(F.lag, -1), F.col("content"), near(F.lead, 1)))


def section_neighbours(chunks: DataFrame, most: int = 1400) -> DataFrame:
    """chunks(doc_id, chunk_index, content, section, page) -> as neighbours, but only of the same named section, at most a page away (or of unknown page),
    and as long as the sum of their tokens fits: first the chunk before, then the one after. Titles such as "chunk 3" name no section."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    name = F.lower(collapse(F.coalesce("section", F.lit(""))))
    c = chunks.withColumn("__s", F.when(~name.rlike("^(chunk [0-9]+)?$"), name)).withColumn("__t", tokens_retrieval(F.col("content")))

    def near(f, d):
        gap = F.abs(f("page").over(w) - F.col("page"))
        return F.coalesce((f("chunk_index").over(w) == F.col("chunk_index") + d) & (f("__s").over(w) == F.col("__s")) & F.coalesce(gap <= 1, F.lit(True)), F.lit(False))

    c = c.withColumns({"__b": near(F.lag, -1), "__a": near(F.lead, 1), "__tb": F.lag("__t").over(w), "__ta": F.lead("__t").over(w), "__cb": F.lag("content").over(w), "__ca": F.lead("content").over(w)})
    c = c.withColumn("__b", F.col("__b") & (F.col("__t") + F.col("__tb") <= most))
    c = c.withColumn("__a", F.col("__a") & (F.col("__t") + F.when(F.col("__b"), F.col("__tb")).otherwise(0) + F.col("__ta") <= most))
    out = c.withColumn("context", F.concat_ws("\n\n", F.when(F.col("__b"), F.col("__cb")), F.col("content"), F.when(F.col("__a"), F.col("__ca"))))
    return out.select(*chunks.columns, "context")


def band_join(chunks: DataFrame, hits: DataFrame, width: int) -> DataFrame:
    """Chunks whose index is within width of a hit's; positions are spelt out, so the join is on equal keys."""
    spots = hits.select("doc_id", F.explode(F.sequence(F.col("chunk_index") - width, F.col("chunk_index") + width)).alias("chunk_index")).distinct()
    return chunks.join(spots, ["doc_id", "chunk_index"])


def query_signals(query: Column) -> Column:
    """Exact signals of a query, each once: quoted phrases, dotted numbers, identifiers, bracket and complexity expressions, commands."""
    found = F.concat(*[F.regexp_extract_all(query, F.lit(p), F.lit(g)) for p, g in SIGNALS])
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x) >= 2))


def query_terms(query: Column) -> Column:
    """Search terms of a query, each once: lower-case words of two characters or more but for stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS)))


def needs_expansion(query: Column, most: int = 8) -> Column:
    """Whether a query is too short or too vague to search by its meaning alone."""
    q = F.trim(F.lower(query))
    n = F.size(F.split(q, r"\s+"))
    telling = F.size(F.filter(F.split(q, r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) > 1) & ~w.isin(VAGUE)))
    return F.when(F.length(q) == 0, False).otherwise((n <= 3) | (F.length(q) <= 18) | ((n <= most) & (telling <= 2)))


def in_scope(rows: DataFrame, documents: DataFrame | None, notes: DataFrame | None) -> DataFrame:
    """rows(domain, doc_id, status, version) -> ready rows of the chosen documents, and of the chosen notes those of the latest ready version (None: no such rows)."""
    ready = rows.where("status = 'READY'")
    out = rows.limit(0)
    if documents is not None:
        out = ready.where("domain = 'PDF'").join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    if notes is not None:
        mine = ready.where("domain = 'AI_NOTE'").join(notes.select("doc_id").distinct(), "doc_id", "left_semi")
        last = mine.groupBy("doc_id").agg(F.max("version").alias("version"))
        out = out.unionByName(mine.join(last, ["doc_id", "version"], "left_semi"))
    return out


def best_of_source(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each source object: the one with the highest score."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "score").alias("__s")).select(*keys, "__s.*")


def with_contents(candidates: DataFrame, chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """candidates(type, id, metadata) -> content from the chunk, else the note section, else the metadata's text, else empty."""
    c = chunks.select(F.lit("DOCUMENT_CHUNK").alias("type"), "id", F.col("content").alias("__c"))
    s = sections.select(F.lit("AI_NOTE_SECTION").alias("type"), "id", F.col("content").alias("__s"))
    j = candidates.join(c, ["type", "id"], "left").join(s, ["type", "id"], "left")
    return j.withColumn("content", F.coalesce("__c", "__s", F.get_json_object("metadata", "$.text"), F.lit(""))).drop("__c", "__s")


def merge_hypothetical(hits: DataFrame, supposed: DataFrame, k: int = 30, factor: float = 0.9) -> DataFrame:
    """Hits of a query and of its supposed answer, the latter at nine tenths of their score; each row with its better score."""
    both = hits.select("query_id", "id", "score").unionByName(supposed.select("query_id", "id", (F.col("score") * factor).alias("score")))
    best = both.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top(best.withColumn("score", half_up(F.col("score"), 6)), ["query_id"], [F.desc("score"), F.col("id")], k)


def ensure_domain(ranked: DataFrame, keys: list[str], wanted: Column, limit: int) -> DataFrame:
    """ranked(keys, rank): where no wanted row is among the first limit, the first later one moves up to place min(limit, 4); the rest keep their order."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    first = F.min(F.when(wanted, F.col("rank"))).over(w)
    goal = F.least(F.greatest(F.lit(0), F.lit(limit - 1)), F.least(F.lit(3), n)) + 1
    moved = F.when((first <= limit) | first.isNull() | (first < goal), F.col("rank")).when(F.col("rank") == first, goal)
    return ranked.withColumn("rank", moved.when((F.col("rank") >= goal) & (F.col("rank") < first), F.col("rank") + 1).otherwise(F.col("rank")).cast("int"))


def apply_scores(ranked: DataFrame, scores: DataFrame, keys: list[str], first: int = 12) -> DataFrame:
    """ranked(keys, id, rank), scores(keys, id, model_score): the first rows by model score, those without one after them in their old order, then all others."""
    j = ranked.join(scores, [*keys, "id"], "left").withColumn("model_score", F.when(F.col("rank") <= first, F.col("model_score")))
    w = Window.partitionBy(*keys).orderBy(F.when(F.col("rank") <= first, 0).otherwise(1), F.col("model_score").desc_nulls_last(), "rank")
    return j.withColumn("rank", F.row_number().over(w))


def evidence_search(queries: DataFrame, vectors: DataFrame, owner: str, scope: list, k: int = 32) -> DataFrame:
    """As vector_recall, among the vectors of the owners in scope; an empty scope is no restriction."""
    return vector_recall(queries, vectors.where(F.col(owner).isin(scope)) if scope else vectors, k)


def diagnostics(channels: dict[str, DataFrame]) -> DataFrame:
    """channel -> its hits (query_id, id): of each query with hits, how many each channel has, how many different ones there are, and whether a channel has none."""
    every = None
    for name, hits in channels.items():
        part = hits.select("query_id", "id", F.lit(name).alias("channel"))
        every = part if every is None else every.unionByName(part)
    once = every.groupBy("query_id", "id").agg(*[F.count_if(F.col("channel") == c).alias(c) for c in channels])
    g = once.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in channels], F.count("*").alias("different"))
    return g.withColumn("partial", F.least(*[F.col(c) for c in channels]) == 0)
