"""Quality rules: text statistics and robust multivariate outliers, with DataFrame functions only.

Each text becomes five statistics; each group of language and source gets a minimum-covariance-determinant
estimate of their location and scatter, drawn towards its language's and that towards the whole table's by one formula at
every size; a text is rejected whose Mahalanobis distance is too large. Only statistics are kept between passes, never
texts. A concentration step is one aggregation by (group, bin of distance), and then one over a group's bins, so what
meets in one task is bounded by the number of bins, whatever share of the rows one group holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let, sent_to_all, settle, words_of

FEATURES = ("x1", "x2", "x3", "x4", "x5")
#: Standard deviations that are added to each statistic's own: differences of this size are no sign of junk.
FLOORS = (1.5, 0.06, 0.5, 0.7, 0.15)
KEEP_SHARE = 0.75
#: Makes the scatter of the inner 75 % of a five-dimensional normal cloud that of the whole: 0.75 / P(chi2(7) <= quantile of chi2(5)).
CONSISTENCY = 1.41
#: Squared distance; chi2(5) exceeds it once in 100,000 texts.
CUTOFF = 30.86
#: An estimate from n texts counts n / (n + SHRINK), the next wider one the rest.
SHRINK = 50.0
STEPS = 4
BINS_PER_DOUBLING = 32
PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LOCATION, SCATTER, ROOT = [f"m{i}" for i in range(len(FEATURES))], [f"v{i}{j}" for i, j in PAIRS], [f"l{i}{j}" for i, j in PAIRS]


def _repeated(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the text (windows compared by 64-bit hash)."""

    def covered(w: Column) -> Column:
        n = F.size(w) - 2
        hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

        def starts(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            hit = F.filter(F.sequence(F.lit(0), n - 1), lambda k: same(k, k - 1) | same(k, k + 1))
            return F.sort_array(F.transform(hit, lambda k: F.get(s, k)["i"]))

        total = lambda p: F.aggregate(
            p,
            F.struct(F.lit(0).alias("c"), F.lit(0).alias("end")),
            lambda acc, i: F.struct((acc["c"] + i + 3 - F.greatest(i, acc["end"])).alias("c"), (i + 3).alias("end")),
        )["c"]
        return F.when(n < 2, F.lit(0)).otherwise(let(let(F.sort_array(hashes), starts), total))

    return let(words, covered).cast("long")


#: All columns that this module adds while it works are in one struct of this name.
WORK = "__studyloom_quality"


def statistics(docs: DataFrame) -> DataFrame:
    """docs with a struct WORK: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, x1 to x5, and the groups lang and source.

    A null text counts as empty: all zero, and so failed. Columns of docs may have any names.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counts = F.struct(
        F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(words_of(F.col("text"))).alias("n_repeat_words"),
    )

    def whole(s: Column) -> Column:
        n = F.greatest(s["n_words"], F.lit(1))
        vector = [F.log1p(s["n_words"].cast("double")), F.log(F.greatest(s["word_chars"] / n, F.lit(1.0))), F.log1p(100.0 * s["n_symbols"] / n), F.log1p(100.0 * s["n_dup_lines"] / n), s["n_repeat_words"] / n]
        failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
        return F.struct(*[s[c].alias(c) for c in COUNTS], failed.alias("failed"), *[x.alias(f) for x, f in zip(vector, FEATURES)], F.to_json(F.struct("lang")).alias("lang"), F.to_json(F.struct("lang", "source")).alias("group"))

    return docs.withColumn(WORK, let(counts, whole))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("c"), *[F.sum(x).alias(f"s_{x}") for x in FEATURES],
        *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}{j}") for i, j in PAIRS],
    )


def _factor(m: DataFrame) -> DataFrame:
    """Location m0..m4 and scatter v00..v44 -> the same with the Cholesky factor l00..l44 of the scatter (with floors) and its log determinant."""
    for i, j in PAIRS:
        left = F.col(f"v{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        m = m.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(f"l{j}{j}"))
    return m.withColumn("det", sum((F.log(F.col(f"l{i}{i}")) for i in range(1, len(FEATURES))), F.log("l00")))


def _estimate(m: DataFrame, factor: float) -> DataFrame:
    """Moments by (g, start) -> location, scatter times factor, its factor and determinant."""
    c = F.col("c")
    m = m.select("g", "start", "c", *[(F.col(f"s_{x}") / c).alias(f"m{i}") for i, x in enumerate(FEATURES)], *[F.col(f"q{i}{j}") for i, j in PAIRS])
    m = m.withColumns({f"v{i}{j}": factor * F.when(c > 1, F.col(f"q{i}{j}") / c - F.col(f"m{i}") * F.col(f"m{j}")).otherwise(0.0) for i, j in PAIRS})
    return _factor(m).select("g", "start", "det", *LOCATION, *SCATTER, *ROOT)


def _distance(x=F.col, m=F.col) -> Column:
    z: list[Column] = []
    for i, f in enumerate(FEATURES):
        left = x(f) - m(f"m{i}")
        for k in range(i):
            left = left - m(f"l{i}{k}") * z[k]
        z.append(left / m(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def concentrate(rows: DataFrame) -> DataFrame:
    """rows(g, x1..x5) -> (g, size, m0..m4, v00..v44): a minimum-covariance-determinant estimate of every g."""
    # two deterministic starts: all texts of the group, and its medians with spreads from quartiles
    moments = settle(_moments(rows, ["g"]))
    whole = _estimate(moments.withColumn("start", F.lit(0)), 1.0)
    quart = rows.groupBy("g").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in FEATURES])
    spread = lambda i: F.pow((F.col(FEATURES[i])[2] - F.col(FEATURES[i])[0]) / 1.349, 2)
    quart = quart.select("g", F.lit(1).alias("start"), *[F.col(x)[1].alias(f"m{i}") for i, x in enumerate(FEATURES)], *[(spread(i) if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in PAIRS])
    best = settle(whole.unionByName(_factor(quart).select("g", "start", "det", *LOCATION, *SCATTER, *ROOT)))
    names = ["c", *[f"s_{x}" for x in FEATURES], *[f"q{i}{j}" for i, j in PAIRS]]
    for _ in range(STEPS):
        at = rows.join(sent_to_all(best), "g").withColumn("bin", F.floor(BINS_PER_DOUBLING * F.log2(_distance() + 1e-3)))
        # a row for each bin first, dealt by bin: only these few rows of a group then meet
        bins = settle(_moments(at, ["g", "start", "bin"]))
        w = Window.partitionBy("g", "start")
        kept = bins.withColumn("before", F.sum("c").over(w.orderBy("bin")) - F.col("c")).withColumn("all", F.sum("c").over(w)).where(F.col("before") < KEEP_SHARE * F.col("all"))
        best = settle(_estimate(kept.groupBy("g", "start").agg(*[F.sum(x).alias(x) for x in names]), CONSISTENCY))
    chosen = best.groupBy("g").agg(F.min_by(F.struct(*LOCATION, *SCATTER), F.struct("det", "start")).alias("b")).select("g", "b.*")
    return chosen.join(moments.select("g", F.col("c").alias("size")), "g")


def fit(stats: DataFrame) -> DataFrame:
    """stats(lang, group, failed, x1..x5), as in WORK -> (lang, group, m0..m4, l00..l44) of the groups with texts that pass the base rules.

    Every group, every language and the whole table have an estimate of their own; a group's is then
    (n own + SHRINK wider) / (n + SHRINK), in location and scatter, where wider is its language's, mixed likewise with the table's.
    A null language or source is a value of its own; repeated rows count each; without rows that pass the result is empty.
    """
    good = stats.where("NOT failed")
    rows = settle(good.select(F.explode(F.array(F.lit(""), "lang", "group")).alias("g"), *FEATURES))
    est = settle(concentrate(rows))
    groups = settle(good.select("lang", "group").distinct())
    named = lambda p: est.select(*[F.col(c).alias(f"{p}_{c}") for c in est.columns])
    j = groups.join(named("own"), F.col("group") == F.col("own_g")).join(named("lang"), F.col("lang") == F.col("lang_g")).crossJoin(F.broadcast(named("all").where("all_g = ''").limit(1)))
    mixed = lambda n, a, b: (F.col(n) * a + SHRINK * b) / (F.col(n) + SHRINK)
    both = [(c, mixed("own_size", F.col(f"own_{c}"), mixed("lang_size", F.col(f"lang_{c}"), F.col(f"all_{c}")))) for c in (*LOCATION, *SCATTER)]
    return settle(_factor(j.select("lang", "group", *[x.alias(c) for c, x in both])).select("lang", "group", *LOCATION, *ROOT))


def judge(stats: DataFrame, fitted: DataFrame) -> DataFrame:
    """stats (of statistics()) with the struct extended by distance (squared; null where no estimate exists) and kept."""
    work = F.col(WORK)
    model = sent_to_all(fitted).select(F.col("group").alias(f"{WORK}_group"), F.struct(*LOCATION, *ROOT).alias(f"{WORK}_model"))
    far = _distance(lambda f: work[f], lambda f: F.col(f"{WORK}_model")[f])
    # null-safe, so that no filter on the key is pushed under the statistics, which would then be worked out twice
    out = stats.join(model, work["group"].eqNullSafe(F.col(f"{WORK}_group")), "left").withColumn(WORK, work.withField("distance", far))
    return out.withColumn(WORK, work.withField("kept", F.coalesce(~work["failed"] & (work["distance"] <= CUTOFF), F.lit(False)))).drop(f"{WORK}_group", f"{WORK}_model")


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, source) -> one row for each: doc_id, the base counts, base_failed, distance, kept.

    Null text: empty. A null language or source is a group of its own. Repeated rows count as often as they
    occur. An empty table gives an empty result. Other columns are ignored.
    """
    stats = settle(statistics(docs.select("doc_id", "text", "lang", "source")).select("doc_id", WORK))
    work = F.col(WORK)
    return judge(stats, fit(stats.select(f"{WORK}.*"))).select("doc_id", *[work[c].alias(c) for c in COUNTS], work["failed"].alias("base_failed"), work["distance"].alias("distance"), work["kept"].alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with docs' own columns; texts are read twice and never shuffled."""
    stats = statistics(docs)
    fitted = fit(settle(stats.select(f"{WORK}.*")))
    return judge(stats, fitted).where(F.col(WORK)["kept"]).select(*docs.columns)
