"""Personal data: fixed base rules, and boosted trees over candidate spans. DataFrame functions only.

Every span is found inside its row: marks are put around all matches of a pattern, the text is split at the marks,
and a fold over the pieces gives positions in code points. Nothing is exploded, joined or shuffled; the
trees are trained by MLlib on a small generated table and scored as a column expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "mail_words", "number")
#: A span has no other than these features: format first, then context.
FEATURES = ("length", "digits", "letters", "upper", "others", "changes", "hex", "luhn", "ssn", "local_phone", "proposer", "secret_word", "contact_word", "assigned", "quoted", "joined")
TRAINING_ROWS = 4000
PRECISION = 0.99
LEAD = 24
#: Words before a span that tell of a secret or of a way to reach a person.
SECRET_WORDS = "(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|auth)"
CONTACT_WORDS = "(?i)(phone|tel\\b|tel[.:]|call|mobile|cell|fax|contact|ssn|social security|mail)"


#: Spans are gathered in arrays of this many, and these in one array, so that a text with very many spans isn't copied for each.
GATHERED = 256


def _found(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost matches of pattern, in code points."""
    some = "array<struct<start:int,end:int,value:string>>"

    def fold(pieces: Column) -> Column:
        empty = F.struct(F.length(F.get(pieces, 0)).alias("at"), F.array().cast(some).alias("last"), F.array().cast(f"array<{some}>").alias("full"))

        def step(acc: Column, piece: Column) -> Column:
            value = F.substring_index(piece, "\x02", 1)
            span = F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(value)).alias("end"), value.alias("value")))
            fits = F.size(acc["last"]) < GATHERED
            return F.struct(
                (acc["at"] + F.length(piece) - 1).alias("at"), F.when(fits, F.concat(acc["last"], span)).otherwise(span).alias("last"),
                F.when(fits, acc["full"]).otherwise(F.concat(acc["full"], F.array(acc["last"]))).alias("full"),
            )

        done = F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), empty, step)
        return let(done, lambda d: F.flatten(F.concat(d["full"], F.array(d["last"]))))

    return let(F.split(F.regexp_replace(text, pattern, "\x01$0\x02"), "\x01"), fold)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + worth(i))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def base_spans(text: Column) -> dict[str, Column]:
    """text must not hold the control characters that clean() takes out.

    Repeated groups become one character class, by giving separators inside a number or domain a character of
    their own first; so a long run needs no deep recursion in the matcher, and every search is linear.
    """
    dotted = F.regexp_replace(text, "(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])", "\x06")
    joined = F.regexp_replace(text, "(?<=[0-9])[\\x20-](?=[0-9])", "\x04")
    local = "[A-Za-z0-9._%+\\x06-]"
    email = _found(dotted, f"(?:\\G|(?<!{local})){local}++@[A-Za-z0-9-]++\\x06[A-Za-z0-9\\x06-]*+")
    ip = _found(text, "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++")
    card = _found(joined, "[0-9][0-9\\x04]*+")
    phone = _found(text, "\\+[0-9][\\x20().0-9-]+[0-9]")
    small = lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False))
    checked = {
        "email": (email, lambda s: F.lit(True)),
        "ip": (ip, lambda s: F.forall(F.split(s["value"], "\\."), small)),
        "card": (card, lambda s: let(_digits(s["value"]), _luhn)),
        "phone": (phone, lambda s: F.length(_digits(s["value"])).between(9, 15)),
    }
    return {k: F.filter(found, ok) for k, (found, ok) in checked.items()}


def clean(text: Column) -> Column:
    """A null as empty; control characters used as marks become another one, which is in no pattern."""
    return F.translate(F.coalesce(text, F.lit("")), "\x01\x02\x04\x06", "\x07\x07\x07\x07")


def _described(text: Column, kind: int, spans: Column) -> Column:
    def one(s: Column) -> Column:
        v = s["value"]
        before = F.substring(text, F.greatest(s["start"] - LEAD + 1, F.lit(1)), F.least(s["start"], F.lit(LEAD)))
        after = F.substring(text, s["end"] + 1, F.lit(1))
        flag = lambda c: c.cast("double")
        count = lambda cls: F.length(F.regexp_replace(v, f"[^{cls}]+", "")).cast("double")
        values = [
            F.length(v).cast("double"), count("0-9"), count("A-Za-z"), count("A-Z"), F.length(F.regexp_replace(v, "[A-Za-z0-9]+", "")).cast("double"),
            (F.size(F.split(v, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")) - 1).cast("double"),
            flag(~v.rlike("[^0-9A-Fa-f]")), flag(let(_digits(v), _luhn)), flag(v.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
            flag(v.rlike("^[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}$")), F.lit(float(kind)),
            flag(before.rlike(SECRET_WORDS)), flag(before.rlike(CONTACT_WORDS)), flag(before.rlike("[=:]\\s?[\"']?$")), flag(before.rlike("[\"']$")), flag(after.rlike("[A-Za-z0-9]")),
        ]
        return F.struct(F.lit(ADDED[kind]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.struct(*[x.alias(n) for x, n in zip(values, FEATURES)]).alias("f"))

    return F.transform(spans, one)


def candidates(text: Column) -> Column:
    """High-recall generators: long mixed tokens, spelt-out addresses, grouped numbers. Their spans may overlap base ones."""
    token = F.filter(_found(text, "(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+"), lambda s: s["value"].rlike("[0-9]"))
    words = _found(text, "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:[(\\[] ?at ?[)\\]]|@) ?[A-Za-z0-9-]++(?: ?(?:[(\\[] ?dot ?[)\\]]|\\.) ?[A-Za-z0-9-]++){1,4}+")
    words = F.filter(words, lambda s: s["value"].rlike("(?i)[(\\[] ?(at|dot) ?[)\\]]"))
    number = _found(text, "(?<![0-9A-Za-z+(.-])[(]?[0-9][0-9 ().-]{5,22}[0-9](?![0-9A-Za-z])")
    return F.concat(*[_described(text, k, s) for k, s in enumerate((token, words, number))])


def _training(spark: SparkSession) -> DataFrame:
    """Generated lines with one planted span each (true start, end; label), by templates over hashes of the row number."""
    i = F.col("id")
    hexa = F.sha2(i.cast("string"), 256)
    num = F.translate(hexa, "abcdef", "012345")
    word = lambda k: F.translate(F.substring(F.sha2(F.concat_ws("w", i, F.lit(k)), 256), 1, 3 + k % 7), "0123456789", "ghijklmnop")
    cut = lambda a, n: F.substring(num, a, n)
    pick = lambda *v: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in v]), (F.pmod(F.xxhash64(i, F.lit(5)), F.lit(len(v)))).cast("int"))
    mixed = F.substring(F.base64(F.unhex(hexa)), 1, 36)
    phone = F.concat(cut(1, 3), F.lit("-"), cut(4, 3), F.lit("-"), cut(7, 4))
    rows = [
        (1, pick('token = "', 'api_key: "', "secret=", 'password = "', "auth_token="), F.substring(hexa, 1, 40)),
        (1, pick("access-key: ", 'private key = "', "credential=", 'token = "'), F.regexp_replace(mixed, "[^A-Za-z0-9]", "x")),
        (0, F.concat(word(1), F.lit(" ")), F.concat(word(5), word(6), word(4), cut(1, 2))),
        (0, pick("commit ", "page ", "id ", "doi "), F.substring(hexa, 1, 40)),
        (0, F.concat(word(2), F.lit("=")), F.concat(word(5), F.lit("-"), word(6), F.lit("-"), word(4), cut(1, 2))),
        (1, pick("mail ", "contact ", "write to "), F.concat(word(4), pick(" (at) ", " [at] ", "(at)"), word(5), pick(" (dot) ", " [dot] ", "."), F.lit("com"))),
        (1, pick("tel. ", "phone ", "call ", "mobile: "), phone),
        (1, pick("ssn ", "social security "), F.concat(cut(1, 3), F.lit("-"), cut(4, 2), F.lit("-"), cut(6, 4))),
        (0, F.concat(word(3), F.lit(" ")), F.concat(F.lit("4"), cut(1, 15))),
        (0, pick("in ", "years ", "pages "), F.concat(cut(1, 4), F.lit("-"), cut(5, 4))),
        (0, pick("total ", "sum ", "version "), F.concat(cut(1, 3), F.lit("."), cut(4, 3), F.lit("."), cut(7, 3))),
        (0, pick("on ", "since "), F.concat(cut(1, 4), F.lit("-"), cut(5, 2), F.lit("-"), cut(7, 2))),
        # the words that tell of a secret or a contact also stand before harmless spans
        (0, pick("token ", "authors: ", "password reset ", "secret garden "), F.concat(word(5), F.lit("-"), word(6), F.lit("-"), word(4), cut(1, 2))),
        (0, pick("call ", "fax ", "phone book ", "contact "), F.concat(cut(1, 4), F.lit("-"), cut(5, 4))),
        (0, pick("mail ", "contact "), F.concat(word(4), pick(" (at) ", " [at] "), cut(1, 2), F.lit("."), cut(3, 2))),
    ]
    t = F.pmod(i, F.lit(len(rows)))
    choose = lambda k: reduce(lambda e, r: e.when(t == r[0], r[1][k] if isinstance(r[1][k], Column) else F.lit(r[1][k])), enumerate(rows[1:], 1), F.when(t == 0, rows[0][k] if isinstance(rows[0][k], Column) else F.lit(rows[0][k])))
    df = spark.range(0, TRAINING_ROWS, 1, 2).select("id", choose(0).alias("label"), F.concat(word(1), F.lit(" "), word(3), F.lit(" "), choose(1)).alias("lead"), choose(2).alias("value"))
    df = df.withColumn("tail", F.when(F.col("lead").rlike('"$'), F.lit('" ')).otherwise(F.lit(" "))).withColumn("text", F.concat("lead", "value", "tail", word(4)))
    spans = df.select("id", "label", F.length("lead").alias("start"), F.length("value").alias("n"), F.explode(candidates(F.col("text"))).alias("s"))
    covered = F.least(F.col("s.end"), F.col("start") + F.col("n")) - F.greatest(F.col("s.start"), F.col("start"))
    return spans.select("id", "s.kind", "s.f.*", F.when((F.col("label") == 1) & (covered >= 0.8 * F.col("n")), 1.0).otherwise(0.0).alias("label"))


class Trees:
    """Boosted trees as columns: probability of a candidate's features, and a threshold for each kind."""

    def __init__(self, spark: SparkSession):
        table = _training(spark)
        model = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=7).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table.where("pmod(xxhash64(id, 99), 3) <> 0")))
        self.trees = [(float(w), self._read(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees)]
        # calibration: the lowest score from which on the held-out candidates reach the precision
        held = table.where("pmod(xxhash64(id, 99), 3) = 0").select("kind", "label", self.score(lambda n: F.col(n)).alias("p"))
        w = Window.partitionBy("kind").orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, 0)
        good = held.withColumn("precision", F.avg("label").over(w)).where(f"precision >= {PRECISION}").groupBy("kind").agg(F.min("p").alias("t"))
        self.limits = {r.kind: max(0.5, r.t) for r in good.collect()}

    def _read(self, node):
        """(feature, threshold, left, right) or a leaf's value; MLlib's own nodes are read once, on the driver."""
        if node.getClass().getSimpleName() == "LeafNode":
            return float(node.prediction())
        split = node.split()
        return FEATURES[split.featureIndex()], float(split.threshold()), self._read(node.leftChild()), self._read(node.rightChild())

    def score(self, feature) -> Column:
        def value(node) -> Column:
            return F.lit(node) if isinstance(node, float) else F.when(feature(node[0]) <= node[1], value(node[2])).otherwise(value(node[3]))

        raw = reduce(lambda a, b: a + b, [w * value(t) for w, t in self.trees])
        return 1.0 / (1.0 + F.exp(-2.0 * raw))

    def chosen(self, spans: Column) -> Column:
        """Spans whose score reaches their kind's limit; of those that overlap in order of their starts the one with the higher score (the first of equal ones)."""
        limit = lambda s: reduce(lambda e, k: e.when(s["kind"] == k, self.limits[k]), self.limits, F.when(F.lit(False), 1.0)).otherwise(2.0)
        scored = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), self.score(lambda n: s["f"][n]).alias("p"), limit(s).alias("limit")))
        good = F.array_sort(F.transform(F.filter(scored, lambda s: s["p"] >= s["limit"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["p"].alias("p"))))
        some = "array<struct<start:int,end:int,kind:string,p:double>>"

        def step(acc: Column, s: Column) -> Column:
            last = F.element_at(acc["last"], -1)
            clash = (F.size(acc["last"]) > 0) & (s["start"] < last["end"])
            fits = F.size(acc["last"]) < GATHERED
            better = F.concat(F.slice(acc["last"], 1, F.size(acc["last"]) - 1), F.array(s))
            return F.struct(
                F.when(clash, F.when(s["p"] > last["p"], better).otherwise(acc["last"])).when(fits, F.concat(acc["last"], F.array(s))).otherwise(F.array(s)).alias("last"),
                F.when(clash | fits, acc["full"]).otherwise(F.concat(acc["full"], F.array(acc["last"]))).alias("full"),
            )

        # element_at of an empty array is never looked at, but it must not fail
        def kept(g: Column) -> Column:
            done = F.aggregate(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), F.struct(F.slice(g, 1, 1).cast(some).alias("last"), F.array().cast(f"array<{some}>").alias("full")), step)
            return F.when(F.size(g) > 0, let(done, lambda d: F.flatten(F.concat(d["full"], F.array(d["last"]))))).otherwise(F.array().cast(some))

        return let(good, kept)


_TREES: dict[str, Trees] = {}


def trees_of(spark: SparkSession) -> Trees:
    """The trees of this application; they are trained once."""
    key = spark.sparkContext.applicationId
    if key not in _TREES:
        _TREES.clear()
        _TREES[key] = Trees(spark)
    return _TREES[key]


def _all_spans(text: Column, trees: Trees) -> Column:
    """Struct of the base spans by kind and all added ones; a text without digit, @ or bracketed word has none."""
    some = "struct<start:int,end:int,value:string>"

    def body(t: Column) -> Column:
        gate = t.rlike("[0-9@(\\[]")
        base = base_spans(t)
        added = F.transform(trees.chosen(candidates(t)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        parts = [F.when(gate, base[k]).otherwise(F.array().cast(f"array<{some}>")).alias(k) for k in BASE]
        return F.struct(*parts, F.when(gate, added).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("added"))

    return let(clean(text), body)


def _listed(kind, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else s["kind"], s["start"], s["end"]))


def find(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> a row for each: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    Null text: empty, without spans. Rows may repeat; an empty table gives an empty result; other columns are ignored.
    """
    trees = trees_of(docs.sparkSession)
    s = F.col("s")
    found = docs.select("doc_id", _all_spans(F.col("text"), trees).alias("s"))
    base = F.array_join(F.concat(*[_listed(k, s[k]) for k in BASE]), ",")
    added = F.array_sort(F.transform(s["added"], lambda x: F.struct(F.array_position(F.array(*map(F.lit, ADDED)), x["kind"]).alias("o"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    every = F.array_join(F.concat(*[_listed(k, s[k]) for k in BASE], _listed(None, added)), ",")
    return found.select("doc_id", *[F.size(s[k]).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), sum((F.size(s[k]) for k in BASE), F.size(s["added"])).cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets (overlapping spans by one mark); n_chars follows, if there is one."""
    trees = trees_of(docs.sparkSession)

    def rewritten(both: Column) -> Column:
        text, s = both["text"], both["s"]
        named = lambda k: F.transform(s[k], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(k).alias("kind")))
        base = [named(k) for k in BASE]
        added = F.transform(s["added"], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), x["kind"], F.lit(">"))
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

        done = F.aggregate(F.array_sort(F.concat(*base, added)), zero, step)
        return let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))

    def marked(both: Column) -> Column:
        some = F.exists(F.array(*[F.size(both["s"][k]) for k in (*BASE, "added")]), lambda n: n > 0)
        return F.when(some, rewritten(both)).otherwise(both["text"])

    out = docs.withColumn("text", let(F.struct(F.col("text").alias("text"), _all_spans(F.col("text"), trees).alias("s")), marked))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
