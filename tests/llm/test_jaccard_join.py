import random

from studyloom.llm import jaccard_join
from studyloom.llm.jaccard_join import components


def brute(rows, percent=85):
    def grams(t):
        w = (t or "").encode().lower().split()
        if not w:
            return frozenset()
        return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) or frozenset([tuple(w)])

    sets = {i: grams(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string").repartition(3)
    return {tuple(r) for r in components(df).collect()}


def test_matches_brute_force_on_near_copies(spark):
    r = random.Random(5)
    word = lambda: r.choice("abcdefghij") + str(r.randrange(300))
    rows, k = [], 0
    shared = [word() for _ in range(40)]
    for family in range(12):
        base = [word() for _ in range(r.randrange(30, 120))]
        for _ in range(r.choice([1, 3, 9, 150 if family == 0 else 2])):
            t = list(base)
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(len(t))] = word()
            rows.append((k := k + 1, " ".join(t)))
        rows.append((k := k + 1, " ".join(shared + base[:5])))
    assert got(spark, rows) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "two one"), (9, "a b c d e " * 3000), (8, "A b\nc d e " * 3000)]
    assert got(spark, rows) == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (9, 5, 8), (8, 5, 8)}
    assert got(spark, []) == set()
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d")], "doc_id long, text string")
    assert sorted(map(tuple, components(df).select("doc_id", "n_shingles").collect()), key=str) == sorted([(None, 1), (7, 1), (7, 1)], key=str)


def test_one_shingle_of_texts_of_different_lengths(spark):
    rows = [(11, "buy buy buy buy"), (12, "Buy buy\tbuy buy buy"), (13, "buy " * 500), (14, "buy buy buy"), (15, "sell sell sell sell"), (16, "buy buy buy buy now"), (17, "buy buy")]
    assert got(spark, rows) == brute(rows)
    assert {(i, c) for i, _, c in got(spark, rows)} >= {(11, 11), (12, 11), (13, 11), (14, 14), (16, 16)}


def test_large_clusters_meet_pivots_first(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LARGE", 40)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    r = random.Random(8)
    line = [f"w{r.randrange(100000)}" for _ in range(900)]
    rows = [(k, " ".join(line[3 * k : 3 * k + 150])) for k in range(200)]  # each links with its neighbours only
    base = [f"v{k}" for k in range(120)]
    rows += [(1000 + k, " ".join([*base[:60], f"x{k}", *base[60:]])) for k in range(90)]  # all link with all
    rows += [(2000 + k, " ".join([*base[:70], *(f"y{k}z{j}" for j in range(60))])) for k in range(30)]  # share much and link with none
    assert got(spark, rows) == brute(rows)


def test_rows_of_one_id_with_different_texts(spark):
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows = [(7, " ".join(a)), (7, " ".join(b)), (8, " ".join([*a[:-1], "z"])), (9, " ".join([*b[:-1], "z"])), (3, "c d e f g"), (7, " ".join(a))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(x) for x in components(df).collect()) == [(3, 2, 3), (7, 57, 7), (7, 57, 7), (7, 57, 7), (8, 57, 7), (9, 57, 7)]
