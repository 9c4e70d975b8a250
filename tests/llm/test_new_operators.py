"""The prefix trie, the Hilbert shards and the Merkle manifest against plain Python, on odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from studyloom.llm import common, hilbert, merkle, prefix_trie


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- placed


def test_placed_numbers_each_group_without_gaps(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("aaab"), rnd.randrange(5), k, rnd.randrange(9)) for k in range(3000)]
    df = common.settle(spark.createDataFrame(rows, "g string, x int, tie int, w long").repartition(7))
    got = sorted((r.g, r.i, r.x, r.tie, r.n, r.before, r.total) for r in common.placed(df, "g", ["x", "tie"], "w").collect())
    want = []
    for g in "ab":
        mine, before = sorted((x, t, w) for h, x, t, w in rows if h == g), 0
        for i, (x, t, w) in enumerate(mine):
            want.append((g, i, x, t, len(mine), before, sum(m[2] for m in mine)))
            before += w
    assert got == sorted(want)


# --- prefix trie


def trie(rows):
    """rows (conv_id, turn, role, text) -> the nodes, by following every path."""
    words = lambda t: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w])
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    full = {c: own.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + v[zlib.crc32(str(c).encode()) % 4 :] for c, v in own.items()}
    members = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for node, who in members.items():
        under = [n for n in members if n[: len(node)] == node]
        childless = lambda n: not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        here = sorted(c for c in who if len(full[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(len(n) == len(node) + 1 for n in under), sum(map(childless, under)), sum((len(members[n]) - 1) * words(n[-1][1]) for n in under if n), sha(",".join(map(str, here)))))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_paths(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(130), 70):
        for k in range(rnd.randrange(1, 6)):
            rows.append((c, rnd.choice([k, None, k]), rnd.choice(["user", "assistant", None]), rnd.choice(["", None, "a b", "a  b c\n", "é"])))
    rows += rows[:9]
    got = prefix_trie.nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == trie(rows)


def test_trie_of_many_equal_conversations_and_odd_tables(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 3000) for t in range(2)] + [(None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.nodes(df.select("*", *[F.lit(1).alias(c) for c in ("a", "b", "depth", "owner", "salt", "words", "len", "sign")]).repartition(6))
    found = {(r.conv_id, r.depth): r for r in got.collect()}
    own = {c: [f"turn {t}" for t in range(2)] for c in range(1, 3000)}
    taken = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    full = {c: own.get(c - c % 20, [])[: taken[c]] + v[taken[c] :] for c, v in own.items()}
    ends = sorted(c for c, v in full.items() if v == ["turn 0", "turn 1"])
    node = min(c for c, v in full.items() if v[:2] == ["turn 0", "turn 1"]), 2
    assert found[node].ends_sha256 == sha(",".join(map(str, ends))) and found[node].n_convs == len(ends) and len(ends) > 1500
    assert found[1, 0].n_convs == 2999
    assert prefix_trie.nodes(df.limit(0)).count() == 0


# --- Hilbert shards


def test_curve_visits_neighbours(spark):
    side = spark.range(8)
    cube = side.toDF("x").crossJoin(side.toDF("y")).crossJoin(side.toDF("z"))
    rows = cube.select("x", "y", "z", hilbert.curve_index([F.col("x"), F.col("y"), F.col("z")], 3).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(512))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(rows, rows[1:]))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("n", [0, 1, 5, 24, 100])
def test_shards_of_odd_rows(spark, n):
    rows = [(k % 40 if k % 7 else None, [None, "", "same text", f"é {k}", "x" * 5000 * (k % 3)][k % 5], [None, "en", "de"][k % 3], [None, "a", "a", "a"][k % 4], None) for k in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("x").alias("size"), F.lit("x").alias("shard"), F.lit(1).alias("tie"), F.lit(1).alias("grp"), F.create_map(F.lit(1), F.lit(2)).alias("i"))
    got = hilbert.shards(df).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((d is not None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(s, [])) for s in range(24)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    assert [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))] == sorted(r.curve for r in got)


def test_many_values_of_a_dimension_meet_their_cells_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(k, "t", "en", f"s{k % 50:02d}", 1) for k in range(400)], SCHEMA)
    want = sorted(map(tuple, hilbert.shards(df).collect()), key=str)
    monkeypatch.setattr(hilbert, "sent_to_all", lambda d: d)
    assert sorted(map(tuple, hilbert.shards(df).collect()), key=str) == want


def test_files_are_passed_over(spark, tmp_path):
    df = spark.createDataFrame([(k, "t" * (k % 97 + 1), ["de", "en", "es", "fr"][k % 4], f"s{k * 7 % 10}", 1) for k in range(4000)], SCHEMA)
    out = common.settle(hilbert.shards(df))
    limits = hilbert.bounds(out)
    few = {r.shard for r in hilbert.may_hold(limits, lang=("de", "de"), source=("s4", "s4")).collect()}
    assert few >= {r.shard for r in out.where("lang = 'de' AND source = 's4'").select("shard").distinct().collect()} and len(few) <= 8
    hilbert.write(df, out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).select("doc_id", "shard", "slot").exceptAll(out.select("doc_id", "shard", "slot")).isEmpty()


# --- Merkle manifest


def merkle_plain(rows, found):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, lang, s, n: sha("".join(map(enc, (d, s, lang, n, t))))

    def up(level):
        """Nodes (hash, leaves below) -> the root, noting each leaf's sibling hashes."""
        while len(level) > 1:
            nxt = []
            for a in range(0, len(level), 3):
                run = level[a : a + 3]
                for k, (_, below) in enumerate(run):
                    for x in below:
                        steps[x].append((k, [h for h, _ in run]))
                nxt.append((sha("".join(h for h, _ in run)), [x for _, b in run for x in b]))
            level = nxt
        return level[0]

    steps, subs = defaultdict(list), []
    first = {i: leaf(*r) for i, r in enumerate(rows)}
    for s in sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        ids = sorted((i for i, r in enumerate(rows) if r[3] == s), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, first[i]))
        subs.append(up([(first[i], [i]) for i in ids]))
    subroot = {x: h for h, below in subs for x in below}
    root = up(subs)[0]
    out = []
    for i, (d, t, lang, s, n) in enumerate(rows):
        proof, cur = "", leaf(d, found(d, t), lang, s, n)
        for k, run in steps[i]:
            proof += "".join(run[:k] + run[k + 1 :])
            cur = sha("".join(run[:k] + [cur] + run[k + 1 :]))
        out.append((d, first[i], subroot[i], root, sha(proof), cur, cur == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 3, 4, 243, 244, 800])
def test_manifest_equals_plain_tree(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice([k, k, None, k // 2]), rnd.choice([None, "", "a\nb", f"é\n{k}", "plain"]), rnd.choice([None, "en"]), rnd.choice(["big"] * 7 + [None, "", "é", "z"]), rnd.choice([None, k])) for k in range(n)]
    rows += rows[: n // 9]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("leaf", "grp", "i", "n", "tie", "root", "steps")]).repartition(5)
    got = merkle.manifest(df, merkle.tampered())
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = merkle_plain(rows, lambda d, t: t.replace("\n", "") if t is not None and d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else t)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == want


def test_manifest_of_no_rows_and_of_untouched_ones(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.verified for r in merkle.manifest(spark.createDataFrame([(k, "a\n", "en", str(k % 3), 1) for k in range(20)], SCHEMA)).collect()} == {True}
