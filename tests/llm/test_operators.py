import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from studyloom.llm import chat_format, common, compression, decontaminate, html_extract, lm_score, mixing, pii, quality_rules, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int"


def odd(spark, rows=None):
    """Nulls in every column, empty, repeated and very long texts, clashing column names."""
    base = [
        (1, None, "en", "a", 0, "x", 1), (2, "", None, None, None, None, None), (None, "some words here", "en", "a", 1, "x", 1), (3, "plain words " * 30, "en", "b", 1, "x", 1),
        (3, "plain words " * 30, "en", "b", 1, "x", 1), (4, "w" * 50000, "de", None, 1, "x", 1), (5, "a b c d e f g " * 4000, "fr", "b", 1, "x", 1), (6, " \t\n ", "en", "b", 1, "x", 1),
    ]
    return spark.createDataFrame(base if rows is None else rows, DOCS).repartition(2)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, empty):
    docs = odd(spark, [] if empty else None)
    n = 0 if empty else 8
    labels = spark.createDataFrame([] if empty else [(1, 1), (3, 0), (5, 1), (None, None)], "doc_id long, quality int")
    bench = spark.createDataFrame([] if empty else [(1, None), (2, ""), (None, "a b c d e f g a b c")], "item_id long, text string")
    assert quality_rules.quality_rules(docs).count() == n
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert lm_score.score(docs).count() == n
    assert compression.score(docs, labels).count() == n
    assert pii.find(docs).count() == n
    assert pii.redact(docs).count() == n
    assert mixing.mix(docs).count() == n
    assert {r.doc_id for r in decontaminate.leaks(docs, bench).collect()} == (set() if empty else {5})
    assert decontaminate.drop_leaks(docs, bench).count() == max(0, n - 1)
    pages = spark.createDataFrame([] if empty else [(1, None, None), (None, "http://x/", "<p>a"), (2, "x", ""), (2, "x", "")], "page_id long, url string, html string")
    assert html_extract.extract(pages).count() == (0 if empty else 4)
    assert warc.round_trip(pages).count() == (0 if empty else 4)
    turns = spark.createDataFrame([] if empty else [(1, 0, None, None), (None, None, "user", "x"), (1, 0, None, None)], "conv_id long, turn long, role string, text string")
    assert {r.n_turns for r in chat_format.summary(chat_format.format_conversations(turns)).collect()} == (set() if empty else {1, 2})


def test_quality_base_and_outliers(spark):
    r = random.Random(1)
    rows = [(k, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(60, 300))), "en", "s", 1, "", 1) for k in range(200)]
    rows += [(1000 + k, re.sub(r"\b(?= )", "###", rows[k][1]), "en", "s", 1, "", 1) for k in range(10)]
    got = {x.doc_id: x for x in quality_rules.quality_rules(odd(spark, rows)).collect()}
    assert all(got[k].kept for k in range(200)) and not any(got[1000 + k].kept for k in range(10))
    for i, t, *_ in rows[::20]:
        w = t.split()
        grams = list(zip(w, w[1:], w[2:]))
        cover = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_repeat_words) == (len(w), sum(map(len, w)), t.count("#"), len(cover))


def test_quality_columns_may_clash(spark):
    rows = [(k, "word " * 3 + " ".join(f"{k}x{j}" for j in range(60)), "en", "s", 1, "", 1) for k in range(5)]
    docs = odd(spark, rows)
    for name in ("k", "g", "x1", "m0", "l00", "start", "bin", "group", "distance", "failed"):
        docs = docs.withColumn(name, docs.doc_id * 10)
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns and sorted(r.m0 for r in out.collect()) == [0, 10, 20, 30, 40] and {r.x1 for r in out.collect()} == {0, 10, 20, 30, 40}


def test_quality_estimate_matches_plain_concentration(spark):
    r = np.random.default_rng(3)
    mix = r.standard_normal((5, 5))
    x = np.concatenate([r.standard_normal((160, 5)) @ mix, r.standard_normal((30, 5)) * 0.3 + 25])
    frame = spark.createDataFrame([("a", *map(float, v)) for v in x], "g string, x1 double, x2 double, x3 double, x4 double, x5 double").repartition(3)
    got = quality_rules.concentrate(frame).first()
    floors = np.diag(np.square(quality_rules.FLOORS))
    best = None
    for start in range(2):
        q = np.percentile(x, [25, 50, 75], axis=0, method="inverted_cdf")
        m, v = (x.mean(0), np.cov(x.T, bias=True)) if start == 0 else (q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2))
        for _ in range(quality_rules.STEPS):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(v + floors), x - m)
            bins = np.floor(quality_rules.BINS_PER_DOUBLING * np.log2(d + 1e-3))
            keep = np.array([(bins < b).sum() < quality_rules.KEEP_SHARE * len(x) for b in bins])
            m, v = x[keep].mean(0), quality_rules.CONSISTENCY * np.cov(x[keep].T, bias=True)
        det = np.linalg.slogdet(v + floors)[1]
        if best is None or det < best[0] - 1e-9:
            best = det, m, v
    assert np.allclose([got[c] for c in quality_rules.LOCATION], best[1], atol=1e-6) and got["size"] == 190
    assert np.allclose([got[f"v{i}{j}"] for i, j in quality_rules.PAIRS], [best[2][i, j] for i, j in quality_rules.PAIRS], atol=1e-6)
    assert abs(best[1]).max() < 2  # the 30 outliers don't move it


def test_quality_small_groups_lean_on_wider_ones(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    text = lambda n: " ".join(word(r.randrange(3, 8)) for _ in range(n))
    rows = [(k, text(r.randrange(60, 200)), "en", f"s{k % 40}", 1, "", 1) for k in range(160)]
    rows += [(1000, " ".join(word(6) + "###|||" for _ in range(80)), "en", "s1", 1, "", 1), (1001, text(90), "xx", "only", 1, "", 1)]
    kept = {x.doc_id: x.kept for x in quality_rules.quality_rules(odd(spark, rows)).collect()}
    assert not kept[1000] and kept[1001] and sum(kept.values()) >= 159


def test_tiling_finds_reordered_passages():
    r = np.random.default_rng(0)
    item = r.integers(1, 1 << 60, 40).astype(np.uint64)
    text = np.concatenate([r.integers(1, 1 << 60, 30).astype(np.uint64), item[20:], r.integers(1, 1 << 60, 9).astype(np.uint64), item[:20]])
    found = decontaminate.tiles(item, text)
    assert sorted((i, n) for i, _, n in found) == [(0, 20), (20, 20)]
    assert decontaminate.tiles(item, item[:4]) == []
    w = decontaminate.rolling(item, 5)
    assert w[3] == decontaminate.rolling(item[3:8], 5)[0]


def plain_tiles(item, text, least):
    """Greedy tiling by its definition: again and again the longest common run of free tokens, the first in the item and then in the text."""
    a, b, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and a[i + k] and b[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return out
        out.append((i, j, k))
        a[i : i + k], b[j : j + k] = [False] * k, [False] * k


def test_tiles_match_their_definition():
    r = random.Random(9)
    for case in range(60):
        item = [r.randrange(1, 4 if case % 2 else 40) for _ in range(r.randrange(1, 34))]
        text = [r.randrange(1, 4 if case % 2 else 40) for _ in range(r.randrange(0, 30))]
        for _ in range(3):
            lo = r.randrange(len(item))
            text[r.randrange(len(text) + 1) : 0] = item[lo : lo + r.randrange(1, 20)]
        got = decontaminate.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        want = plain_tiles(item, text, 3)
        # among equally long runs another one may be taken first, which can cost a tile of the least length
        assert abs(sum(k for *_, k in got) - sum(k for *_, k in want)) <= 3
        assert max((k for *_, k in got), default=0) == max((k for *_, k in want), default=0)
        used_item, used_text = [], []
        for i, j, k in got:
            assert k >= 3 and item[i : i + k] == text[j : j + k]
            used_item += range(i, i + k)
            used_text += range(j, j + k)
        assert len(set(used_item)) == len(used_item) and len(set(used_text)) == len(used_text)


def test_leaks_match_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(r.randrange(4, 30)))) for k in range(8)] + [(90, "la " * 100)]
    rows = [(0, "la " * 20000, "en", "s", 1, "", 1)]
    for k in range(1, 50):
        parts = [" ".join(word() for _ in range(30))]
        w = items[k % 8][1].split()
        if k % 3 == 0:
            parts += [" ".join(w[len(w) // 2 :]), " ".join(word() for _ in range(9)), " ".join(w[: len(w) // 2])]
        elif k % 3 == 1:
            parts.append(" ".join(w[: r.randrange(1, len(w))]).upper())
        rows.append((k, " . ".join(parts), "en", "s", 1, "", 1))
    want = set()
    for d, t, *_ in rows[1:]:
        for i, x in items:
            a, b = x.split(), decontaminate.TOKEN.findall(t.lower())
            n = sum(k for *_, k in plain_tiles(a, b, 5))
            if len(a) >= 5 and n >= 5 and n >= 0.5 * len(a):
                want.add((d, i))
    want.add((0, 90))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(odd(spark, rows), bench).collect()} == want


def test_pii_many_spans_in_one_text(spark):
    text = "a@b.cc 10.0.0.1 " * 1500
    got = pii.find(odd(spark, [(1, text, "en", "s", 1, "", 1)])).first()
    assert (got.n_email, got.n_ip) == (1500, 1500) and got.n_spans >= 3000
    assert got.spans.split(",")[1499] == f"email:{16 * 1499}:{16 * 1499 + 6}"


def test_pii_overlapping_candidates_leave_the_better_one(spark):
    trees = pii.trees_of(spark)
    spans = [("secret", 0, 20, 0.99), ("number", 10, 30, 0.995), ("secret", 30, 60, 0.99), ("secret", 61, 70, 0.99), ("number", 65, 90, 0.98)]
    zero = ", ".join(f"'{n}', 0.0D" for n in pii.FEATURES)
    rows = spark.createDataFrame([(spans,)], "s array<struct<kind:string,start:int,end:int,length:double>>")
    full = rows.selectExpr(f"transform(s, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'f', named_struct({zero.replace(chr(39) + 'length' + chr(39) + ', 0.0D', chr(39) + 'length' + chr(39) + ', x.length')}))) AS s")
    plain = pii.Trees.__new__(pii.Trees)
    plain.limits = {"secret": 0.9, "number": 0.9}
    plain.score = lambda feature: feature("length")
    got = full.select(plain.chosen(full.s).alias("s")).first().s
    assert [(x.kind, x.start) for x in got] == [("number", 10), ("secret", 30), ("secret", 61)]
    assert set(trees.limits) == set(pii.ADDED)


def test_pii_base_spans(spark):
    texts = ["a@b.c_d@e.f a..b@c..d x@y.z. é 1.2.3.4.5.6.7.8 999.1.1.1", "4111 1111 1111 1111 and 4111111111111112 +1 (212) 555-0100 +12", "9" * 3000 + " " + "1 2" * 3000, "😀 x.y@mail.example.com\x01\x02", 'token = "bc0a5302762f379690bc0a5302762f379690abcd" x']
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        luhn = sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    got = {x.doc_id: x for x in pii.find(odd(spark, [(k, t, "en", "s", 1, "", 1) for k, t in enumerate(texts)])).collect()}
    for k, t in enumerate(texts):
        base = ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, p in patterns for m in re.finditer(p, t) if ok(kind, m[0]))
        assert got[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[4].spans == "secret:9:49"


def test_lm_base_score(spark):
    rows = [(k, f"the cat {k % 3} sat THE", "en", "s", 1, "", 1) for k in range(40)]
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    train = [w for k, t, *_ in rows if not held(k) for w in [*t.lower().split(), None]]
    for x in lm_score.score(odd(spark, rows)).collect():
        words = [*rows[x.doc_id][1].lower().split(), None]
        want = sum(math.log10((train.count(w) + 0.5) / (len(train) + 0.5 * (len(set(train)) + 1))) for w in words)
        assert (x.held_out, x.n_tokens, x.train_tokens) == (held(x.doc_id), 6, len(train))
        assert abs(x.base_score - want) < 1e-6 and -200 < x.score < 0


def lm_model(texts):
    """A model with counts and one fitting round over texts of ids."""
    flat, before = np.concatenate(texts), np.concatenate([np.concatenate([[lm_score.END], t[:-1]]) for t in texts])
    model = lm_score.Model(np.bincount(flat, minlength=lm_score.IDS))
    cell, n = lm_score._summed([before * lm_score.CLASSES + model.cls[flat]], [np.ones(len(flat), np.int64)])
    key, pair = lm_score._summed([before * lm_score.IDS + flat], [np.ones(len(flat), np.int64)])
    a, b = model.rank[key // lm_score.IDS], model.rank[key % lm_score.IDS]
    both = (a >= 0) & (b >= 0)
    model.count(cell, n, a[both], b[both], pair[both])
    model.train(flat, np.array([len(t) for t in texts]), 1, 0.02, np.zeros(lm_score.IDS, np.int64), model.fresh())
    model.ready()
    return model


def test_lm_scores_are_the_models_probabilities(monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", 40)
    r = np.random.default_rng(0)
    texts = [np.append(r.integers(0, 90, n), lm_score.END) for n in (1, 7, 8, 9, 60, 700)]
    model = lm_model(texts)
    lengths = np.array([len(t) for t in texts])
    line, at, left, text = model.windows(np.concatenate(texts), lengths)
    c, y, real = model.batch(line, at, left)
    assert real.sum() == lengths.sum() and (np.sort(y[real]) == np.sort(np.concatenate(texts))).all()
    p = model.forward(c)[-1]
    won = np.log10(p[np.arange(len(p)), model.cls[y].ravel()] / p.sum(1)).reshape(real.shape)
    inside = [model.within(np.concatenate([[lm_score.END], t[:-1]]), t).sum() for t in texts]
    assert np.allclose(model.score(np.concatenate(texts), lengths), np.bincount(text, weights=(won * real).sum(1)) + inside, atol=1e-3)
    # over all subwords that can come next the probabilities add up to one, wherever a text stands
    start = texts[3][:5]
    every = np.arange(lm_score.IDS)
    alone = model.score(start, np.array([5]))[0]
    some = every[:: lm_score.IDS // 300]
    more = model.score(np.concatenate([np.append(start, k) for k in some]), np.full(len(some), 6)) - alone
    line, at, left, _ = model.windows(np.append(start, 0), np.array([6]))
    p = model.forward(model.batch(line, at, left)[0])[-1][5]
    want = np.log10(p / p.sum())[model.cls[some]] + model.within(np.full(len(some), start[-1]), some)
    assert np.allclose(more, want, atol=1e-3)
    total = sum((10 ** (np.log10(p / p.sum())[model.cls[every]] + model.within(np.full(len(every), before), every)).astype(float)).sum() for before in (int(start[-1]), 30000))
    assert abs(total - 2) < 1e-3


def test_lm_beats_a_bigram_of_the_same_subwords(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    ids = dict(zip([r.doc_id for r in rows], lm_score.encode(lm_score.VOCABULARY, [r.text for r in rows])[3]))
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    one, two = Counter(), Counter()
    for k, x in ids.items():
        if not held(k):
            one.update(x.tolist())
            two.update(zip([lm_score.END, *x[:-1].tolist()], x.tolist()))
    first = Counter()
    for (a, _), n in two.items():
        first[a] += n
    single = lambda b: (one[b] + 0.5) / (sum(one.values()) + 0.5 * lm_score.IDS)
    best = max(sum(math.log10((two[a, b] + prior * single(b)) / (first[a] + prior)) for k, x in ids.items() if held(k) for a, b in zip([lm_score.END, *x[:-1].tolist()], x.tolist())) for prior in (5, 20, 80))
    mine = sum(r.score for r in lm_score.score(docs).where("held_out").collect())
    assert mine > best, (mine, best)


def test_lm_words_and_chunks(monkeypatch):
    monkeypatch.setattr(lm_score, "STRETCH", 64)
    texts = ["", None, "a b\tc A", "x" * 500, "long " * 100 + "END", "\x0b\x0c\n"]
    hashes, owner, n, ids = lm_score.encode(lm_score.VOCABULARY, texts)
    assert n.tolist() == [0, 0, 4, 1, 101, 0] and len(set(hashes.tolist())) == 6
    assert hashes[0] == hashes[3] and (owner == np.repeat(np.arange(6), n)).all()
    assert [x[-1] for x in ids] == [lm_score.END] * 6 and len(ids[0]) == 1
    assert (lm_score.encode(lm_score.VOCABULARY, ["END"])[3][0] == ids[4][-len(lm_score.encode(lm_score.VOCABULARY, ["END"])[3][0]) :]).all()


def test_salvage_logs_gaps():
    good = [warc._gzip(warc.record(k, "http://x/", b"body %d" % k, hashlib.sha1(b"body %d" % k).hexdigest(), None, False)) for k in range(5)]
    broken = good[1][:40] + b"\x00" + good[1][41:]
    plain = warc.record(9, "u", b"xyz", hashlib.sha1(b"xyz").hexdigest(), None, False)
    data = good[0] + broken + good[2] + b"junk" + plain + plain.replace(b"xyz", b"xyy") + good[3][:30]
    out = list(warc.salvage(data))
    assert [x[3]["warc-record-id"] for x in out if x[0] == "record"] == ["<urn:page:0>", "<urn:page:2>", "<urn:page:9>"]
    assert [(x[1], x[2]) for x in out if x[0] == "gap"] == [(len(good[0]), len(broken)), (len(good[0] + broken + good[2]), 4), (len(data) - len(plain) - 30, len(plain) + 30)]


def test_loss_spans_cover_the_assistants_texts(spark):
    rows = [(1, 0, "system", "be <|brief|> & kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "a<|im_sep|>b"), (1, 3, "assistant", ""), (1, 4, "user", "more"), (1, 5, "assistant", "é & ü\n"), (2, 0, "user", "only"), (3, 0, "assistant", None), (4, 0, "odd\nrole", "x")]
    turns = chat_format.with_hard_case(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat_format.format_conversations(turns)
    got = {r.conv_id: (r.formatted, r.s) for r in out.select("conv_id", "formatted", chat_format.loss_spans(out.formatted).alias("s")).collect()}
    plain = lambda x: x.replace("&lt;|", "<|").replace("&#10;", "\n").replace("&amp;", "&")
    texts = {c: [plain(f[s.start : s.end]) for s in spans] for c, (f, spans) in got.items()}
    assert texts == {-1: [chat_format.HARD], 1: ["a<|im_sep|>b", "", "é & ü\n"], 2: [], 3: [""], 4: []}


def test_odd_rows_have_defined_results(spark):
    docs = odd(spark)
    q = {(x.doc_id, x.n_words): x for x in quality_rules.quality_rules(docs).collect()}
    assert q[1, 0].base_failed and not q[1, 0].kept and q[3, 60].n_repeat_words == 60 and q[4, 1].word_chars == 50000
    lm = {x.doc_id: x for x in lm_score.score(docs).collect()}
    assert lm[1].n_tokens == lm[2].n_tokens == lm[6].n_tokens == 1 and lm[3].n_tokens == 61 and lm[None].held_out is False
    p = pii.find(docs).collect()
    assert all(x.spans == "" and x.n_spans == 0 for x in p)
    m = {x.doc_id: x for x in mixing.mix(docs).collect()}
    assert m[1].taken == m[2].taken == m[6].taken == 0 and all(x.taken <= 3 * x.size for x in m.values())
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in compression.score(docs, labels).collect())
    assert {(x.doc_id, x.text) for x in pii.redact(docs.where("doc_id < 3")).collect()} == {(1, None), (2, "")}


def test_html_layouts():
    page = '<html><body><nav><p>menu</nav><div class="main-ad">buy</div><article><h1>T &amp; u</h1><p>a <b>b<br>c</b><p>d&nbsp;e<aside>s</aside><div class="comments">no</div><script>var t="</p>";</script></article><footer>f'
    assert html_extract.main_text(page, None) == "T & u\na b c\nd e"
    assert html_extract.main_text("", None) == "" and html_extract.main_text("<p>x &am", None) == "x &am"
    part = '<article><p>one</p><section class="related-work"><p>two</p></section><p class="notice-board">three</p><div class="side">four</div><div class="search">five</div><div class="header">six</div></article>'
    assert html_extract.main_text(part, None) == "one\ntwo\nthree\nfour\nfive\nsix"
    assert html_extract.main_text("<p>a &am<b>p; b</b>", None) == "a &amp; b"
    assert html_extract.main_text('<p>x</p><div class="site-nav">y</div>', None) == "x"


def test_mix_tree_is_exact():
    q = mixing.split_tree({0: 1000, 1: 7, 2: 333}, 13)
    assert q.groupby("sid").quota.sum().to_dict() == {0: 1000, 1: 7, 2: 333}
    sizes = q.groupby("shard").quota.sum()
    assert sizes.max() - sizes.min() <= 4


def test_mix_deals_disjoint_blocks(spark):
    r = random.Random(3)
    rows = [(k, "w " * r.randrange(0, 700), "en", f"s{k % 4}", 1, "", 1) for k in range(400)]
    placed, goal = mixing.streams(odd(spark, rows))
    target = {x.source: round(x.target) for x in goal.collect()}
    got = mixing.pieces(placed, goal, 9).collect()
    assert {x.shard for x in got} == set(range(9))
    assert Counter({s: sum(x.words for x in got if x.source == s) for s in target}) == Counter(target)
    shard_of = {}
    for x in got:
        assert shard_of.setdefault((x.source, x.block), x.shard) == x.shard
    quotas = mixing.split_tree({k: -(-t // mixing.BLOCK_WORDS) for k, t in enumerate(target[s] for s in sorted(target))}, 9)
    assert Counter(shard_of.values()) == Counter({s: int(q) for s, q in quotas.groupby("shard").quota.sum().items()})
    order = [(x.shard, x.position) for x in mixing.shuffled(mixing.pieces(placed, goal, 9)).collect() if x.shard == 4]
    assert order == sorted(order) and len({p for _, p in order}) == sum(s == 4 for s in shard_of.values())


def test_mix_unit_grows_with_very_large_mixes():
    words = [10**16, 3 * 10**15, 7]
    size = mixing.unit(words)
    counts = {k: -(-w // size) for k, w in enumerate(words)}
    assert mixing.MOST_BLOCKS // 2 <= sum(counts.values()) < mixing.MOST_BLOCKS and mixing.unit([10**6]) == mixing.BLOCK_WORDS
    q = mixing.split_tree(counts, 5)
    assert q.groupby("sid").quota.sum().to_dict() == counts


def test_scratch_drops_what_was_settled_inside(spark):
    with common.scratch(spark):
        kept = common.settle(spark.range(5))
        files = kept.inputFiles()
        assert kept.count() == 5 and os.path.exists(files[0].removeprefix("file://"))
    assert not os.path.exists(os.path.dirname(files[0].removeprefix("file://")))


def test_compression_separates(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choice(["river", "stone", "quiet", "morning", "walks", "under"]) for _ in range(80))
    bad = lambda: " ".join(r.choice(["$$$", "click", "###", "win&&", "free**"]) for _ in range(80))
    rows = [(k, (good if k % 2 else bad)(), "en", "s", 1, "", 1) for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    got = compression.score(odd(spark, rows), labels).where("held_out").collect()
    assert got and all(x.predicted == x.doc_id % 2 for x in got)


def test_compression_sample_passes_over_long_texts(spark, monkeypatch):
    monkeypatch.setattr(compression, "SAMPLE_BYTES", 8000)
    rows = [(k, f"text {k} " + "ab " * (3000 if k % 5 else 20) if k % 2 else "good words here " * 10, "en", "s", 1, "", 1) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    got = compression.sample(odd(spark, rows), labels)
    train = [k for k in range(60) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert [i for i, _, y in got if y == 1] == [k for k in train if k % 2 and k % 5 == 0]
    assert 4000 - 160 < sum(len(t) for _, t, y in got if y == 0) <= 4000
    only = [(1, "z" * 9000, "en", "s", 1, "", 1), (0, "short text", "en", "s", 1, "", 1)]
    assert {(y, len(t)) for _, t, y in compression.sample(odd(spark, only), labels.where("doc_id < 2"))} == {(1, 1000), (0, 10)}


def test_salvage_searches_inside_members():
    ids = lambda out: [x[3]["warc-record-id"] for x in out if x[0] == "record"]
    r = random.Random(4)
    bodies = [bytes(r.randrange(256) for _ in range(3000)) for _ in range(4)]
    one = [warc.record(k, "u", b, hashlib.sha1(b).hexdigest(), None, False) for k, b in enumerate(bodies)]
    middle = one[1].replace(bodies[1][:9], b"otherwise")
    member = warc._gzip(one[0] + middle + one[2])
    out = list(warc.salvage(member + warc._gzip(one[3])))
    assert ids(out) == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]
    assert [x[1:4] for x in out if x[0] == "gap"] == [(0, len(member), f"digest differs (inner bytes {len(one[0])} to {len(one[0]) + len(middle)})")]
    for level in (0, 4):  # at level 0 the records also stand plain in the archive
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        cut = (z.compress(one[0] + one[1] + one[2]) + z.flush())[:-500]
        out = list(warc.salvage(cut + warc._gzip(one[3])))
        assert ids(out) == ["<urn:page:0>", "<urn:page:1>", "<urn:page:3>"]
        assert sum(x[0] == "gap" for x in out) == 1
    # a wrong byte in stored bytes spoils the checksum only, one in a packed stream all that follows it
    for level, left in ((0, ["<urn:page:0>", "<urn:page:2>"]), (4, ["<urn:page:0>"])):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        hit = bytearray(z.compress(one[0] + one[1] + one[2]) + z.flush())
        hit[len(hit) // 2] ^= 255
        assert ids(warc.salvage(bytes(hit))) == left


def test_html_template_of_neutral_names(spark):
    r = random.Random(6)
    said = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    rows, want = [], {}
    for k in range(12):
        parts = [f"title {k}", said(), said()]
        want[k] = "\n".join(parts)
        body = f'<div class="c3"><h1>{parts[0]}</h1><div class="c5">{parts[1]}</div><div class="c6">{parts[2]}</div><div>Read our terms</div></div>'
        notice = '<div class="c2">This site keeps crumbs</div>' if k % 4 else ""
        rows.append((k, "http://neutral.example/" + str(k), f'<body><div class="c1"><div>Home</div><div>Shop</div></div>{notice}{body}<div class="c4">All rights kept</div></body>'))
    rows += [(50 + k, "http://copies.example/", "<body><p>one text</p></body>") for k in range(3)]
    rows.append((60, "http://single.example/", '<body><div class="menu">Home</div><p>only page</p></body>'))
    want |= {50: "one text", 51: "one text", 52: "one text", 60: "only page"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {x.page_id: x.text for x in html_extract.extract(pages).collect()} == want


def plain_template(pages):
    """(valid tokens, main slot) of one host's pages, by comparing the vectors themselves."""
    parsed = [html_extract.parse(h) for h in pages]
    vectors, chars = {}, Counter()
    for k, (found, opened) in enumerate(parsed):
        for p, n in [*opened.items(), ("", 1)]:
            vectors.setdefault((p, None), [0] * len(pages))[k] = n
        for path, text, linked, _, loose in found:
            vectors.setdefault((path, text), [0] * len(pages))[k] += 1
            for p in html_extract._above(path):
                chars[p] += 0 if loose else len(text) - linked
    alike = Counter(map(tuple, vectors.values()))
    valid = {t for t, v in vectors.items() if alike[tuple(v)] > 1 and sum(x > 0 for x in v) >= max(2, len(pages) / 2)}
    for found, _ in parsed:
        for path, text, linked, _, loose in found:
            if (path, text) in valid:
                for p in html_extract._above(path):
                    chars[p] -= 0 if loose else len(text) - linked
    heads = [p.rsplit("/", 1)[0] for p, t in valid if t is None and re.search(r"/h[12](\\.[^/]*)?$", p) and chars[p] > 0]
    fit = [p for p, t in valid if t is None and chars[p] >= 0.6 * chars[""] and (not p or (re.match(r"[a-z0-9]+", p.rsplit("/", 1)[1])[0] in html_extract.GROUPS and sum(vectors[p, None]) == sum(x > 0 for x in vectors[p, None])))]
    fit = [p for p in fit if not any(p.startswith(q + "/") for q in heads)]
    return valid, max(fit, key=lambda p: (len(p), p))


def neutral_site(r, n):
    """Pages whose tags and classes say nothing: menu, notice, advert of its own on each page, article, remarks by readers."""
    said = lambda k: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    out = []
    for k in range(n):
        parts = [f"title {k} {said(3)}", said(60), said(r.randrange(20, 90))]
        menu = "".join(f'<div class="c9"><a href="/{j}">{said(1)}</a></div>' for j in range(5))
        notice = '<div class="c2">This site keeps crumbs</div>' if k % 4 else ""
        body = f'<div class="c3"><h1>{parts[0]}</h1><div class="c5">{parts[1]}</div><div class="c6">{parts[2]}</div><div>Read our terms</div></div>'
        out.append((f'<body><div class="c1"><div>Home</div>{menu}</div>{notice}<div class="c7">{said(6)}</div>{body}<div class="c8"><div>{said(8)}</div></div><div class="c4">All rights kept</div></body>', "\n".join(parts)))
    return out


def test_html_slots_without_any_telling_name(spark):
    site = neutral_site(random.Random(11), 40)
    pages = spark.createDataFrame([(k, "http://plain.example/" + str(k), h) for k, (h, _) in enumerate(site)], "page_id long, url string, html string").repartition(3)
    valid, main = plain_template([h for h, _ in site])
    assert main == "/body/div.c3"
    got = html_extract.templates(pages).first()
    assert got.main == main and set(got.known) == {html_extract.block_key(p, t) for p, t in valid if t is not None}
    tokens = html_extract.nested(html_extract.classes(pages)).collect()
    assert {(t.path, t.block) for t in tokens} == {(p, 0 if t is None else html_extract.block_key(p, t)) for p, t in valid}
    of = {(t.path, t.block): t for t in tokens}
    assert of["/body/div.c2", 0].parent == of["/body", 0].vector and of["/body", 0].parent is None
    assert {x.page_id: x.text for x in html_extract.extract(pages).collect()} == {k: t for k, (_, t) in enumerate(site)}
    assert all(html_extract.main_text(h, None) != t for h, t in site)


def test_html_copies_keep_their_text(spark):
    site = neutral_site(random.Random(12), 9)
    rows = [(k, "http://c.example/", site[min(k, 3)][0]) for k in range(9)]  # most pages are copies of one
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html_extract.extract(pages).collect()}
    assert all(site[min(k, 3)][1].split("\n")[j] in got[k] for k in range(9) for j in range(3))


def test_html_without_classes_or_telling_tags(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: html_extract.main_text(r.html or "", None) for r in pages.collect()}
    bare = r'<(/?)(nav|article|footer|aside|header|main|section|form)\\b'
    plain = pages.selectExpr("page_id", "url", f"regexp_replace(regexp_replace(html, '{bare}', '<$1div'), ' (class|id|role)=\"[^\"]*\"', '') AS html")
    hosts = {r.host for r in html_extract.templates(plain).where("main IS NOT NULL").collect()}
    assert hosts
    got = html_extract.extract(plain).withColumn("host", html_extract.host(plain.url)).collect()
    assert all(r.text == want[r.page_id] for r in got if r.host in hosts)
    first, path = html_extract.parse("<div><ul><li>a</ul></div><div>b</div><div> <h1>c</h1>d</div><div></div>")
    assert [b[0] for b in first] == ["/div>ul/ul/li", "/div", "/div>h1/h1", "/div>h1"] and path["/div"] == 2
