from __future__ import annotations

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import p6_leaks as K
from strandloom.llm import p7_mixture as M
from strandloom.llm import p8_reading as R
from strandloom.llm.codewords import trigrams, word_hashes, word_list
from strandloom.llm.textwords import hash_word, split_words

WORDS = [f"{a}{b}{c}" for a in ("bar", "lom", "tin", "vex", "qua") for b in ("do", "si", "ka", "mu") for c in ("n", "rel", "tor", "x")]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_words_and_hashes():
    w = split_words(["Größe, ÄB c3!", "", "\0x y", "end"])
    assert [bytes(w.raw[a:b]).decode() for a, b in zip(w.start, w.stop, strict=True)] == ["Größe", "ÄB", "c3", "x", "y", "end"]
    assert w.doc.tolist() == [0, 0, 0, 2, 2, 3] and w.hash[5] == hash_word("END") != w.hash[4]
    assert len(split_words([]).hash) == 0 and len(split_words(["", "?"]).hash) == 0


def test_word_hashes_follow_the_words():
    texts = ["Größe, ÄB c3_d!", "", "\0x y", "слово\u00ad СЛОВО e\u0301te"]
    doc, h = word_hashes(texts)
    assert [word_list(t) for t in texts] == [["größe", "äb", "c3", "d"], [], ["x", "y"], ["слово", "слово", "éte"]]
    assert doc.tolist() == [0, 0, 0, 0, 2, 2, 3, 3, 3] and h[6] == h[7] and len(set(h.tolist())) == 8
    assert len(word_hashes([])[1]) == len(word_hashes(["?"])[1]) == 0


def _disturb(rng, words):
    """Case, punctuation, breaks, single letters and words changed, something put in between."""
    out = []
    for i, w in enumerate(words):
        if i % 9 == 4:
            w = rng.choice(WORDS) if rng.random() < 0.5 else w[:-1] + "z"
        out.append(w.upper() if rng.random() < 0.2 else w)
        out.append(rng.choice([", ", " ", "\n", " -- "]))
        if i == len(words) // 2:
            out.append("[Interruption from the floor] ")
    return "".join(out)


def test_planted_passages_are_found_and_short_ones_not(spark):
    rng = random.Random(8)
    items = [(100 + i, _text(rng, rng.randint(55, 100)) + "\nQuestion: what is said about barn?") for i in range(40)]
    items += [(900, None), (None, "x y z"), (901, ""), (902, "only six words stand in here")]
    docs, want = [], set()
    for d in range(200):
        body, item = _text(rng, rng.randint(0, 150)), rng.choice(items[:40])
        passage = K.word_list(K.question_split(item[1])[0])
        kind = d % 5
        if kind in (0, 1):
            n = rng.randint(24, 50)
            at = rng.randint(0, len(passage) - n)
            body += " " + _disturb(rng, passage[at : at + n]) + " " + _text(rng, 60)
            want.add((d, item[0]))
        elif kind == 2:
            body += " " + " ".join(passage[5:17]) + " " + _text(rng, 60)  # too short
        elif kind == 3:
            body += " " + " ".join(w if i % 3 else rng.choice(WORDS) for i, w in enumerate(passage)) + "."  # same build, other names
        docs.append((d, body))
    docs += [(500, None), (501, ""), (502, "  "), (None, items[0][1]), (503, "He said that ONLY six words, stand in here!"), (503, "again")]
    want.add((503, 902))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in K.leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == want
    assert K.leaks(df, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


@pytest.mark.parametrize(("name", "value"), [("BLOCK_ITEMS", 3), ("MOST_POSTINGS", 1), ("BITS", 12)])
def test_blocks_joins_and_filter_give_the_same(spark, monkeypatch, name, value):
    rng = random.Random(3)
    items = [(i, _text(rng, 60)) for i in range(30)]
    docs = [(d, _text(rng, 30) + " " + items[d][1]) for d in range(30)]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one = {(r.doc_id, r.item_id) for r in K.leaks(*frames).collect()}
    monkeypatch.setattr(K, name, value)
    assert one == {(r.doc_id, r.item_id) for r in K.leaks(*frames).collect()} == {(d, d) for d in range(30)}


def _leaked(spark, docs, items):
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((r.doc_id, r.item_id) for r in K.leaks(*frames).collect())


def test_size_and_copies_of_the_items_do_not_change_what_is_found(spark):
    rng = random.Random(4)
    own = [" ".join(f"{rng.choice(WORDS)}{i}q{n}" for n in range(70)) for i in range(120)]
    quoted = " ".join(own[0].split()[10:30])
    spread = " ".join(quoted.split()[:7] + ["zz"] * 29 + quoted.split()[7:13] + ["zz"] * 29 + quoted.split()[13:])
    docs = [(1, f"{_text(rng, 50)} {quoted} {_text(rng, 50)}"), (2, own[0]), (3, _text(rng, 20) + " " + spread), (4, _text(rng, 200))]
    for many in (1, 2, 3, 120):
        assert _leaked(spark, docs, list(enumerate(own[:many]))) == [(1, 0), (2, 0), (3, 0)], many
    copies = [(i, own[0] + f"\nQuestion: {i}?" if i % 3 == 0 else own[i]) for i in range(120)]
    assert _leaked(spark, docs, copies) == [(d, i) for d in (1, 2, 3) for i in range(0, 120, 3)]


def test_short_passages_that_stand_whole(spark):
    rng = random.Random(4)
    short = [(900 + n, " ".join(f"short{n}{c}" for c in "abcdefghi"[:n])) for n in (5, 6, 7, 9)]
    docs = [(i, f"{_text(rng, 40)} {t}. {_text(rng, 40)}") for i, t in short] + [(1, " ".join(short[1][1].split()[:5]))]
    for many in (0, 40, 120):
        assert _leaked(spark, docs, short + [(i, _text(rng, 70)) for i in range(many)]) == [(i, i) for i, _ in short], many


def test_pruning_loses_nothing(spark):
    rng = random.Random(5)
    items = [(i, _text(rng, 70)) for i in range(25)]
    texts = [_text(rng, 200) for _ in range(20)] + [items[i][1][: 60 + 20 * i] for i in range(10)] + ["", "a b"]
    rows = K._item_rows(spark.createDataFrame(items, "item_id bigint, text string")).selectExpr("item_id as item", "words", "terms")
    postings = K.cut_lineage(K.item_postings(rows))
    limits = K.item_limits(postings).withColumn("need", F.lit(9.0) + F.col("item") % 3)
    docs = spark.createDataFrame([(d, d, t) for d, t in enumerate(texts)], "doc_id bigint, row bigint, text string")
    got = {(r.doc_id, r.item) for r in K.retrieve(K.document_terms(docs, K.term_filter(postings)), postings, limits).collect()}
    impact = {(r.term, r.item): r.impact for r in postings.collect()}
    want = set()
    for t, text in enumerate(texts):
        term = trigrams(word_hashes([text])[1]).tolist()
        for at in range(0, max(1, len(term)), K.HALF):
            for i, _ in items:
                if sum(impact.get((x, i), 0.0) for x in term[at : at + 2 * K.HALF]) >= 9.0 + i % 3:
                    want.add((t, i))
    assert want == got and want


@pytest.mark.parametrize("kind", ["quotes", "ligatures", "capitals", "cyrillic", "composed", "underscores"])
def test_both_sides_split_words_alike(spark, kind):
    rng = random.Random(len(kind))
    words = [f"{a}{b}" for a in ("größe", "œuvre", "über", "ärger", "naïf", "façade") for b in ("ab", "cd", "ef", "gh", "ij", "kl", "mn")]
    if kind == "cyrillic":
        words = [f"{a}{b}" for a in ("слово", "книга", "город", "земля", "время", "закон") for b in ("ами", "ого", "ему", "ые", "ах", "ия", "юсь")]
    items = [(i, " ".join(rng.choice(words) + "abc"[rng.randrange(3)] for _ in range(60))) for i in range(20)]
    form = {
        "quotes": lambda w: f"\u201c{w}\u201d \u2014" if rng.random() < 0.3 else f"\u00a0{w}\u2026",
        "ligatures": lambda w: w.replace("œ", "Œ"),
        "capitals": str.upper,
        "cyrillic": str.title,
        "composed": lambda w: unicodedata.normalize("NFD", w),
        "underscores": lambda w: f"_{w}_",
    }[kind]
    docs = [(i, _text(rng, 40) + " " + " ".join(form(w) for w in t.split()[10:35]) + " " + _text(rng, 40)) for i, t in items]
    if kind == "capitals":  # the capital of ß is SS: such words are no longer equal
        items = [(i, t.replace("ß", "ss")) for i, t in items]
        docs = [(i, _text(rng, 40) + " " + t.upper() + " " + _text(rng, 40)) for i, t in items]
    assert _leaked(spark, docs, items) == [(i, i) for i, _ in items]


@pytest.mark.parametrize("many", [1, 2, 3, 4, 5])
def test_runs_of_every_length_whatever_the_number_of_items(spark, many):
    rng = random.Random(many)
    own = [" ".join(f"{rng.choice(WORDS)}{i}q{n}" for n in range(90)) for i in range(many)]
    docs = [(n, f"{_text(rng, 30)} {' '.join(own[0].split()[:n])} {_text(rng, 30)}") for n in (12, 19, 20, 25, 30, 80)]
    assert _leaked(spark, docs, list(enumerate(own))) == [(n, 0) for n in (20, 25, 30, 80)]


def test_run_lengths():
    p = [f"w{i}" for i in range(40)]
    assert K.longest_run(p, p) == 40 and K.longest_run(p, []) == 0 and K.longest_run([], p) == 0
    assert K.longest_run(p, p[3:18]) == 15
    assert K.longest_run(p, p[:12] + ["x"] + p[13:25]) == 25
    assert K.longest_run(p, p[:12] + ["put", "in", "here"] + p[12:24]) == 24
    assert K.longest_run(p, [w if i % 3 else "x" for i, w in enumerate(p)]) == 0
    assert K.one_letter_apart("house", "hose") and K.one_letter_apart("house", "houso") and not K.one_letter_apart("house", "horst")


def _fill(sizes, share, cap, total):
    """Plain water-filling by repeated clamping."""
    amount, fixed = {}, set()
    while True:
        left = total - sum(cap[s] for s in fixed)
        open_share = sum(share[s] for s in share if s not in fixed)
        amount = {s: cap[s] if s in fixed else (left * share[s] / open_share if open_share else 0.0) for s in share}
        over = {s for s in share if s not in fixed and share[s] > 0 and amount[s] > cap[s] + 1e-9}
        if not over:
            return amount
        fixed |= over


@pytest.mark.parametrize("seed", range(4))
def test_water_filling_against_repeated_clamping(spark, seed):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(8)]
    sizes = {s: rng.choice([0, 10, 100, 1000, 5000]) for s in names}
    raw = {s: rng.random() for s in names}
    share = {s: x / sum(raw.values()) for s, x in raw.items()}
    cap_n = {s: rng.randint(1, 4) for s in names}
    df = spark.createDataFrame([(s, share[s], cap_n[s], sizes[s]) for s in names], "source string, target_share double, max_repeats int, size bigint")
    total = sum(sizes.values())
    got = {r.source: r.amount for r in M.water_filled(df).collect()}
    want = _fill(sizes, share, {s: float(cap_n[s] * sizes[s]) for s in names}, total)
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, total) for s in names)


def test_mixture_repeats_and_reports(spark):
    docs = spark.createDataFrame([(i, ["Big One", "big_one", " small", "SMALL ", None, "other"][i % 6], 10) for i in range(1200)], "doc_id bigint, source string, tokens bigint").withColumn("epochs", F.lit("clash"))
    targets = spark.createDataFrame([("big_one", 0.5, 3), ("small", 0.5, 1), ("gone", 0.0, 2)], "source string, target_share double, max_repeats int")
    sizes = M.source_sizes(docs, targets)
    assert {r.source: r.size for r in sizes.collect()} == {"big_one": 4000, "small": 4000, "gone": 0}
    plan = M.water_filled(sizes, total=12000)
    out = M.mix_sources(docs, plan).groupBy("source").agg(F.sum("tokens").alias("t"), F.max("copy").alias("c")).collect()
    got = {r.source: (r.t, r.c) for r in out}
    assert got["small"] == (4000, 1) and abs(got["big_one"][0] - 8000) < 400 and got["big_one"][1] == 2
    assert {r.source: r.capped for r in plan.collect()}["small"]
    none = spark.createDataFrame([], "doc_id bigint, source string, tokens bigint")
    assert M.mix_sources(none, M.water_filled(M.source_sizes(none, targets))).count() == 0
    assert M.water_filled(M.source_sizes(docs, targets.limit(0))).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world, hello!"), (2, ""), (3, None), (4, "word " * 50_000)], "i int, text string")
    got = {r.i: r.tokens for r in M.token_counts(df, "text").collect()}
    assert got[1] == 5 and got[2] == 0 and got[3] == 0 and 50_000 <= got[4] <= 50_001


def _speech(rng, level):
    short, long = ["cat", "dog", "run", "sun", "big", "tree"], ["interoperability", "constitutionality", "jurisprudence", "municipalities"]
    out = []
    for _ in range(12):
        out.append(" ".join(rng.choice(long) if rng.random() < level * 0.15 else rng.choice(short) for _ in range(3 + 4 * level)).capitalize() + ".")
    return " ".join(out)


def test_levels_are_learnt(spark):
    rng = random.Random(6)
    truth = {i: rng.randint(1, 5) for i in range(400)}
    docs = [(i, _speech(rng, v), f"s{i % 4}") for i, v in truth.items()] + [(900, None, "s1"), (901, "", None), (902, "too short to count [" + "noise " * 60 + "]", "s2")]
    labels = [(n, i, truth[i] if rng.random() > 0.1 else max(1, truth[i] - 1)) for n, i in enumerate(list(truth)[:250])] + [(999, 3, None), (998, 5, truth[5])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("score", F.lit("clash"))
    ratings = spark.createDataFrame(labels, "label_id bigint, doc_id bigint, reading_level int")
    levels, report = R.reading_levels(R.text_features(d), ratings, d)
    got = {r.id: r.reading_level for r in levels.collect()}
    assert set(got) == set(truth)
    assert np.mean([got[i] == v for i, v in truth.items() if i >= 250]) > 0.8
    assert sum(r.rated for r in report.collect()) == 250 and {r.source for r in report.collect()} == {"s0", "s1", "s2", "s3"}


def test_levels_without_ratings_or_texts(spark):
    d = spark.createDataFrame([(1, _speech(random.Random(1), 2), "s")], "doc_id bigint, text string, source string")
    none = spark.createDataFrame([], "label_id bigint, doc_id bigint, reading_level int")
    levels, report = R.reading_levels(R.text_features(d), none, d)
    assert levels.count() == 0 and report.count() == 0
    empty = d.limit(0)
    assert R.text_features(empty).count() == 0


def test_features_do_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = [_speech(rng, i % 5 + 1) for i in range(20)] + ["", "Ein Satz; noch einer, und der dritte! Art. 5 gilt."]
    words, f = R.measure(texts)
    for i, t in enumerate(texts):
        w1, f1 = R.measure([t])
        assert w1[0] == words[i] and np.allclose(f1[0], f[i])
    last = dict(zip(R.FEATURES, f[-1], strict=True))
    assert words[-1] == 9 and last["sentence_len"] == 4.5 and last["semicolons"] == 0.5 and abs(last["marker_de"] - 2 / 9) < 1e-9


def _plain_longest_run(passage, text, inserted=30):
    """``longest_run`` that looks back over all stretches."""
    pairs = {(j, p) for j in range(len(passage) - 1) for p in range(len(text) - 1) if passage[j : j + 2] == text[p : p + 2]}
    parts = []
    for j, p in pairs:
        if (j - 1, p - 1) not in pairs:
            n = 2
            while (j + n - 1, p + n - 1) in pairs:
                n += 1
            parts.append((j, p, n))
    best, top = [], 0
    for j, p, n in sorted(parts):
        mine = (n, 1, j)
        for (i, q, m), (equal, stretches, begin) in reversed(best):
            gap, extra = j - i - m, p - q - m
            if not (-1 <= gap <= 2 and -1 <= extra <= inserted) or (gap < 0 and extra < gap):
                continue
            alike = 0 < gap <= extra and all(K.one_letter_apart(passage[i + m + g], text[p - gap + g]) for g in range(gap))
            now = (equal + n + (gap if alike else min(gap, 0)), stretches + (not (alike and gap == extra)), begin)
            if now[0] - 4 * now[1] >= mine[0] - 4 * mine[1]:
                mine = now
        best.append(((j, p, n), mine))
        if mine[0] >= 5 * mine[1]:
            top = max(top, j + n - mine[2])
    return top


def test_longest_run_equals_the_plain_one():
    rng = random.Random(8)
    for _ in range(300):
        passage = [f"w{rng.randrange(30)}ord" for _ in range(60)]
        text = []
        for _ in range(4):
            at = rng.randrange(50)
            text += [f"x{rng.randrange(30)}"] * rng.randrange(36) + [w for w in passage[at : at + rng.randrange(3, 30)] if rng.random() < 0.93]
        assert K.longest_run(passage, text) == _plain_longest_run(passage, text)


def test_bound_of_the_run_is_never_too_low():
    rng = random.Random(9)
    for _ in range(300):
        passage = [f"w{rng.randrange(30)}ord" for _ in range(rng.randrange(5, 60))]
        text = []
        for _ in range(4):
            at = rng.randrange(50)
            text += ["x"] * rng.randrange(36) + [w if rng.random() < 0.8 else w + "s" for w in passage[at : at + rng.randrange(3, 30)]]
        run = K.longest_run(passage, text)
        have = set(zip(text, text[1:], strict=False))
        known = np.array([pair in have for pair in zip(passage, passage[1:], strict=False)])
        assert not run or K.may_run(np.tile(known, 2), np.array([0, len(known), 2 * len(known)]), np.array([run, len(passage) + 1])).tolist()[0]


def test_longest_run_of_a_very_long_text():
    passage = [w for i in range(60) for w in ("of", "the", f"n{i}")]
    apart = (["of", "the"] + ["z"] * 40) * 1500  # more words than may be put in: nothing here joins the quotation
    assert K.longest_run(passage, apart + passage[:60] + ["z"] * 40 + apart) == 60
