from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import p1_neighbours as P
from strandloom.llm import permutation, words
from strandloom.llm.levels import packed_vectors, parse_levels

CODES = ["000", "001", "011", "111"]


def _near(v, cut, dist, k=5):
    """Brute-force pairs: ids -> vectors."""
    out = set()
    ids = sorted(v)
    for a in ids:
        best = sorted((dist(v[a], v[b]), b) for b in ids if b != a)
        out |= {(min(a, b), max(a, b)) for d, b in [x for x in best if x[0] <= cut][:k]}
    return out


def _level_rows(n, groups, noise, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 4, (groups, 136))
    rows = {}
    for i in range(n):
        v = centres[rng.integers(groups)].copy()
        for j in rng.choice(136, rng.integers(0, noise + 1), replace=False):
            v[j] = min(3, max(0, v[j] + rng.choice([-1, 1])))
        rows[i * 3] = v
    return rows


def _frame(spark, rows, extra=()):
    data = [(i, [CODES[x] for x in v], "x") for i, v in rows.items()] + [(*e, "x") for e in extra]
    return spark.createDataFrame(data, "value_id bigint, level_values array<string>, vec string")


@pytest.mark.parametrize("block", [2048, 16])
def test_level_neighbours_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rows = _level_rows(260, 9, 8)
    rows[1000] = rows[1001] = rows[0].copy()
    extra = [(5000, None), (5001, []), (None, CODES)]
    got = {(r.id_a, r.id_b) for r in P.level_neighbours(packed_vectors(_frame(spark, rows, extra), "value_id", "level_values"), pivots=64).collect()}
    want = _near({i: v.astype(int) for i, v in rows.items()}, 24, lambda a, b: int(np.abs(a - b).sum()))
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_copies_beyond_any_list_length(spark):
    rows = {i: np.full(136, 1) for i in range(300)}  # one vector only
    got = {(r.id_a, r.id_b) for r in P.level_neighbours(packed_vectors(_frame(spark, rows), "value_id", "level_values")).collect()}
    want = {(a, b) for b in range(300) for a in [x for x in range(7) if x != b][:5] if a < b} | {(b, a) for b in range(300) for a in [x for x in range(7) if x != b][:5] if b < a}
    assert got == want


def test_no_vectors(spark):
    assert P.level_neighbours(packed_vectors(_frame(spark, {}), "value_id", "level_values")).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (3, "ACG"), (None, "ACGTACGTAA")], "id bigint, seq string")
    assert P.sequence_neighbours(none).count() == 0


def test_entries_in_every_spelling():
    got = parse_levels(pa.array([["111", "-2", " 1", "2", None, "nan", "x"], None, []] + [["001"] * 140]))
    assert got[0, :7].tolist() == [3, 0, 2, 3, 0, 0, 0] and got[1].sum() == 0 and got[3].sum() == 136


def _counts(seq):
    t = "".join(seq.split()).upper()
    comp = str.maketrans("ACGT", "TGCA")
    out: dict = {}
    for i in range(len(t) - 7):
        w = t[i : i + 8]
        if set(w) <= set("ACGT"):
            w = min(w, w.translate(comp)[::-1])
            out[w] = out.get(w, 0) + 1
    return out


def _cosine(a, b):
    dot = sum(x * b.get(w, 0) for w, x in a.items())
    return -dot / (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5


def _mutate(s, rate, rng):
    return "".join(rng.choice("ACGT") if rng.random() < rate else c for c in s)


@pytest.mark.parametrize("block", [2048, 8])
def test_sequence_neighbours_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(2)
    base = ["".join(rng.choice("ACGT") for _ in range(rng.randint(300, 900))) for _ in range(25)]
    rows = {}
    for i in range(150):
        s = _mutate(rng.choice(base), rng.choice([0, 0.005, 0.01]), rng)
        if i % 7 == 0:
            s = s[:100].lower() + "\n " + s[100:]
        if i % 11 == 0:
            s = s.translate(str.maketrans("ACGT", "TGCA"))[::-1]  # the other strand
        if i % 13 == 0:
            s = s[:200] + "NNNN|--" + s[200:]
        rows[i * 2] = s
    rows |= {1001: "ACG", 1003: "", 1005: "N" * 50, 1007: "é" * 20}
    df = spark.createDataFrame([(i, s, "clash") for i, s in rows.items()] + [(None, "ACGTACGTACGT", ""), (2001, None, "")], "id bigint, seq string, far string")
    got = {(r.id_a, r.id_b) for r in P.sequence_neighbours(df).collect()}
    vec = {i: c for i, s in rows.items() if (c := _counts(s))}
    want = _near(vec, -0.5, _cosine)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


@pytest.mark.parametrize("block", [2048, 100])
def test_sequence_neighbours_in_one_cluster_of_distinct_variants(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(1500))
    rows = {i: _mutate(base, 0.01, rng) for i in range(500)} | {i: "".join(rng.choice("ACGT") for _ in range(1500)) for i in range(500, 1500)}
    got = {(r.id_a, r.id_b) for r in P.sequence_neighbours(spark.createDataFrame(list(rows.items()), "id bigint, seq string")).collect()}
    count = np.zeros((500, words.WORDS), np.float64)
    for i in range(500):
        good, _, breaks = words.bases([rows[i]])
        word, ok = words.words_of(good, breaks)
        count[i] = np.bincount(word[ok], minlength=words.WORDS)
    norm = (count**2).sum(1)
    far = -(count @ count.T) / np.sqrt(norm[:, None] * norm[None])
    np.fill_diagonal(far, np.inf)
    want = {(min(i, int(j)), max(i, int(j))) for i in range(500) for j in np.argsort(far[i], kind="stable")[:5]}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(got)


def test_words_of_a_batch_match_single_texts():
    texts = ["ACGTTGCAAC", "", "acgn\tACGTACGTA", "A|CGTACGTACGT", "NNNN"]
    good, lengths, breaks = words.bases(texts)
    word, ok = words.words_of(good, breaks)
    rec = np.repeat(np.arange(len(texts)), lengths)[: len(word)]
    for i, t in enumerate(texts):
        assert sorted(np.unique(word[ok & (rec == i)], return_counts=True)[1].tolist()) == sorted(_counts(t).values())
    data, offsets = words.two_bits(good, lengths)
    for i, n in enumerate(lengths):
        assert (words.from_two_bits(data[offsets[i] : offsets[i + 1]].tobytes(), n) == good[lengths[:i].sum() :][:n]).all()


def test_footrule_forms_agree():
    rng = np.random.default_rng(3)
    order = np.array([rng.permutation(20)[:6] for _ in range(40)], np.int16)
    order[0, 3:] = -1
    block = permutation.footrule_block(order, order, 20)
    i, j = np.divmod(np.arange(1600), 40)
    assert (permutation.footrule(order[i], order[j]) == block.ravel()).all()
    assert block[1, 1] == 0 and block.max() <= 42


def _recall(got, near, ids):
    """Share of the true pairs of a sample that are found; ``near`` are (smaller is nearer) distances of the sample to all, inf beyond the limit."""
    hit = total = 0
    for i, row in ids:
        row = near(i, row)
        best = [j for j in np.argsort(row, kind="stable")[: P.NEIGHBOURS] if np.isfinite(row[j])]
        total += len(best)
        hit += sum((min(i, j), max(i, j)) in got for j in best)
    return hit / total


@pytest.mark.parametrize(("n", "length", "share"), [(1500, 1000, 0.04), (1500, 300, 0.01), (1500, 1000, 0.01), (2600, 300, 0.02)])
def test_recall_in_a_star_of_variants(spark, n, length, share):
    rng = np.random.default_rng(n + length)
    base = rng.integers(0, 4, length)
    rows, table = [], np.zeros((n, words.WORDS), np.float32)
    for i in range(n):
        seq, off = base.copy(), rng.random(length) < share
        seq[off] = (seq[off] + rng.integers(1, 4, off.sum())) % 4
        rows.append((i, "".join("ACGT"[b] for b in seq)))
        good, _, breaks = words.bases([rows[-1][1]])
        word, ok = words.words_of(good, breaks)
        table[i] = np.bincount(word[ok], minlength=words.WORDS)
    got = {(r.id_a, r.id_b) for r in P.sequence_neighbours(spark.createDataFrame(rows, "id bigint, seq string")).collect()}
    sample = rng.choice(n, 200, replace=False)
    norm = (table.astype(np.float64) ** 2).sum(1)
    dots = (table[sample] @ table.T).astype(np.float64)

    def near(i, row):
        far = -dots[row] / np.sqrt(norm[i] * norm)
        far[(far > -P.COSINE_LIMIT) | (np.arange(n) == i)] = np.inf
        return far

    assert _recall(got, near, [(int(i), r) for r, i in enumerate(sample)]) >= 0.95


@pytest.mark.parametrize("others", [0, 3000])
def test_recall_in_a_crowd_of_level_vectors(spark, others):
    rng = np.random.default_rng(7 + others)
    n = 3000
    levels = np.repeat(rng.integers(0, 4, 136)[None], n, 0)
    levels = np.clip(levels + (rng.random(levels.shape) < 0.06) * rng.choice([-1, 1], levels.shape), 0, 3)
    levels = np.concatenate([levels, rng.integers(0, 4, (others, 136))])
    got = {(r.id_a, r.id_b) for r in P.level_neighbours(packed_vectors(_frame(spark, dict(enumerate(levels))), "value_id", "level_values")).collect()}
    sample = rng.choice(n, 200, replace=False)

    def near(i, row):
        far = np.abs(levels - levels[i]).sum(1).astype(float)
        far[(far > P.LEVEL_LIMIT) | (np.arange(len(far)) == i)] = np.inf
        return far

    assert _recall(got, near, [(int(i), r) for r, i in enumerate(sample)]) >= 0.95


@pytest.mark.parametrize("mixed", [False, True])
def test_dots_of_a_file_equal_plain_ones(mixed):
    rng = np.random.default_rng(4)
    bag = [rng.choice(words.WORDS if i % 3 else 40, 60) for i in range(90)]
    table = np.stack([np.bincount(w, minlength=words.WORDS) for w in bag])
    left = np.arange(0, 90, 2) if mixed else np.arange(90)
    right = np.arange(1, 90, 2) if mixed else None
    want = table[left] @ table[left if right is None else right].T
    got = P._dots(bag, left, right, np.float32)
    if not mixed:
        np.fill_diagonal(want, 0)
        np.fill_diagonal(got, 0)
    assert (got == want).all()


@pytest.mark.parametrize("pivots", [5, 300])
def test_nearness_in_parts_gives_the_same_order(pivots):
    rng = np.random.default_rng(3)
    row, pivot, near = rng.integers(0, 40, 3000), rng.integers(0, pivots, 3000), rng.integers(1, 60, 3000)
    row[row == 7] = 8  # a row without parts
    dense = np.zeros((40, pivots), np.int64)
    np.add.at(dense, (row, pivot), near)
    assert (permutation.nearest_met(row, pivot, near, 40, pivots, 12) == permutation.nearest_pivots(dense, 12)).all()
    assert (permutation.nearest_met(row[:0], pivot[:0], near[:0], 2, pivots, 12) == -1).all()


@pytest.mark.parametrize("block", [2048, 40])
def test_a_long_file_is_a_crowd_only_if_its_rows_are_close(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = np.random.default_rng(5)
    by_chance = [[1, 2, *(3000 + rng.permutation(9000)[:10])] for _ in range(150)]  # two common pivots, nothing else
    variants = [[11, 12, *(20 + rng.permutation(14)[:10])] for _ in range(150)]
    order = np.array(by_chance + variants, np.int16)
    keys = permutation.posting_keys(order, 6)
    data = [(i, bytearray(o.tobytes()), [int(x) for x in k if x >= 0]) for i, (o, k) in enumerate(zip(order, keys, strict=True))]
    hot = P.crowded_pivots(spark.createDataFrame(data, "id bigint, pivots binary, keys array<bigint>"), 12, 108)
    assert {11, 12} <= set(hot) and not {1, 2} & set(hot)
