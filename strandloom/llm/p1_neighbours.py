"""Problem 1: the most similar vectors of every vector by a permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm import words
from strandloom.llm.levels import ENTRIES, as_binary, as_rows, bit_words, distances, packed_vectors, thermometer, unpacked
from strandloom.llm.permutation import close_pairs, footrule_block, nearest_met, nearest_pivots, posting_keys
from strandloom.llm.runs import by_key, run_bounds, run_pairs, salted, whole_keys
from strandloom.session import cut_lineage, small, table, wide

NEIGHBOURS = 5
LEVEL_LIMIT = 24  # 0.06 of 3 * 136 levels
COSINE_LIMIT = 0.5
FEW = 24  # rows up to which an inverted file is compared pair by pair
CROWD = 4  # pivots within the limit of a pivot from which it stands in a crowd
CROWDED = 32  # rows from which a file of two pivots can tell a crowd of sequences
PART = 8  # in a crowd half of ``CROWDED`` rows at least are close to more than one in ``PART`` of their file
BLOCK = 2048  # rows of an inverted file beyond which it is cut into block pairs
SINGLE = 0xFFFF  # second half of the key of a file of one pivot


def _keys_column(keys: np.ndarray) -> pa.ListArray:
    """Rows of keys as a list column without the -1."""
    keep = keys >= 0
    offsets = np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[keep]))


def nearest_ids(links: DataFrame, points: DataFrame, members: DataFrame, own: float, k: int = NEIGHBOURS) -> DataFrame:
    """Pairs ``(id_a, id_b)``, id_a < id_b, in which one is among the ``k`` nearest of the other.

    ``links(x, y, far)`` are distances between representatives of equal vectors, both ways,
    repeats allowed; ``points(rep, copies)`` has for each representative its smallest k + 1
    ids; ``members(id, rep)`` all ids; ``own`` is the distance between equal vectors. Ties go to
    the smaller id. Links are cut by rank, before the shuffle too, so a representative that is linked to
    all others costs no task a long list; no list here is longer than a few times k + 1 entries,
    however many copies a vector has.
    """
    place = F.dense_rank().over(W.partitionBy("x").orderBy("far", "y"))  # a link that several files gave has one rank
    near = links.withColumn("place", place).where(F.col("place") <= k + 1).select("x", "far", F.col("y").alias("rep")).distinct()
    spread = near.join(points, "rep").select("x", "far", F.explode("copies").alias("id"))
    other = spread.groupBy("x").agg(F.collect_list(F.struct("far", "id")).alias("l"))
    same = F.transform("copies", lambda c: F.struct(F.lit(own).alias("far"), c.alias("id")))
    lists = points.join(other.withColumnRenamed("x", "rep"), "rep", "left").where("l is not null or size(copies) > 1")
    none = F.array().cast("array<struct<far:double,id:bigint>>")
    best = F.slice(F.array_sort(F.concat(same, F.coalesce("l", none))), 1, k + 1)
    each = members.join(lists.select("rep", F.transform(best, lambda s: s["id"]).alias("ids")), "rep")
    chosen = F.slice(F.filter("ids", lambda i: i != F.col("id")), 1, k)
    pair = each.select("id", F.explode(chosen).alias("to"))
    return pair.select(F.least("id", "to").alias("id_a"), F.greatest("id", "to").alias("id_b")).distinct()


def _first_copies(df: DataFrame, key: list[str], k: int = NEIGHBOURS) -> DataFrame:
    """``(*key, rep, copies)``: the smallest k + 1 ids of each key; the rank filter works before the shuffle too."""
    place = F.row_number().over(W.partitionBy(*key).orderBy("id"))
    few = df.select(*key, "id").withColumn("place", place).where(F.col("place") <= k + 1)
    return few.groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("copies")).withColumn("rep", F.col("copies")[0])


def _best_per_row(row: np.ndarray, other: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest (far, other) of every row; a pair that several files gave counts once."""
    at = np.lexsort((other, far, row))
    r, o = row[at], other[at]
    again = np.concatenate([[False], (r[1:] == r[:-1]) & (o[1:] == o[:-1])]) if len(r) else np.zeros(0, bool)
    at, r = at[~again], r[~again]
    start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
    place = np.arange(len(r)) - np.repeat(start, np.diff(np.concatenate([start, [len(r)]])))
    return at[place < k]


def _best_in_file(at: slice, ids: np.ndarray, side: np.ndarray, k: int, distance) -> list[np.ndarray]:
    """``(row, other, distance)`` of the k nearest others of every row of one inverted file, in blocks of bounded size.

    ``distance(lo, hi)`` gives the distances of the file's rows lo..hi to all its rows and which of them count. Of two blocks of
    a hot file only rows of different blocks are paired. Ties go to the smaller id.
    """
    n, own, rank = at.stop - at.start, side[at], np.argsort(np.argsort(ids[at]))
    of_rank = at.start + np.argsort(rank)
    mixed = own.max() == 1 and own.min() == 0
    none = np.iinfo(np.int32).max
    out = []
    step = max(1, 1_000_000 // n)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        far, ok = distance(lo, hi)
        ok[np.arange(hi - lo), np.arange(lo, hi)] = False
        if mixed:
            ok &= own[lo:hi, None] != own[None, :]
        score = np.where(ok, far.astype(np.int32) * n + rank[None, :], none)
        best = np.partition(score, k - 1, axis=1)[:, :k] if n > k else score
        row, col = np.nonzero(best != none)
        hit = best[row, col]
        out.append(np.stack([at.start + lo + row, of_rank[hit % n], hit // n]))
    return out


def _countable(near: np.ndarray, hot: np.ndarray, side: np.ndarray, pivot: int, rows: np.ndarray, cols: np.ndarray, pivots: int) -> np.ndarray:
    """Which pairs of ``rows`` and ``cols`` of the file of one ``pivot`` count there.

    They belong to different blocks if the file holds two, and share no hot pivot of a smaller number: every pair counts in one file only.
    """
    ok = rows[:, None] != cols[None, :]
    if side.max() == 1 and side.min() == 0:
        ok &= side[rows, None] != side[None, cols]
    before = np.where(hot & (near < pivot), near, -1)
    has = np.zeros((pivots + 1, len(cols)), bool)
    for i in range(near.shape[1]):
        has[before[cols, i], np.arange(len(cols))] = True
    has[pivots] = False  # row -1: no pivot
    for i in range(near.shape[1]):
        if (before[rows, i] >= 0).any():
            ok &= ~has[before[rows, i]]
    return ok


def _dots(word_of: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, exact: type) -> np.ndarray:
    """Dot products of the word counts of rows ``left`` with rows ``right`` (None: of ``left`` with itself, the diagonal left out).

    Words that many rows have are laid out as columns of a matrix product, a bounded number at a time; for the others each pair of rows
    that shares a word adds its product. Both are sums of whole numbers that ``exact`` holds.
    """
    n = len(word_of)
    counts = [np.unique(w, return_counts=True) for w in word_of]
    row = np.repeat(np.arange(n), [len(w) for w, _ in counts])
    word = np.concatenate([w for w, _ in counts]).astype(np.int64)
    count = np.concatenate([c for _, c in counts]).astype(exact)
    rows_of = np.bincount(word, minlength=words.WORDS)
    out = np.zeros((len(left), len(left if right is None else right)), exact)
    many = np.flatnonzero(rows_of > max(16, n // 10))
    column = np.full(words.WORDS, -1)
    for at in range(0, len(many), 2048):
        column[:] = -1
        column[many[at : at + 2048]] = np.arange(len(many[at : at + 2048]))
        c = column[word]
        table = np.zeros((n, min(2048, len(many) - at)), exact)
        table[row[c >= 0], c[c >= 0]] = count[c >= 0]
        out += table[left] @ (table[left] if right is None else table[right]).T
    few = (rows_of[word] > 1) & (rows_of[word] <= max(16, n // 10))
    row, word, count = row[few], word[few], count[few]
    by = np.argsort(word, kind="stable")
    row, word, count = row[by], word[by], count[by]
    bounds = run_bounds(word) if len(word) else np.zeros(1, np.int64)
    spent = np.cumsum(np.diff(bounds) ** 2)
    place = np.zeros(n, np.int64)
    place[left] = np.arange(len(left))
    is_right = np.zeros(n, bool)
    if right is not None:
        place[right], is_right[right] = np.arange(len(right)), True
    start = 0
    while start < len(bounds) - 1:
        stop = max(start + 1, int(np.searchsorted(spent, (spent[start - 1] if start else 0) + 4_000_000, "right")))
        lo, hi = bounds[start], bounds[stop]
        i, j = run_pairs(bounds[start : stop + 1] - lo, np.ones(stop - start, bool))
        i, j = i + lo, j + lo
        if right is None:
            product = count[i] * count[j]
            np.add.at(out, (place[row[i]], place[row[j]]), product)
            np.add.at(out, (place[row[j]], place[row[i]]), product)
        else:
            two = is_right[row[i]] != is_right[row[j]]
            i, j = i[two], j[two]
            turn = is_right[row[i]]
            i, j = np.where(turn, j, i), np.where(turn, i, j)
            np.add.at(out, (place[row[i]], place[row[j]]), count[i] * count[j])
        start = stop
    return out


def _best_cosines(rows: pa.Table, near: np.ndarray, pivots: int, limit: float, k: int) -> list[np.ndarray]:
    """``(row, other, -cosine)`` of the k nearest others of every row of the file of one pivot, whose rows are sorted by id."""
    side, norm = (rows.column(c).to_numpy() for c in ("side", "norm"))
    pivot, bits = rows.column("file")[0].as_py() >> 16, rows.column("hot").to_numpy()
    hot = (bits[:, None] >> np.arange(near.shape[1]) & 1).astype(bool)
    data, n, breaks = (rows.column(c).to_pylist() for c in ("bases", "n", "breaks"))
    exact = np.float32 if norm.max() < 2**24 else np.float64
    mixed = side.max() == 1 and side.min() == 0
    left = np.flatnonzero(side == 0) if mixed else np.arange(len(side))
    right = np.flatnonzero(side == 1) if mixed else left
    dots = _dots([_count_words(*x) for x in zip(data, n, breaks, strict=True)], left, right if mixed else None, exact)
    size = norm.astype(np.float64)
    out = []
    for mine, others, table in [(left, right, dots), (right, left, dots.T)][: 2 if mixed else 1]:
        step = max(1, 1_000_000 // len(others))
        for lo in range(0, len(mine), step):
            some = mine[lo : lo + step]
            ok = _countable(near, hot, side, pivot, some, others, pivots)
            far = -table[lo : lo + step].astype(np.float64) / np.sqrt(size[some, None] * size[None, others])
            far = np.where(ok & (far <= -limit), far, np.inf)
            every = np.arange(len(some))
            for _ in range(min(k, len(others))):
                at = far.argmin(1)  # of equal ones the first, which has the smallest id
                best = far[every, at]
                has = np.isfinite(best)
                if not has.any():
                    break
                out.append(np.stack([some[has], others[at[has]], best[has]]))
                far[every, at] = np.inf
    return out


def level_pivots(rows: int) -> int:
    """Pivots for a number of distinct level vectors: the root of 6 * rows, so that files and the cost of indexing grow alike."""
    return min(16_384, max(64, math.isqrt(6 * rows)))


def level_neighbours(vectors: DataFrame, pivots: int | None = None, depth: int = 8, prefix: int = 4, reach: int = 24, most_footrule: int = 68, k: int = NEIGHBOURS, limit: int = LEVEL_LIMIT) -> DataFrame:
    """Neighbour pairs of level vectors ``(id, vec)`` (see ``levels.packed_vectors``) within ``limit`` level steps.

    The pivots are ``pivots`` (by default ``level_pivots``) vectors of smallest hash, a bounded sample; every distinct vector
    is indexed. Nearness to a pivot is the distance less the pivot's mean distance to the 20 pivots nearest to it, or a pivot in the middle of a
    crowd would be nearest to all of it. Vectors that share two of their ``prefix`` nearest pivots share an inverted file, in which those
    within a footrule of ``most_footrule`` are reranked by their exact distance. A pivot with ``CROWD`` others
    within the limit stands in a crowd, where permutations say little: each of the vectors that have it among their
    ``reach`` nearest is posted under it alone, and such a file is reranked whole. Equal vectors are one point with its smallest ids.
    Fewer vectors than pivots, ties, repeats and no rows at all are fine.
    """
    vectors = cut_lineage(vectors)
    points = cut_lineage(_first_copies(vectors, ["vec"], k))
    pivots = pivots or level_pivots(points.count())
    sample = points.select("vec").orderBy(F.xxhash64(F.lit(1), "vec"), "vec").limit(pivots).collect()  # bounded by `pivots`
    if not sample:
        return vectors.sparkSession.createDataFrame([], "id_a bigint, id_b bigint")
    pivot_bytes = np.frombuffer(b"".join(bytes(r[0]) for r in sample), np.uint8).reshape(len(sample), -1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = thermometer(unpacked(pivot_bytes))
        ones = pivot.sum(1)
        apart = np.sort(distances(pivot, pivot), axis=1)
        crowd = (apart <= limit).sum(1) > CROWD
        some = min(20, len(pivot) - 1)
        own = apart[:, 1 : some + 1].sum(1, dtype=np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                t = thermometer(unpacked(as_rows(part.column(1), ENTRIES // 4)))
                gap = (t.sum(1)[:, None] + ones[None, :] - 2 * (t @ pivot.T)).astype(np.int32)
                order = nearest_pivots(some * 3 * ENTRIES + 1 + own[None, :] - some * gap, reach)
                far = np.take_along_axis(gap, order.astype(np.int64) % len(pivot), 1)  # -1: any, there is no pivot
                alone = (order >= 0) & crowd[order] & (far <= limit * 3 // 2)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), as_binary(np.ascontiguousarray(order[:, :depth]).view(np.uint8)), _keys_column(posting_keys(order, prefix, alone))], ["id", "vec", "pivots", "keys"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches):
            keys, files, side, ids = (rows.column(c).to_numpy() for c in ("key", "file", "side", "id"))
            levels = unpacked(as_rows(rows.column("vec"), ENTRIES // 4))
            order = as_rows(rows.column("pivots"), 2 * depth).view(np.int16)
            bounds = run_bounds(keys)
            few = np.diff(bounds) <= FEW
            found = [np.zeros((3, 0), np.int64)]
            small_files = np.flatnonzero(np.repeat(few, np.diff(bounds)))
            if len(small_files):
                bits = bit_words(levels[small_files])
                for i, j, _ in close_pairs(keys[small_files], side[small_files], order[small_files], most_footrule):
                    far = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
                    ok = far <= limit
                    i, j, far = small_files[i[ok]], small_files[j[ok]], far[ok]
                    found.append(np.stack([np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([far, far])]))
            for r in np.flatnonzero(~few):
                at = slice(bounds[r], bounds[r + 1])
                o, t, whole = order[at], thermometer(levels[at]), files[bounds[r]] & 0xFFFF == SINGLE

                def distance(lo: int, hi: int, o: np.ndarray = o, t: np.ndarray = t, whole: bool = whole) -> tuple[np.ndarray, np.ndarray]:
                    far = distances(t[lo:hi], t)
                    ok = far <= limit
                    return far, ok if whole else ok & (footrule_block(o[lo:hi], o, len(pivot_bytes)) <= most_footrule)

                found += _best_in_file(at, ids, side, k + 1, distance)
            x, y, far = np.concatenate(found, 1)
            best = _best_per_row(ids[x], ids[y], far, k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[x[best]]), pa.array(ids[y[best]]), pa.array(far[best].astype(np.float64))], ["x", "y", "far"])

    indexed = cut_lineage(wide(points.select(F.col("rep").alias("id"), "vec")).mapInArrow(index, "id bigint, vec binary, pivots binary, keys array<bigint>"))
    posted = salted(indexed.select(F.explode("keys").alias("key"), "id", "vec", "pivots").withColumn("file", F.col("key")), "key", "id", BLOCK)
    links = by_key(posted).mapInArrow(rerank, "x bigint, y bigint, far double")
    members = vectors.join(points.select("vec", "rep"), "vec").select("id", "rep")
    return nearest_ids(links, points.select("rep", "copies"), members, 0.0, k)


def sequence_pivots(rows: int) -> int:
    """Pivots for a number of sequences: 4,096, doubled with every fourfold number of rows beyond 200,000, at most 16,384."""
    return min(16_384, 4096 * 2 ** max(0, math.ceil(math.log(max(rows, 1) / 200_000, 4))))


def sequence_sketches(records: DataFrame, pivots: int = 4096, depth: int = 12, seed: int = 11) -> DataFrame:
    """Index rows of sequences ``(id, seq)``: vector hash, nearest pivots, the vector's square and the bases at two bits each.

    A pivot is a vector of equal weight, but for a few thousandths, on a random group of words; the groups divide all
    words, so nearness to all pivots is one sum over a record's words. The small differences are random per word and decide between
    pivots that a record meets equally often; a fixed order of pivots would make a few of them nearest to all short records.
    The vector hash is a sum of random numbers of the words: equal for equal count vectors, also of the other strand.
    Records without a word have no row.
    """
    rng = np.random.default_rng(seed)
    group = np.append(rng.permutation(words.WORDS) % pivots, pivots).astype(np.int32)
    salt = np.ascontiguousarray(np.vstack([rng.integers(0, 2**63, (words.WORDS, 2), np.int64), np.zeros((1, 2), np.int64)]).T)
    weight = np.append(4096 + rng.integers(0, 64, words.WORDS), 0)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                good, lengths, breaks = words.bases(part.column(1).to_pylist())
                word, ok = words.words_of(good, breaks)
                n = len(lengths)
                ends = np.cumsum(lengths)
                rec = np.repeat(np.arange(n), lengths)[: len(word)]
                word, rec = word[ok], rec[ok]
                have = np.bincount(rec, minlength=n) > 0
                if not have.any():
                    continue
                code = np.sort(rec.astype(np.int32) << 16 | word)  # 64 rows, 16 bits a word
                bounds = run_bounds(code)
                count = np.diff(bounds)
                at_rec, at_word = code[bounds[:-1]] >> 16, code[bounds[:-1]] & 0xFFFF
                first = np.searchsorted(at_rec, np.flatnonzero(have))
                norm = np.add.reduceat(count * count, first)
                h1, h2 = (np.add.reduceat(count * one[at_word], first) for one in salt)
                order = nearest_met(at_rec, group[at_word], count * weight[at_word], n, pivots, depth)
                data, offsets = words.two_bits(good, lengths)
                starts = ends - lengths
                inner = breaks[~np.isin(breaks, starts) & (breaks < len(good))]
                owner = np.searchsorted(ends, inner, "right")
                cut_offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
                cols = [
                    part.column(0).filter(pa.array(have)),
                    pa.array(h1),
                    pa.array(h2),
                    as_binary(order[have].view(np.uint8)),
                    pa.array(norm.astype(np.int64)),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).filter(pa.array(have)),
                    pa.array(lengths[have].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(cut_offsets), pa.array((inner - starts[owner]).astype(np.int32))).filter(pa.array(have)),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["id", "h1", "h2", "pivots", "norm", "bases", "n", "breaks"])

    return records.mapInArrow(sketch, "id bigint, h1 bigint, h2 bigint, pivots binary, norm bigint, bases binary, n int, breaks array<int>")


def _count_words(data: bytes, n: int, breaks: list[int]) -> np.ndarray:
    word, ok = words.words_of(words.from_two_bits(data, n), np.array(breaks, np.int64))
    return word[ok]


def crowded_pivots(keyed: DataFrame, depth: int, most_footrule: int) -> list[int]:
    """Pivots of the files of two pivots that hold a crowd, from ``keyed(id, pivots, keys)`` (see ``sequence_neighbours``); at most one entry per pivot."""

    def close_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches):
            keys, side = rows.column("key").to_numpy(), rows.column("side").to_numpy()
            order = as_rows(rows.column("pivots"), 2 * depth).view(np.int16)
            close = np.zeros(len(keys), np.int64)
            for i, j, _ in close_pairs(keys, side, order, most_footrule):
                close += np.bincount(i, minlength=len(keys)) + np.bincount(j, minlength=len(keys))
            yield pa.RecordBatch.from_arrays([rows.column(c).combine_chunks() for c in ("file", "id")] + [pa.array(close)], ["file", "id", "close"])

    first, second = F.shiftright("file", 16), F.col("file").bitwiseAND(F.lit(SINGLE))
    files = keyed.select("id", "pivots", F.explode("keys").alias("file"))
    long = cut_lineage(files.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > CROWDED) & (second != SINGLE)))
    if long.isEmpty():
        return []
    some = salted(files.join(small(long.select("file"), 100_000), "file", "left_semi").withColumn("key", F.col("file")), "key", "id", BLOCK)
    near = by_key(some.select("key", "side", "file", "id", "pivots")).mapInArrow(close_rows, "file bigint, id bigint, close bigint").groupBy("file", "id").agg(F.sum("close").alias("close"))
    crowds = near.join(small(long, 100_000), "file").where(F.col("close") * PART > F.col("n")).groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 2 >= CROWDED)
    return [r[0] for r in crowds.select(F.explode(F.array(first, second))).distinct().collect()]


def sequence_neighbours(records: DataFrame, pivots: int | None = None, depth: int = 12, prefix: int = 6, reach: int = 10, most_footrule: int = 108, k: int = NEIGHBOURS, limit: float = COSINE_LIMIT) -> DataFrame:
    """Neighbour pairs of sequences ``(id, seq)`` with a word-count cosine of at least ``limit``.

    Every distinct count vector is indexed. Vectors that share two of their ``prefix`` nearest pivots share an inverted file; those within a
    footrule distance of ``most_footrule`` are candidates, all of which are reranked by the exact
    cosine. One of more than ``CROWDED`` rows, many of which are close to more than one in ``PART`` of it, tells that its pivots stand in a crowd of
    variants, whose permutations differ by chance. All that have a pivot of a crowd among their ``reach`` nearest are posted under it
    alone, and this file is reranked whole, by blocks inside the task, where only the best of each row leave it. A file that is long only because
    the rows are many, or because words of its pivots overlap, holds rows that share little else: no crowd, but a file like any other.
    Equal count vectors are one point with its smallest ids. Null and empty sequences and
    those without a word take no part; repeats and ties are fine.
    """
    named = records.select("id", "seq").where("id is not null and seq is not null")
    pivots = pivots or sequence_pivots(named.count())
    sketches = cut_lineage(sequence_sketches(wide(named), pivots, depth))
    points = cut_lineage(_first_copies(sketches, ["h1", "h2"], k))
    reps = cut_lineage(sketches.select("id", "pivots").join(points.select(F.col("rep").alias("id")), "id", "left_semi"))

    def post(batches: Iterator[pa.RecordBatch], is_hot: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = as_rows(batch.column(1), 2 * depth).view(np.int16)
            alone = np.zeros(order.shape, bool)
            if is_hot is not None:
                alone[:, :reach] = is_hot[order[:, :reach]]
            hot = (alone[:, :reach].astype(np.int32) << np.arange(reach)).sum(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hot), _keys_column(posting_keys(order, prefix, alone))], ["id", "pivots", "hot", "keys"])

    def posted_to(is_hot: np.ndarray | None) -> DataFrame:
        return cut_lineage(reps.mapInArrow(lambda b: post(b, is_hot), "id bigint, pivots binary, hot int, keys array<bigint>"))

    keyed = posted_to(None)
    hot_pivots = crowded_pivots(keyed, depth, most_footrule)
    if hot_pivots:
        is_hot = np.zeros(pivots + 1, bool)
        is_hot[hot_pivots] = True
        keyed = posted_to(is_hot)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches):
            keys, ids = rows.column("key").to_numpy(), rows.column("id").to_numpy()
            order = as_rows(rows.column("pivots"), 2 * depth).view(np.int16)
            found = [np.zeros((2, 0), np.int64), *(ids[np.stack([i, j])] for i, j, _ in close_pairs(keys, rows.column("side").to_numpy(), order, most_footrule))]
            pairs = np.unique(np.sort(np.concatenate(found, 1), axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches):
            bounds = run_bounds(rows.column("key").to_numpy())
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo < 2:
                    continue
                file = rows.slice(lo, hi - lo).sort_by("id")
                ids, order = file.column("id").to_numpy(), as_rows(file.column("pivots"), 2 * depth).view(np.int16)
                found = _best_cosines(file, order[:, :reach], pivots, limit, k + 1)
                x, y, far = np.concatenate([np.zeros((3, 0)), *found], 1)
                x, y = ids[x.astype(np.int64)], ids[y.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(far)], ["x", "y", "far"])

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            dot = np.zeros(batch.num_rows)
            last, count = None, None
            for r, (a, da, na, ba, db, nb, bb) in enumerate(zip(rows["a"], rows["da"], rows["na"], rows["ba"], rows["db"], rows["nb"], rows["bb"], strict=True)):
                if a != last:
                    last, count = a, np.bincount(_count_words(da, na, ba), minlength=words.WORDS)
                dot[r] = int(count[_count_words(db, nb, bb)].sum())
            far = -dot / np.sqrt(np.array(rows["sa"], np.float64) * np.array(rows["sb"], np.float64))
            ok = far <= -limit
            a, b = np.array(rows["a"], np.int64)[ok], np.array(rows["b"], np.int64)[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a])), pa.array(np.concatenate([far[ok], far[ok]]))], ["x", "y", "far"])

    posted = keyed.select(F.explode("keys").alias("key"), "id", "pivots")
    single = F.col("key").bitwiseAND(F.lit(SINGLE)) == SINGLE
    paired = salted(posted.where(~single), "key", "id", BLOCK)
    pairs = cut_lineage(by_key(paired).mapInArrow(candidates, "a bigint, b bigint").distinct())
    crowded = cut_lineage(salted(posted.where(single).select("key", "id", F.col("key").alias("file")), "key", "id", BLOCK))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    body = cut_lineage(sketches.select("id", "norm", "bases", "n", "breaks").join(needed, "id", "left_semi"))
    side = lambda s: body.select(F.col("id").alias(s), F.col("norm").alias(f"s{s}"), F.col("bases").alias(f"d{s}"), F.col("n").alias(f"n{s}"), F.col("breaks").alias(f"b{s}"))
    full = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb", "da", "na", "ba", "db", "nb", "bb")
    links = full.mapInArrow(cosines, "x bigint, y bigint, far double")
    if not crowded.isEmpty():
        laid = crowded.join(keyed.select("id", "pivots", "hot"), "id").join(sketches.select("id", "norm", "bases", "n", "breaks"), "id")
        links = links.unionByName(by_key(laid).mapInArrow(compare, "x bigint, y bigint, far double"))
    members = sketches.join(points.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep")
    return nearest_ids(links, points.select("rep", "copies"), members, -1.0, k)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of level vectors and of sequences in which one is among the 5 nearest of the other."""
    values = level_neighbours(packed_vectors(table(spark, d, "wdb_values"), "value_id", "level_values"))
    seqs = sequence_neighbours(table(spark, d, "fasta_records").select(F.col("record_id").alias("id"), "seq"))
    name = lambda df, field: df.select(F.lit(field).alias("field_name"), "id_a", "id_b")
    return name(values, "values").unionByName(name(seqs, "seq"))
