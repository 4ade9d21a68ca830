"""Problem 6: evaluation passages that stand in training text."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.codewords import bigrams, trigrams, word_hashes, word_list
from strandloom.operators.ranking import global_rank
from strandloom.session import cut_lineage, small, table, wide

RUN = 20  # words of a passage that must stand in a document
HALF = 32  # words of half a query passage
INSERTED = 30  # words that may be put in between two equal stretches
STRETCH = 5  # words of equal stretches on average
BLOCK_ITEMS = 8  # items per block of the inverted index
MOST_POSTINGS = 500_000  # postings up to which the index is broadcast; a longer one is joined by a shuffle
BITS = 24  # bits of a term's number that the filter of terms looks at
K1, B = 1.2, 0.75
# The words that open the question line of an item.
QUESTION = re.compile(r"\n\s*(?:Question|Frage)\s*:")


def question_split(text: str) -> tuple[str, str]:
    """Passage and question of an item; the question may be missing."""
    at = QUESTION.search(text)
    return (text[: at.start()], text[at.end() :]) if at else (text, "")


def least_score(impacts: np.ndarray, run: int) -> float:
    """The least score that ``longest_run`` chains of ``run`` words of an item (or all of a shorter one) have in their best passage.

    ``impacts`` are those of the trigrams at all places of the item. A chain of s equal stretches has at most two other words
    and ``INSERTED`` words of text between two of them; the trigrams that are left score at least the sum of
    the item's smallest impacts, and as many passages as the chain can extend over share it. Words one letter
    apart are counted as equal ones here.
    """
    length = len(impacts) + 2
    sums = np.concatenate([[0.0], np.cumsum(np.sort(impacts))])
    found = np.inf
    for s in range(1, length // STRETCH + 1):
        equal = max(STRETCH * s, min(run, length) - 2 * (s - 1))
        halves = -(-(equal + INSERTED * (s - 1) - 1) // HALF) + 1
        found = min(found, sums[equal - 2 * s] / -(-halves // 2))
    return float(found) * (1 - 1e-9)


def _item_rows(items: DataFrame) -> DataFrame:
    """``(item_id, words, pairs, terms, question)``: passage words, hashes of each two and three in a row, and of the question's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, pairs, terms, questions = [], [], [], []
            for text in batch.column(1).to_pylist():
                passage, question = question_split(text)
                words.append(word_list(passage))
                hashed = word_hashes([passage])[1]
                pairs.append(bigrams(hashed))
                terms.append(trigrams(hashed))
                questions.append(np.unique(word_hashes([question])[1]).view(np.int64))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string())), *(pa.array(x, kind) for x in (pairs, terms, questions))], ["item_id", "words", "pairs", "terms", "question"])

    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id bigint, words array<string>, pairs array<bigint>, terms array<bigint>, question array<bigint>")


def item_postings(passages: DataFrame) -> DataFrame:
    """``(term, block, item, tf, impact)``: the BM25 inverted index of ``passages(item, words, terms)``, all statistics over all of them.

    Blocks hold ``BLOCK_ITEMS`` items of about one length, so of like limits.
    """
    n, average = passages.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    tf = passages.select("item", F.size("words").alias("n"), F.explode("terms").alias("term")).groupBy("item", "n", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    order = global_rank(passages.select("item", F.size("words").alias("n")), [F.col("n"), F.col("item")], "r")
    block = order.select("item", F.floor((F.col("r") - 1) / BLOCK_ITEMS).alias("block"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.lit(max(1.0, average or 1.0))))
    return tf.join(df, "term").join(block, "item").select("term", "block", "item", "tf", (idf * weight).alias("impact"))


def item_limits(postings: DataFrame, run: int = RUN) -> DataFrame:
    """``(item, block, need)``: the score from which a passage of a document is looked at, what a leak of the item scores at least."""

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = [least_score(np.array(x), run) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(need, pa.float64())], ["item", "block", "need"])

    # one passage's words are what a row gathers
    each = postings.groupBy("item", "block").agg(F.flatten(F.collect_list(F.array_repeat("impact", F.col("tf")))).alias("impacts"))
    return each.mapInArrow(needs, "item bigint, block bigint, need double")


def term_filter(terms: DataFrame) -> np.ndarray:
    """Which values of a term's first ``BITS`` bits occur: 2 MB however many terms there are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for x in batch.column(1).to_pylist():
                one = np.zeros(4096, bool)
                one[x] = True
                bits.append(np.packbits(one).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["chunk", "bits"])

    first = F.shiftrightunsigned("term", 64 - BITS)
    chunks = terms.select(F.shiftright(first, 12).alias("chunk"), first.bitwiseAND(F.lit(4095)).alias("at")).groupBy("chunk").agg(F.collect_set("at").alias("at"))
    out = np.zeros((1 << BITS) // 4096 * 512, np.uint8)
    for r in chunks.mapInArrow(pack, "chunk bigint, bits binary").collect():  # at most 4,096 rows of 512 bytes
        out[r["chunk"] * 512 : (r["chunk"] + 1) * 512] = np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(out).astype(bool)


def document_terms(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """``(doc_id, row, half, term)``: trigrams of the documents ``(doc_id, row, text)`` that may be an item's, and their half passage."""
    packed = np.packbits(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(packed).astype(bool)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                doc, h = word_hashes(part.column(2).to_pylist())
                if len(h) < 3:
                    continue
                term = trigrams(h)
                ok = (doc[:-2] == doc[2:]) & keep[(term.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)]
                place = np.flatnonzero(ok)
                doc_of = doc[place]
                half = (place - np.searchsorted(doc, doc_of)) // HALF
                take = pa.array(doc_of)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(half.astype(np.int32)), pa.array(term[place])], ["doc_id", "row", "half", "term"])

    return docs.mapInArrow(run, "doc_id bigint, row bigint, half int, term bigint")


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole runs of (doc_id, row), and the number of each row's run."""
    rest: pa.Table | None = None
    for batch in _and_end(batches):
        if batch is not None:
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
        if rest is None or not rest.num_rows:
            continue
        doc, row = rest.column("doc_id").to_numpy(), rest.column("row").to_numpy()
        edge = np.flatnonzero((doc[1:] != doc[:-1]) | (row[1:] != row[:-1])) + 1
        cut = len(doc) if batch is None else int(edge[-1]) if len(edge) else 0
        if cut:
            yield rest.slice(0, cut), np.searchsorted(edge, np.arange(cut), "right")
            rest = rest.slice(cut)


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _reaching(run: np.ndarray, half: np.ndarray, group: np.ndarray, weight: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Rows in a half that belongs, as first or second, to a passage whose ``weight`` of the row's ``group`` sums to its ``need``."""
    kinds, group = np.unique(group, return_inverse=True)
    least = np.zeros(len(kinds))
    least[group] = need
    code = (run * (int(half.max()) + 2) + half) * len(kinds) + group  # a text's last half is never followed by another text's first
    have, inverse = np.unique(code, return_inverse=True)
    own = np.bincount(inverse, weights=weight, minlength=len(have))
    behind = np.minimum(np.searchsorted(have, have + len(kinds)), len(have) - 1)
    total = own + np.where(have[behind] == have + len(kinds), own[behind], 0.0)
    good = have[total >= least[have % len(kinds)]]
    return np.isin(code, good) | np.isin(code - len(kinds), good)


def _beside(rows: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with a part of the index: a broadcast up to ``MOST_POSTINGS`` entries, which leaves the rows of a document together, else a shuffle back to them."""
    if index.limit(MOST_POSTINGS + 1).count() <= MOST_POSTINGS:
        return rows.join(F.broadcast(index), keys)
    return rows.join(index, keys).repartition("doc_id", "row").sortWithinPartitions("doc_id", "row")


def retrieve(terms: DataFrame, postings: DataFrame, limits: DataFrame) -> DataFrame:
    """``(doc_id, row, item)`` of which some passage of the document scores at least the item's ``need``.

    ``terms`` as of ``document_terms``, the rows of a document one behind the other. Passages are all windows of two halves of ``HALF`` words. Pruning as in
    block-max WAND, for many passages at once: the blocks' greatest impacts are summed per block of items, and only postings of terms and blocks
    in passages that can reach a limit are scored. A bound is never less than the score, so nothing
    above a limit is lost.
    """
    entry = F.struct("item", F.col("impact").alias("weight"), "need")
    # a block's entries of a term are at most ``BLOCK_ITEMS``
    blocks = postings.join(limits.select("item", "need"), "item").groupBy("term", "block").agg(F.max("impact").alias("best"), F.collect_list(entry).alias("entries"))
    blocks = cut_lineage(blocks.join(limits.groupBy("block").agg(F.min("need").alias("least")), "block"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, run in _whole_documents(batches):
            half, block, best, least = (rows.column(c).to_numpy() for c in ("half", "block", "best", "least"))
            able = np.flatnonzero(_reaching(run, half.astype(np.int64), block, best, least))
            if not len(able):
                continue
            entries = rows.column("entries").take(pa.array(able)).combine_chunks()
            at = np.repeat(able, entries.value_lengths().to_numpy())
            item, weight, need = (entries.flatten().field(c).to_numpy() for c in ("item", "weight", "need"))
            ok = np.flatnonzero(_reaching(run[at], half[at].astype(np.int64), item, weight, need))
            if not len(ok):
                continue
            first = ok[np.unique(np.stack([run[at[ok]], item[ok]]), axis=1, return_index=True)[1]]
            source = rows.select(["doc_id", "row"]).take(pa.array(at[first])).combine_chunks()
            yield pa.RecordBatch.from_arrays([source.column(0).combine_chunks(), source.column(1).combine_chunks(), pa.array(item[first])], ["doc_id", "row", "item"])

    scored = _beside(terms, blocks, ["term"]).select("doc_id", "row", "half", "block", "best", "least", "entries")
    return scored.mapInArrow(score, "doc_id bigint, row bigint, item bigint")


def one_letter_apart(a: str, b: str) -> bool:
    """Whether two words are equal up to one letter changed, left out or put in."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def longest_run(passage: list[str], text: list[str], inserted: int = INSERTED) -> int:
    """Words of the longest stretch of ``passage`` that stands in ``text`` in order.

    Equal stretches of two words or more are chained if between them at most two words of the passage
    differ, or up to ``inserted`` words are put in; a word that is one letter apart counts as equal. A
    chain counts only if its equal stretches hold, on average, at least five words: sentences of the
    same build about other names break more often. Returns 0 if no chain counts.
    """
    where = defaultdict(list)
    for j in range(len(passage) - 1):
        where[passage[j], passage[j + 1]].append(j)
    open_: dict[int, int] = {}  # diagonals of stretches that the word before belongs to, and their first text word
    parts = []
    for p, pair in enumerate(zip(text, text[1:], strict=False)):
        at = where.get(pair)
        if at is None and not open_:
            continue
        now = {}
        for j in at or ():
            now[j - p] = open_.pop(j - p, p)
        parts += [(d + q, q, p - q + 1) for d, q in open_.items()]
        open_ = now
    parts += [(d + q, q, len(text) - q) for d, q in open_.items()]
    parts.sort()
    best: list[tuple[int, int, int]] = []  # equal words, stretches, first passage word
    ended: dict[int, dict[int, list[int]]] = {}  # stretches by their end in the passage and, in buckets as wide as a gap may be, in the text
    width = inserted + 2
    top = 0
    for y, (j, p, n) in enumerate(parts):
        mine = (n, 1, j)
        near = [x for e in range(j - 2, j + 2) if (at := ended.get(e)) for b in (p // width - 1, p // width, p // width + 1) for x in at.get(b, ())]
        for x in sorted(near, reverse=True):
            i, q, m = parts[x]
            gap, extra = j - i - m, p - q - m
            if not (-1 <= gap <= 2 and -1 <= extra <= inserted) or (gap < 0 and extra < gap):
                continue
            equal, stretches, begin = best[x]
            alike = 0 < gap <= extra and all(one_letter_apart(passage[i + m + g], text[p - gap + g]) for g in range(gap))
            if alike and gap == extra:
                now = (equal + n + gap, stretches, begin)
            else:
                now = (equal + n + (gap if alike else min(gap, 0)), stretches + 1, begin)
            if now[0] - 4 * now[1] >= mine[0] - 4 * mine[1]:
                mine = now
        best.append(mine)
        ended.setdefault(j + n, {}).setdefault((p + n) // width, []).append(y)
        if mine[0] >= 5 * mine[1]:
            top = max(top, j + n - mine[2])
    return top


def may_run(known: np.ndarray, begins: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether ``longest_run`` can reach ``need`` words, for many passages at once: a cheap bound, never too low.

    ``known`` tells for all pairs of words of all passages in a row whether the text has the pair, ``begins`` where each passage begins (and the
    end). All words of a chain but at most two in a row belong to a pair of the passage that stands somewhere in the text.
    """
    at = np.flatnonzero(known)
    owner = np.searchsorted(begins, at, "right") - 1
    new = np.concatenate([[True], (np.diff(at) > 4) | (np.diff(owner) > 0)]) if len(at) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    stop = np.concatenate([start[1:], [len(at)]]).astype(np.int64) - 1
    long = at[stop] + 2 - at[start] >= need[owner[start]] if len(at) else np.zeros(0, bool)
    out = np.zeros(len(begins) - 1, bool)
    out[owner[start[long]]] = True
    return out


def able_pairs(pairs: DataFrame, run: int = RUN) -> DataFrame:
    """``(doc_id, row, item)`` of ``pairs(doc_id, row, text, item, pairs)`` that pass ``may_run``; texts of many pairs are split once a batch."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                doc, row = part.column(0).to_numpy(), part.column(1).to_numpy()
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])
                text_of, h = word_hashes(part.column(2).filter(pa.array(new)).to_pylist())
                have = bigrams(h)[text_of[:-1] == text_of[1:]] if len(h) > 1 else np.zeros(0, np.int64)
                salt = np.uint64(0x9E3779B97F4A7C15)
                own = have.view(np.uint64) + text_of[:-1][text_of[:-1] == text_of[1:]].astype(np.uint64) * salt if len(h) > 1 else have.view(np.uint64)
                size = part.column(4).value_lengths().to_numpy()
                begins = np.concatenate([[0], np.cumsum(size)])
                asked = part.column(4).flatten().to_numpy().view(np.uint64) + np.repeat((np.cumsum(new) - 1).astype(np.uint64) * salt, size)
                ok = may_run(np.isin(asked, own), begins, np.minimum(run, size + 1))
                yield part.select(["doc_id", "row", "item"]).filter(pa.array(ok))

    return pairs.select("doc_id", "row", "text", "item", "pairs").mapInArrow(bound, "doc_id bigint, row bigint, item bigint")


def verified(pairs: DataFrame, run: int = RUN) -> DataFrame:
    """``(doc_id, row, item, run_words, have)`` of ``pairs(doc_id, row, text, item, words)`` whose text holds the passage or ``run`` words of it.

    ``have`` are the hashes of the text's words. Whole texts are compared, word by word.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, have, last, words = [], [], None, []
            for at, (text, passage) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if text != last:
                    last, words = text, word_list(text)
                n = longest_run(passage, words)
                if n and n >= min(run, len(passage)):
                    rows.append((at, n))
                    have.append(np.unique(word_hashes([text])[1]).view(np.int64))
            at, n = zip(*rows, strict=True) if rows else ((), ())
            take = pa.array(at, pa.int64())
            out = [*(batch.column(c).take(take) for c in (0, 1, 3)), pa.array(n, pa.int32()), pa.array(have, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "row", "item", "run_words", "have"])

    return pairs.select("doc_id", "row", "text", "item", "words").mapInArrow(check, "doc_id bigint, row bigint, item bigint, run_words int, have array<bigint>")


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """``(doc_id, item_id, run_words, question_words)``: documents that hold an item's passage or ``run`` words of it in a row.

    Every document is cut into overlapping passages, which query the inverted index of the items; what scores at least a
    share of the least score that a leak of that item can have is verified word by word over the whole text. A shorter passage must
    stand there whole; one of fewer than five words is never found (see ``longest_run``). Items of one passage are indexed once.
    ``question_words`` is the share of the question's words found in the text, 0 without a question.
    Both sides are split alike: letters and digits of any script, composed, in lower case. Items are a table like any other: none but
    counts, one limit and a filter of fixed size reach the driver, and the corpus passes once through the index however many there are. Null
    texts and ids have no row, repeated documents each their own; no items or no documents give no rows.
    """
    rows = cut_lineage(_item_rows(items).withColumn("k1", F.xxhash64("words")).withColumn("k2", F.xxhash64(F.lit(1), "words")))
    passages = cut_lineage(rows.where(F.size("terms") > 0).groupBy("k1", "k2").agg(F.min("item_id").alias("item"), F.first("words").alias("words"), F.first("pairs").alias("pairs"), F.first("terms").alias("terms")))
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    postings = cut_lineage(item_postings(passages))
    limits = cut_lineage(item_limits(postings, run))
    if limits.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, run_words int, question_words double")
    terms = document_terms(wide(texts), term_filter(postings))
    found = cut_lineage(retrieve(terms, postings, limits))
    copies = rows.join(passages.select("k1", "k2", "item"), ["k1", "k2"]).select("item", "item_id", "question")
    with_text = lambda df: wide(texts).join(small(df, MOST_POSTINGS), ["doc_id", "row"])
    able = cut_lineage(able_pairs(with_text(found).join(small(passages.select("item", "pairs"), 10_000), "item"), run).distinct())
    pairs = with_text(able).join(small(passages.select("item", "words"), 10_000), "item")
    shared = F.size(F.array_intersect("question", "have")) / F.size("question")
    asked = F.when(F.size("question") > 0, shared).otherwise(F.lit(0.0))
    return verified(pairs, run).join(small(copies, 10_000), "item").select("doc_id", "item_id", "run_words", asked.alias("question_words"))


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the length of the run and the share of the question's words in the document."""
    return leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items found in them."""
    return p6_leaks(spark, d).select("doc_id", "item_id").distinct()
