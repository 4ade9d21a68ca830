"""Sequence and word functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digit order of the first and the second half of a word in coordinates.
X_LETTERS, Y_LETTERS = "TCAG", "AGTC"


def clean_seq(seq: Column) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(seq, r"\s+", ""))


def reverse_complement(seq: Column) -> Column:
    """Upper case, reversed, A-T and C-G exchanged, everything else N."""
    return F.translate(F.regexp_replace(F.reverse(F.upper(seq)), "[^ACGT]", "N"), "ACGT", "TGCA")


def _padded(word: Column) -> Column:
    return F.when(F.length(word) % 2 == 1, F.concat(word, F.substr(word, F.lit(1), F.lit(1)))).otherwise(word)


def _digits(text: Column, letters: str, weight) -> Column:
    n = F.length(text)
    one = lambda acc, i: acc + (F.instr(F.lit(letters), F.substr(text, i + 1, F.lit(1))) - 1) * F.pow(F.lit(4), weight(i, n)).cast("int")
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(1), one)


def word_x(word: Column) -> Column:
    """x of a word of A, C, G, T with at least two letters (odd lengths are padded with their first letter)."""
    v = _padded(word)
    return _digits(F.substr(v, F.lit(1), (F.length(v) / 2).cast("int")), X_LETTERS, lambda i, n: i)


def word_y(word: Column) -> Column:
    """y of a word."""
    v = _padded(word)
    p = (F.length(v) / 2).cast("int")
    return _digits(F.substr(v, p + 1, p), Y_LETTERS, lambda i, n: n - 1 - i)


def word_at(k: Column, x: Column, y: Column) -> Column:
    """The word at coordinates; null if they are out of range or contradict the padding of an odd length."""
    p = ((k + 1) / 2).cast("int")
    side = F.pow(F.lit(4), p).cast("int")
    at = lambda v, letters, shift: F.substr(F.lit(letters), (F.floor((v - 1) / F.pow(F.lit(4), shift)) % 4 + 1).cast("int"), F.lit(1))
    first = F.array_join(F.transform(F.sequence(F.lit(0), p - 1), lambda i: at(x, X_LETTERS, i)), "")
    second = F.array_join(F.transform(F.sequence(F.lit(0), p - 1), lambda j: at(y, Y_LETTERS, p - 1 - j)), "")
    v = F.concat(first, second)
    fits = (k % 2 == 0) | (F.substr(v, F.length(v), F.lit(1)) == F.substr(v, F.lit(1), F.lit(1)))
    return F.when((x >= 1) & (y >= 1) & (x <= side) & (y <= side) & fits, F.substr(v, F.lit(1), k))


def linear_index(x: Column, y: Column) -> Column:
    """Position in the upper triangle, (y-1)y/2 + x-1; -1 unless 1 <= x <= y."""
    return F.when((x >= 1) & (x <= y), ((y - 1) * y / 2 + x - 1).cast("bigint")).otherwise(F.lit(-1).cast("bigint"))


def windows(text: Column, m: int) -> Column:
    """All sub-words of length ``m`` in order; none for shorter or null texts."""
    last = F.length(text) - m + 1
    none = F.array().cast("array<string>")
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(m)))).otherwise(none)


def substitutions(word: Column) -> Column:
    """All words one substitution away, the word itself left out."""
    letters = F.array(*[F.lit(c) for c in "ACGT"])
    at = F.sequence(F.lit(1), F.length(word))
    each = F.flatten(F.transform(at, lambda i: F.transform(letters, lambda c: F.concat(F.substr(word, F.lit(1), i - 1), c, F.substr(word, i + 1, F.length(word))))))
    return F.filter(F.array_distinct(each), lambda w: w != word)


def shifts(word: Column, left: bool = False) -> Column:
    """The four words that a frame shift by one letter can give."""
    n = F.length(word)
    letters = F.array(*[F.lit(c) for c in "ACGT"])
    if left:
        return F.transform(letters, lambda c: F.concat(c, F.substr(word, F.lit(1), n - 1)))
    return F.transform(letters, lambda c: F.concat(F.substr(word, F.lit(2), n - 1), c))


def _letters() -> Column:
    return F.array(*[F.lit(c) for c in "ACGT"])


def expanded(word: Column) -> Column:
    """All words that a word with N stands for, N read as each of the four letters; null for null."""
    one = lambda c: F.when(F.upper(c) == "N", _letters()).otherwise(F.array(F.upper(c)))
    each = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: one(F.substr(word, i, F.lit(1))))
    grown = lambda acc, x: F.flatten(F.transform(acc, lambda w: F.transform(x, lambda c: F.concat(w, c))))
    return F.when(F.length(word) > 0, F.aggregate(each, F.array(F.lit("")), grown))


def words_at_distance(word: Column, low: int, high: int) -> Column:
    """All words whose number of differing letters from ``word`` lies in [low, high], in alphabetical order.

    Substitutions are applied ``high`` times over; each round keeps a word once, so the lists grow with the number of such words.
    """
    if not 0 <= low <= high:
        raise ValueError("bounds are not in order")
    near = F.array(word)
    for _ in range(high):
        near = F.array_distinct(F.concat(near, F.flatten(F.transform(near, substitutions))))
    return F.array_sort(F.filter(near, lambda w: mismatches(word, w).between(low, high)))


def shifts_within(word: Column, most: int, left: bool = False) -> Column:
    """All words that frame shifts by 1 to ``most`` letters to one side can give, each once."""
    last, out = F.array(word), None
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, lambda w: shifts(w, left))))
        out = last if out is None else F.array_distinct(F.concat(out, last))
    return out if out is not None else F.array().cast("array<string>")


def extensions(word: Column, left: bool = False) -> Column:
    """The four words one letter longer."""
    return F.transform(_letters(), lambda c: F.concat(c, word) if left else F.concat(word, c))


def deletions(word: Column) -> Column:
    """The different words that the loss of one letter leaves, none for words of fewer than two letters."""
    at = F.sequence(F.lit(1), F.length(word))
    lost = F.transform(at, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, F.length(word))))
    return F.when(F.length(word) > 1, F.array_distinct(lost)).otherwise(F.array().cast("array<string>"))


def joined_words(a: Column, b: Column) -> Column:
    """The shortest word that begins with ``a`` and ends with ``b``: they overlap as far as they agree."""
    n = F.least(F.length(a), F.length(b))
    fits = F.filter(F.sequence(F.lit(0), n), lambda i: F.substr(a, F.length(a) - i + 1, i) == F.substr(b, F.lit(1), i))
    return F.concat(a, F.substr(b, F.array_max(fits) + 1, F.length(b)))


def mismatches(a: Column, b: Column) -> Column:
    """Differing letters; for unequal lengths the least over all placements of the shorter word."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n = F.length(short)

    def at(start: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + (F.substr(short, i, F.lit(1)) != F.substr(long, start + i, F.lit(1))).cast("int"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.length(long) - n), at))


def mismatch_places(a: Column, b: Column) -> Column:
    """1-based places at which two words of one length differ; null for different lengths."""
    at = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) > 0, at).otherwise(F.array().cast("array<int>")))


def folded(x: Column, y: Column) -> tuple[Column, Column]:
    """Coordinates folded into the lower triangle: (y, x) where x > y."""
    return F.least(x, y), F.greatest(x, y)


def count_word(seq: Column, word: Column, both: str | None = None) -> Column:
    """Overlapping occurrences of a word of letters; ``both`` = max, min or average combines the word with its reverse complement. Null for an empty word."""

    # a match of nothing before each occurrence: overlapping ones count, in one pass of the regex engine
    def occurrences(w: Column) -> Column:
        return F.when(F.length(w) > 0, F.regexp_count(seq, F.concat(F.lit("(?="), w, F.lit(")"))))

    if both is None:
        return occurrences(word)
    a, b = occurrences(word), occurrences(reverse_complement(word))
    if both not in ("max", "min", "average"):
        raise ValueError(f"unknown method {both}")
    return {"max": F.greatest(a, b), "min": F.least(a, b), "average": (a + b) / 2}[both]


def deplete(seq: Column, target: int, chunks: int) -> Column:
    """``chunks`` evenly spaced near-equal chunks of together ``target`` bases; every second one reverse-complemented.

    Sequences up to ``target`` are divided whole. Gaps before, between and behind the chunks are equal, the
    first ones longer by the remainder.
    """
    if chunks <= 0 or target < 0:
        raise ValueError("chunks must be positive and target not negative")
    if target < chunks:
        raise ValueError("target must be at least chunks")
    n = F.length(seq)
    kept = F.least(n, F.lit(target))
    gap = n - kept
    size, more = F.floor(kept / chunks), kept % chunks
    space, extra = F.floor(gap / (chunks + 1)), gap % (chunks + 1)

    def piece(i: Column) -> Column:
        before = i * size + F.least(i, more)
        spaces = F.when(gap > 0, (i + 1) * space + F.least(i + 1, extra)).otherwise(0)
        part = F.substr(seq, (before + spaces + 1).cast("int"), (size + (i < more).cast("int")).cast("int"))
        return F.when(i % 2 == 1, reverse_complement(part)).otherwise(part)

    return F.when(seq.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), piece), ""))


def circular_slice(seq: Column, start: Column, length: Column) -> Column:
    """``length`` bases from 0-based ``start``, around the end if need be (length up to the sequence's)."""
    return F.substr(F.concat(seq, seq), (start + 1).cast("int"), length.cast("int"))
