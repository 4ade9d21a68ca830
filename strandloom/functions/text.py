"""Labels, file names and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions import levels as L

# Fixed value: characters that a file name may not hold.
UNSAFE = ' :/?#=$*[]@|<>"'


def file_name(name: Column) -> Column:
    """A name with every unsafe character as an underscore."""
    return F.translate(name, UNSAFE, "_" * len(UNSAFE))


def short_genome(genus: Column, species: Column, rest: Column, accession: Column, width: int = 25) -> Column:
    """``G.species rest [accession]``, cut to ``width`` with an ellipsis; a null part counts as empty."""
    part = lambda c: F.coalesce(c, F.lit(""))
    name = F.concat(F.substr(part(genus), F.lit(1), F.lit(1)), F.lit("."), part(species), F.lit(" "), part(rest), F.lit(" ["), part(accession), F.lit("]"))
    return F.when(F.length(name) > width, F.concat(F.substr(name, F.lit(1), F.lit(width - 3)), F.lit("..."))).otherwise(name)


def truncated(number: Column, digits: int) -> Column:
    """A number cut, not rounded, to ``digits`` decimals."""
    return (number * 10**digits).cast("bigint") / float(10**digits)


def text_level(value: Column) -> Column:
    """A rank value 0..10 as --, +, ++ or +++ (below 2.5, 5, 7.5, up to 10); null outside."""
    out = F.when((value < 0) | (value > 10), None)
    for bound, text in zip((2.5, 5.0, 7.5), L.TEXT, strict=False):
        out = out.when(value < bound, F.lit(text))
    return out.when(value <= 10, F.lit(L.TEXT[3]))


def ranged(text: Column, low: float, high: float, kind: str = "double") -> Column:
    """A number read from text if it is one within the bounds, else null."""
    n = text.try_cast(kind)
    return F.when((n >= low) & (n <= high), n)


# Spellings of true and false.
TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


def truth(text: Column) -> Column:
    """A boolean from its usual spellings in any case; null for anything else."""
    word = F.lower(F.trim(text.cast("string")))
    return F.when(word.isin(*TRUE), F.lit(True)).when(word.isin(*FALSE), F.lit(False))
