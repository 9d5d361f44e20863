"""Text features and keyed pseudo-random draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split() treats as whitespace,
# i.e. Unicode White_Space plus U+001C..U+001F. Spark uses Java's Unicode
# class (as fast as ASCII \S); SQL engines without it take the explicit list.
WORD_PATTERN = r"(?U)[^\s\x{1C}-\x{1F}]+"
WHITESPACE_CLASS = (
    r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WORD_PATTERN_EXPLICIT = f"[^{WHITESPACE_CLASS}]+"

# Topic labels of the simulated classifier, in order.
TOPICS = ["technical", "business", "general", "support"]


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words, as ``str.split()`` counts them."""
    return F.regexp_count(c, F.lit(WORD_PATTERN)).cast("long")


def char_count(c: Column) -> Column:
    """Length in characters (code points), not bytes."""
    return F.length(c).cast("long")


def preview_text(c: Column, n: int = 50) -> Column:
    return F.substring(c, 1, n)


def keyed_hash(key: Column, salt: str) -> Column:
    """md5 of ``key|salt`` as 32 hex digits: four independent 32-bit draws.

    The draws depend only on the key, never on partitioning or task order, so
    reruns, retries after a lost executor and the SQL oracle all agree.
    """
    return F.md5(F.concat(key, F.lit("|" + salt)))


def draw(hex_digest: Column, slot: int) -> Column:
    """Uniform [0, 1) from 32-bit slot ``slot`` (0..3) of a keyed hash."""
    part = F.substring(hex_digest, 1 + 8 * slot, 8)
    return F.conv(part, 16, 10).cast("long") / F.lit(4294967296.0)


def uniform(u: Column, low: float, high: float) -> Column:
    return F.lit(low) + F.lit(high - low) * u


def pick(u: Column, choices: list[str]) -> Column:
    """One of ``choices`` with equal chance, from a draw in [0, 1)."""
    idx = F.floor(u * F.lit(len(choices))).cast("int") + F.lit(1)
    return F.element_at(F.array(*[F.lit(x) for x in choices]), idx)
