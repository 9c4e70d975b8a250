"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def upper_each(text: Column) -> Column:
    """Upper case character by character, as SQL engines without full case mappings have it: ß gives ẞ, a character whose capital is several stays. For short texts."""
    one = lambda c: F.when(c == "ß", "ẞ").when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def lower_each(text: Column) -> Column:
    """Lower case character by character: İ, the only one that would become two, gives i."""
    return F.lower(F.translate(text, "İ", "i"))


def trim_spaces(text: Column) -> Column:
    """Without Unicode spaces at its ends; tabs and line ends stay."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", "")


def token_text(text: Column) -> Column:
    """Lower case; everything but letters, digits and underscore to one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}_]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(token_text(text), " "), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(collapse(text), " "), lambda w: w != ""))


def tokens_retrieval(text: Column) -> Column:
    """0 for a blank text, else the larger of a quarter of its characters and 1.3 times its words, rounded up."""
    return F.when(F.length(collapse(text)) == 0, 0).otherwise(F.greatest(F.ceil(F.length(text) / 4), F.ceil(words(text) * 13 / 10))).cast("long")


def tokens_document(text: Column) -> Column:
    """The larger of 1.3 times the words, rounded down, and a quarter of the characters, 1 at least."""
    return F.greatest(F.floor(words(text) * 13 / 10), F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


def tokens_message(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def preview(text: Column, size: int = 600) -> Column:
    """The first characters of the collapsed text; the whole text is collapsed only where its head is not enough for them."""
    head = F.ltrim(F.regexp_replace(F.substring(text, 1, size + size // 3), "\\s+", " "))
    return F.when(F.length(head) > size, F.substring(head, 1, size)).otherwise(F.substring(collapse(text), 1, size))


def exact_signal(text: Column) -> Column:
    """Lower case, brackets and braces as parentheses, without white space."""
    return F.regexp_replace(F.translate(F.lower(text), "[]{}", "()()"), "\\s+", "")


def number_fingerprint(text: Column) -> Column:
    """Digit runs as #."""
    return F.regexp_replace(F.lower(collapse(text)), "[0-9]+", "#")


def content_hash(text: Column) -> Column:
    return F.sha2(F.lower(collapse(text)), 256)


def sampled(key: Column, one_in: int = 5) -> Column:
    """Whether the first eight hex digits of the key's SHA-256 are divisible by one_in."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % one_in == 0


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def half_up(value: Column, digits: int) -> Column:
    """Rounding by binary arithmetic only, so that any engine gives the same double."""
    return F.floor(value * 10.0**digits + 0.5) / 10.0**digits
