"""Rule tables: what a text is, from features that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, list[str]]]


def holds(features: Column, names: list[str]) -> Column:
    """Whether all named features hold, and those with a minus before their name don't; always, where none is named."""
    c = F.lit(True)
    for n in names:
        c = c & (~features[n[1:]] if n.startswith("-") else features[n])
    return c


def decide(features: dict[str, Column], rules: Rules, default: str) -> Column:
    """The class of the first rule that holds, else the default. A class may have several rules. The features are one struct, so however many rules name one, it is worked out once; a null feature doesn't hold."""
    bound = F.array(F.struct(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in features.items()]))

    def chosen(f: Column) -> Column:
        c = F.lit(default)
        for name, needs in reversed(rules):
            c = F.when(holds(f, needs), name).otherwise(c)
        return c

    return F.get(F.transform(bound, chosen), 0)


def any_of(text: Column, words: list[str]) -> Column:
    """Whether any of the words is in the text, in one pass."""
    return text.rlike("|".join(f"\\Q{w}\\E" for w in words))


def any_form(text: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns is met, in one pass."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def times(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
