"""Ordered rule lists as one Column: the first rule that hits gives the label."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def any_contains(text: Column, needles: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles], F.lit(False))


def any_regex(text: Column, patterns: Sequence[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return text.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))


def phrase_regex(phrase: str) -> str:
    """The phrase between characters that are not a-z."""
    return r"(^|[^a-z])" + re.escape(phrase) + r"($|[^a-z])"


def hit(text: Column, needles: Sequence[str], mode: str) -> Column:
    if mode == "contains":
        return any_contains(text, needles)
    if mode == "regex":
        return any_regex(text, needles)
    if mode == "phrase":
        return any_regex(text, [phrase_regex(n) for n in needles])
    if mode == "equals":
        return text.isin(list(needles))
    raise ValueError(f"unknown rule mode {mode!r}")


def first_match(text: Column, rules: Iterable[tuple[object, Sequence[str]]], mode: str = "contains") -> Column:
    """``rules`` are (label, needles) in priority order; null when nothing hits."""
    out = None
    for label, needles in rules:
        cond = hit(text, needles, mode)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(None) if out is None else out


def flag(cond: Column) -> Column:
    """Null counts as no."""
    return F.coalesce(cond, F.lit(False))


def label_of(value: Column, mapping: dict[str, str]) -> Column:
    """Look a value up in a small fixed mapping, grouped by label so that it stays a hash test."""
    groups: dict[str, list[str]] = {}
    for key, label in mapping.items():
        groups.setdefault(label, []).append(key)
    return first_match(value, groups.items(), mode="equals")
