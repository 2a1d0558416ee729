"""Addresses: street and postcode parts, comparable forms, search links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import drop_punctuation, squeeze, strip

# Abbreviations applied in this order.
REGISTER_STREET_WORDS = [
    ("rue ", "r "), ("straat", "str"), ("avenue ", "av "),
    ("boulevard ", "bd "), ("laan", "ln"), ("place ", "pl "),
    ("plein", "pl"), ("chaussée ", "ch "), ("steenweg", "stw"),
]
PRICE_LIST_STREET_WORDS = [
    ("chaussée", "chau"), ("chaussee", "chau"), ("chau.", "chau"),
    ("avenue", "av"), ("av.", "av"), ("boulevard", "bd"), ("bd.", "bd"),
    ("rue", "r"), ("straat", "str"), ("laan", "ln"), ("place", "pl"), ("plein", "pl"),
    ("saint-", "st-"), ("sint-", "st-"),
    ("belgium", ""), ("belgique", ""), ("belgië", ""),
]
POSTCODE = r"\b(1\d{3})\b"


def _fold(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def street_label(address: Column) -> Column:
    """Text before the first comma without bare numbers; 'Unknown' when there is none."""
    head = strip(F.split_part(address, F.lit(","), F.lit(1)))
    kept = F.array_join(F.filter(F.split(head, r"(?U)\s+"), lambda w: ~w.rlike(r"(?U)^\d*$")), " ")
    return F.when(address.isNull() | (address == ""), F.lit("Unknown")).otherwise(
        F.when(kept == "", head).otherwise(kept)
    )


def postcode(address: Column) -> Column:
    found = F.regexp_extract(address, "(?U)" + POSTCODE, 1)
    return F.when(found != "", found)


def street_name(address: Column) -> Column:
    """Street without postcode tail, house number and trailing comma."""
    out = F.regexp_replace(F.coalesce(address, F.lit("")), r"(?U)\b1\d{3}\b.*$", "")
    out = F.regexp_replace(out, r"(?U)\s+\d+[A-Za-z]?\s*,?\s*$", "")
    return strip(F.regexp_replace(out, r"(?U),\s*$", ""))


def normalise_register_street(street: Column) -> Column:
    out = _fold(strip(F.lower(F.coalesce(street, F.lit("")))), REGISTER_STREET_WORDS)
    return squeeze(drop_punctuation(out))


def normalise_price_address(address: Column) -> Column:
    out = _fold(F.lower(F.coalesce(address, F.lit(""))), PRICE_LIST_STREET_WORDS)
    out = F.regexp_replace(out, r"(?U)\b\d{4}\b", "")
    return squeeze(drop_punctuation(out, " "))


def search_link(prefix: str, *parts: Column) -> Column:
    """Search address with '+' for blanks."""
    query = F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.replace(query, F.lit(" "), F.lit("+")))
