"""Name normalising, language guess and identity markers, all as native expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import any_contains, first_match, flag, let

# What a plain strip() treats as blank.
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Words and endings removed before names are compared.
NAME_ENDINGS = [" restaurant", " café", " cafe", " bar", " brasserie", " bistro", " kitchen"]
COMPANY_WORDS = [
    "bvba", "sprl", "sa", "nv", "bv", "srl",
    "restaurant", "resto", "brasserie", "cafe", "café",
    "bistro", "taverne", "snack", "frituur", "friture",
]
PRICE_LIST_WORDS = ["restaurant", "brasserie", "cafe", "café", "bistro", "bar", "the", "le", "la", "l'", "de", "du"]

# Language cues, tried in this order after the Arabic letter range.
LANGUAGE_CUES = [
    ("tr", ["ğ", "ş", "ı", "ü", "ö", "ç"]),
    ("nl", ["lekker", "eten", "goed", "leuk", "mooi", "deze", "heel", "erg"]),
    ("fr", ["très", "était", "nous", "avec", "pour", "mais", "sont", "cette", "leur"]),
    ("pt", ["muito", "bom", "não", "está", "são", "uma", "boa"]),
    ("es", ["muy", "está", "pero", "una", "los", "las", "por", "con"]),
    ("de", ["sehr", "ist", "und", "das", "ein", "für", "auch", "war"]),
    ("it", ["molto", "sono", "questo", "una", "con", "che", "anche"]),
    ("en", ["the", "and", "was", "very", "good", "food", "great", "nice"]),
]

# Letters that point to one language, then letters that are only a hint.
UNIQUE_LETTERS = [
    ("Turkish", "şğıİ"),
    ("Vietnamese", "ăđơưảãạằẳẵắặầẩẫấậẻẽẹềểễếệỉĩịỏõọồổỗốộờởỡớợủũụừửữứựỳỷỹỵ"),
    ("Polish", "ąćęłńśźż"),
    ("Romanian", "șț"),
]
HINT_LETTERS = [("Turkish", "öü"), ("Portuguese", "ãõ")]

# Flag signs and the kitchen they stand for.
FLAG_SIGNS = {
    "🇹🇷": "Turkish",
    "🇧🇷": "Brazilian",
    "🇬🇷": "Greek",
    "🇨🇳": "Chinese",
    "🇮🇹": "Italian",
    "🇮🇳": "Indian",
    "🇯🇵": "Japanese",
    "🇰🇷": "Korean",
    "🇻🇳": "Vietnamese",
    "🇹🇭": "Thai",
    "🇱🇧": "Lebanese",
    "🇲🇦": "Moroccan",
    "🇵🇹": "Portuguese",
    "🇪🇸": "Spanish",
    "🇵🇱": "Polish",
    "🇷🇴": "Romanian",
    "🇷🇺": "Russian",
    "🇺🇦": "Ukrainian",
    "🇵🇰": "Pakistani",
    "🇧🇩": "Bangladeshi",
    "🇪🇹": "Ethiopian",
    "🇨🇩": "Congolese",
    "🇸🇳": "Senegalese",
    "🇵🇪": "Peruvian",
    "🇲🇽": "Mexican",
    "🇦🇷": "Argentinian",
}

# Family-style names, first hit wins.
FAMILY_NAMES = [
    ("chez", r"^chez\s+\w+"),
    ("maison", r"^(la\s+)?maison\s+(de\s+)?\w+"),
    ("au_tradition", r"^au\s+(bon|vieux|petit)\s+"),
    ("bij", r"^bij\s+\w+"),
    ("t_diminutive", r"^'?t\s+\w+"),
    ("family_title", r"\b(mama|papa|nonna|oma|opa)\b"),
]

FRY_SHOP_WORDS = ["frit", "frituur", "friture", "fritkot", "friterie"]
PROMO_WORDS = ["best", "top", "#1", "near", "famous"]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def squeeze(text: Column) -> Column:
    """Collapse runs of blanks and strip."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def drop_punctuation(text: Column, by: str = "") -> Column:
    return F.regexp_replace(text, r"(?U)[^\w\s]", by)


def key_name(name: Column) -> Column:
    return strip(F.lower(name))


def normalise_quotes(name: Column) -> Column:
    """Lower case, no apostrophes, hyphens as blanks."""
    out = F.lower(F.coalesce(name, F.lit("")))
    for old, new in (("'", ""), ("-", " "), ("  ", " ")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return strip(out)


def normalise_endings(name: Column) -> Column:
    """Cut each known ending once, in order, then keep letters, digits and blanks."""
    out = key_name(F.coalesce(name, F.lit("")))
    for ending in NAME_ENDINGS:
        out = F.regexp_replace(out, ending + r"\z", "")
    return F.regexp_replace(out, r"[^\p{L}\p{N} ]", "")


def normalise_company(name: Column) -> Column:
    """Remove company forms and venue words next to a blank, then punctuation."""
    out = key_name(F.coalesce(name, F.lit("")))
    for word in COMPANY_WORDS:
        out = F.replace(F.replace(out, F.lit(f" {word}"), F.lit("")), F.lit(f"{word} "), F.lit(""))
    return squeeze(drop_punctuation(out))


def normalise_words(name: Column) -> Column:
    """Remove whole articles and venue words, then punctuation."""
    out = F.lower(F.coalesce(name, F.lit("")))
    out = F.regexp_replace(out, r"(?U)\b(?:" + "|".join(PRICE_LIST_WORDS) + r")\b", "")
    return squeeze(drop_punctuation(out))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    src, dst = [], []
    for code in range(0xC0, 0x10000):
        ch = chr(code)
        if not unicodedata.decomposition(ch) or unicodedata.decomposition(ch).startswith("<"):
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def strip_accents(text: Column) -> Column:
    src, dst = _accent_table()
    bare = F.regexp_replace(F.translate(text, src, dst), r"\p{Mn}", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), bare).otherwise(text)


def plain_name(name: Column) -> Column:
    """Without accents, lower case, stripped; empty for null."""
    return strip(F.lower(strip_accents(F.coalesce(name, F.lit("")))))


def guess_language(text: Column) -> Column:
    def by_cue(low: Column) -> Column:
        out = F.when(low.rlike("[؀-ۿ]"), F.lit("ar"))
        for lang, cues in LANGUAGE_CUES:
            out = out.when(any_contains(low, cues), F.lit(lang))
        return out.otherwise(F.lit("other"))

    return F.when(text.isNull() | (text == ""), F.lit("unknown")).otherwise(let(F.lower(text), by_cue))


@lru_cache(maxsize=1)
def _compositions() -> list[tuple[str, str]]:
    letters = "".join(s for _, s in UNIQUE_LETTERS + HINT_LETTERS)
    pairs: dict[str, str] = {}
    for ch in dict.fromkeys(letters + letters.upper()):
        full = unicodedata.normalize("NFD", ch)
        if len(full) > 1:
            pairs[full] = ch
            step = "".join(chr(int(p, 16)) for p in unicodedata.decomposition(ch).split())
            pairs[step] = ch
    return sorted(pairs.items(), key=lambda p: -len(p[0]))


def _composed(name: Column) -> Column:
    """Join combining marks to their letter, only for names that carry any."""
    table = F.lit(" ".join(f"{old}>{new}" for old, new in _compositions()))
    fixed = F.aggregate(
        F.split(table, " "),
        name,
        lambda acc, s: F.replace(acc, F.split_part(s, F.lit(">"), F.lit(1)), F.split_part(s, F.lit(">"), F.lit(2))),
    )
    return F.when(name.rlike(r"\p{Mn}"), fixed).otherwise(name)


def _letters(text: str) -> Column:
    """Constant array of the letters, made from one string."""
    return F.split(F.lit(" ".join(dict.fromkeys(text))), " ")


def letter_marker(name: Column) -> Column:
    """struct<has, found, category>: letters foreign to the local spelling and what they suggest."""
    every = _letters("".join(s for _, s in UNIQUE_LETTERS + HINT_LETTERS))

    def best(lows: Column, groups) -> Column:
        counts = F.array(*[F.size(F.array_intersect(lows, _letters(s))) for _, s in groups])
        labels = F.split(F.lit(" ".join(lab for lab, _ in groups)), " ")
        return let(
            counts,
            lambda n: F.when(
                F.array_max(n) > 0, F.element_at(labels, F.array_position(n, F.array_max(n)).cast("int"))
            ),
        )

    def marker(text: Column) -> Column:
        found = F.filter(
            F.array_distinct(F.split(text, "")),
            lambda c: F.array_contains(every, F.lower(c)) | F.array_contains(every, c),
        )
        return let(
            F.struct(found.alias("found"), F.split(F.lower(text), "").alias("lows")),
            lambda m: F.struct(
                (F.size(m["found"]) > 0).alias("has"),
                m["found"].alias("found"),
                F.when(
                    F.size(m["found"]) > 0,
                    F.coalesce(best(m["lows"], UNIQUE_LETTERS), best(m["lows"], HINT_LETTERS)),
                ).alias("category"),
            ),
        )

    # plain ASCII names, by far the most, never reach the letter tests
    none = F.from_json(F.lit('{"has":false,"found":[]}'), "struct<has:boolean,found:array<string>,category:string>")
    return F.when(name.rlike(r"[^\x00-\x7F]"), let(_composed(name), marker)).otherwise(none)


def flag_marker(name: Column) -> Column:
    """struct<has, sign, category> for the first known flag sign in the name."""
    table = F.lit(" ".join(f"{sign}>{label}" for sign, label in FLAG_SIGNS.items()))
    # a flag is two regional letters; names without one skip the list
    first = F.when(
        name.rlike("[\\x{1F1E6}-\\x{1F1FF}]"),
        F.try_element_at(
            F.filter(F.split(table, " "), lambda s: name.contains(F.split_part(s, F.lit(">"), F.lit(1)))), F.lit(1)
        ),
    )
    return let(
        first,
        lambda s: F.struct(
            s.isNotNull().alias("has"),
            F.split_part(s, F.lit(">"), F.lit(1)).alias("sign"),
            F.split_part(s, F.lit(">"), F.lit(2)).alias("category"),
        ),
    )


def identity_markers(name: Column) -> Column:
    def both(m: Column) -> Column:
        letters, sign = m["letters"], m["sign"]
        signal = F.when(letters["has"], 0.5).otherwise(0.0) + F.when(sign["has"], 0.5).otherwise(0.0)
        return F.struct(
            letters["has"].alias("has_diacritics"),
            letters["found"].alias("diacritics_found"),
            letters["category"].alias("diacritics_category"),
            sign["has"].alias("has_flag"),
            sign["sign"].alias("flag_sign"),
            sign["category"].alias("flag_category"),
            signal.alias("signal_score"),
        )

    return let(F.struct(letter_marker(name).alias("letters"), flag_marker(name).alias("sign")), both)


def family_pattern(name: Column) -> Column:
    """Which family-style pattern the name follows; null for none."""
    low = key_name(name)
    return first_match(low, [(lab, [rx]) for lab, rx in FAMILY_NAMES], mode="regex").cast("string")


def is_fry_shop(name: Column) -> Column:
    return flag(any_contains(F.lower(name), FRY_SHOP_WORDS))


def reputation_uncertainty(name: Column, rating: Column, reviews: Column) -> Column:
    """struct<score, flags>: how far a rating should be discounted."""
    low, size = F.lower(name), F.length(name)
    dashes = (size - F.length(F.replace(name, F.lit(" - "), F.lit("")))) / F.lit(3)
    perfect = flag(rating == 5.0)
    steps = [
        [(size > 80, 0.30, "marketing_heavy_name"), (size > 60, 0.15, "long_name")],
        [(name.contains("|"), 0.25, "seo_formatting")],
        [(dashes >= 2, 0.08, "keyword_rich_name")],
        [(any_contains(low, PROMO_WORDS), 0.08, "promotional_name")],
        [
            (perfect & (reviews > 200), 0.40, "statistically_unlikely_perfect"),
            (perfect & (reviews > 100), 0.15, "unusually_perfect"),
        ],
        [(reviews > 15000, 0.35, "tourist_volume"), (reviews > 10000, 0.20, "high_volume")],
        [((rating >= 4.8) & (reviews > 8000), 0.25, "tourist_trap_pattern")],
    ]
    total, flags = F.lit(0.0), []
    for options in steps:
        amount, label = F.lit(0.0), F.lit(None).cast("string")
        for cond, weight, tag in reversed(options):
            amount = F.when(flag(cond), weight).otherwise(amount)
            label = F.when(flag(cond), F.lit(tag)).otherwise(label)
        total = total + amount
        flags.append(label)
    return F.struct(
        F.least(F.lit(1.0), total).alias("score"), F.array_compact(F.array(*flags)).alias("flags")
    )


def words(text: Column) -> Column:
    """Distinct blank-separated words."""
    return F.filter(F.array_distinct(F.split(squeeze(text), " ")), lambda w: w != "")
