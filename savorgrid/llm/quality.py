"""Quality rules by distribution divergence (operator 1): DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savorgrid.session import materialise

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words, the cells of the word histogram. Parameters, not learned.
COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "this"),
    "de": ("der", "die", "und", "den", "das", "von", "zu", "mit", "sich", "des", "auf", "ist"),
    "fr": ("le", "la", "et", "les", "des", "un", "une", "du", "dans", "est", "pour", "sur"),
    "es": ("el", "los", "que", "en", "se", "las", "por", "con", "no", "una", "su", "para"),
}

#: Cells of the character histogram; what is left over is the last cell. "space" and "symbol" also serve the base counts.
CLASSES: tuple[tuple[str, str], ...] = (
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("space", " \t\n\x0b\x0c\r"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("stop", ".,;:!?'\"()-"),
    ("symbol", SYMBOLS),
    ("digit", "0123456789"),
    ("sign", "@/\\_=+~^{}[]`"),
)


def word_cells(words: dict[str, tuple[str, ...]] = COMMON_WORDS) -> list[str]:
    return list(dict.fromkeys(w for ws in words.values() for w in ws))


def _repeat_words() -> str:
    """Words inside windows of WINDOW words that occur twice or more.

    Windows are compared by hash. Only a text that repeats a window goes on: its windows are sorted by
    hash, those with an equal neighbour give their positions, and sorted positions give the words covered.
    All of it takes n log n steps however long or repetitive the text.
    """
    flagged = (
        "filter(transform(s, (x, i) -> if((i > 0 and x.h = s[i - 1].h) or (i + 1 < size(s) and x.h = s[i + 1].h), x.p, -1)), p -> p >= 0)"
    )
    covered = (
        f"aggregate(array_sort({flagged}), named_struct('n', 0L, 'to', 0L), "
        f"(a, p) -> named_struct('n', a.n + {WINDOW} - greatest(0L, a.to - p), 'to', p + {WINDOW}L), a -> a.n)"
    )
    pairs = "sort_array(transform(__windows, (h, i) -> struct(h as h, cast(i as bigint) as p)))"
    # transform over a one-element array binds the sorted windows once
    sorted_once = f"transform(array({pairs}), s -> {covered})[0]"
    return f"case when size(__windows) = size(array_distinct(__windows)) then 0L else {sorted_once} end"


#: A window's hash is taken from the hashes of its words.
WINDOWS = (
    f"case when size(__hashes) >= {WINDOW} then transform(sequence(0, size(__hashes) - {WINDOW}), "
    f"i -> xxhash64({', '.join(f'get(__hashes, i + {k})' for k in range(WINDOW))})) else array() end"
)


def with_counts(rows: DataFrame, cells: list[str]) -> DataFrame:
    """Replaces __text by the base counts, __total (characters), __chars and __common (array<long>).

    Characters are taken away class by class, so that each step works on what the last has left. A common
    word, in lower case, upper case or capitalised, becomes one letter, and letters are counted.
    """
    keep = [c for c in rows.columns if c != "__text"]
    text = F.coalesce("__text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = F.when(F.instr(text, "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0)
    rows = rows.select(
        *keep, text.alias("__left0"), F.length(text).cast("long").alias("__total"), dup_lines.cast("long").alias("n_dup_lines"),
        F.filter(F.split(text, SPACES, -1), lambda w: w != "").alias("__words"),
    )
    keep += ["__total", "n_dup_lines", "__words"]
    for i, (_, chars) in enumerate(CLASSES):
        rows = rows.select(*keep, *[f"__n{j}" for j in range(i)], F.length(f"__left{i}").cast("long").alias(f"__n{i}"), F.translate(f"__left{i}", chars, "").alias(f"__left{i + 1}"))
    last = len(CLASSES)
    counts = [F.col(f"__n{i}") - (F.col(f"__n{i + 1}") if i + 1 < last else F.length(f"__left{last}")) for i in range(last)]
    letters = {v: chr(0x100 + i) for i, w in enumerate(cells) for v in (w, w.upper(), w.capitalize())}
    code = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])
    coded = F.array_join(F.transform(F.filter("__words", lambda w: w.isin(*letters)), lambda w: F.element_at(code, w)), "")
    keep = [c for c in keep if c != "__words"]
    rows = rows.select(
        *keep, F.size("__words").cast("long").alias("n_words"), F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"), coded.alias("__coded"),
        F.array(*counts, F.length(f"__left{last}").cast("long")).alias("__chars"),
    )
    rows = rows.select(*[c for c in rows.columns if c != "__hashes"], F.expr(WINDOWS).alias("__windows"))
    hits = [((F.octet_length("__coded") - F.octet_length(F.replace("__coded", F.lit(chr(0x100 + i)), F.lit("")))) / 2).cast("long") for i in range(len(cells))]
    space, symbol = ([n for n, _ in CLASSES].index(n) for n in ("space", "symbol"))
    return rows.select(
        *[c for c in keep if c not in ("__total", "n_dup_lines")], "__total", "n_words",
        (F.col("__total") - F.get("__chars", F.lit(space))).alias("word_chars"), F.get("__chars", F.lit(symbol)).alias("n_symbols"),
        "n_dup_lines", F.expr(_repeat_words()).alias("n_repeat_words"), "__chars",
        F.array(*hits, F.col("n_words") - F.length("__coded")).alias("__common"),
    )


def shares(counts: Column) -> Column:
    """A histogram's cells as shares of its sum; null for an empty one."""
    return F.transform(
        F.array(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)),
        lambda total: F.when(total > 0, F.transform(counts, lambda x: x / total)),
    )[0]


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two lists of shares: 0 to 1; null if one is null."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0) + F.when(y > 0, y * F.log2(2 * y / (x + y))).otherwise(0.0)

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def quality_rules(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None,
    words: dict[str, tuple[str, ...]] = COMMON_WORDS, min_chars: int = 200, min_words: int = 50,
    max_char_distance: float = 0.3, max_word_distance: float = 0.4,
) -> DataFrame:
    """The rows with the base counts, base_failed, char_distance, word_distance and kept.

    A language's reference is the summed histogram of all its documents that pass the base rules and the
    length guards; only languages with a word list have one, so references are as many as the lists at
    most. A document is held against every reference and takes the smallest distance. Guards: under
    ``min_chars`` characters the character distance, under ``min_words`` words the word distance, is null
    and decides nothing. ``kept`` is false if the base rules fail or a distance exceeds its maximum.

    A null or empty text has no words and fails the base rules. Without any reference both distances are
    null. Repeated rows count each; clashing columns are replaced. The counts are written once to the
    shared folder, so the texts are read once. ``carry``: columns to bring along, all by default.
    """
    cells = word_cells(words)
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
    # names of our own for what is carried, so that none clashes with a helper
    picked = docs.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)], F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"))
    own = [f"c_{i}" for i in range(len(carry))]
    rows = with_counts(picked, cells)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = materialise(rows.withColumn("base_failed", failed))

    good = rows.where(~F.col("base_failed") & (F.col("__total") >= min_chars) & (F.col("n_words") >= min_words) & F.col("__lang").isin(*words))
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in (("__chars", len(CLASSES) + 1), ("__common", len(cells) + 1)) for i in range(n)]
    references = good.groupBy("__lang").agg(*sums).orderBy("__lang").collect()  # one row for each word list at most

    def nearest(c: str, n: int) -> Column:
        each = []
        for r in references:
            total = sum(r[f"{c}{i}"] for i in range(n))
            each.append(divergence(F.col(c), F.array(*[F.lit(r[f"{c}{i}"] / total) for i in range(n)])))
        if not each:
            return F.lit(None).cast("double")
        return F.round(each[0] if len(each) == 1 else F.least(*each), 6)

    rows = rows.withColumns({"__chars": shares(F.col("__chars")), "__common": shares(F.col("__common"))})
    rows = rows.withColumns({
        "char_distance": F.when(F.col("__total") >= min_chars, nearest("__chars", len(CLASSES) + 1)),
        "word_distance": F.when(F.col("n_words") >= min_words, nearest("__common", len(cells) + 1)),
    })
    odd = F.coalesce(F.col("char_distance") > max_char_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > max_word_distance, F.lit(False))
    return rows.select(
        *[F.col(o).alias(c) for o, c in zip(own, carry, strict=True)], *added[:5], "base_failed", "char_distance", "word_distance",
        (~F.col("base_failed") & ~odd).alias("kept"),
    )
