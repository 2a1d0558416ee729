"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from .quality import CLASSES, COMMON_WORDS, word_cells

SPACES = r"[\x20\x09-\x0D]+"

EXACT_DEDUP = f"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PHRASES = rf"""
with p as (
    select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(string_split_regex({LOWERED}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents
), g as (
    select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as phrase
    from (select lang, w, unnest(range(1, 6)) as k from p) where len(w) >= k
), f as (select lang, phrase, k, count(*) as a from g group by all having count(*) >= 100 or k = 1
), t as (select lang, sum(len(w))::bigint as n from p group by 1
), c as (select *, string_split(phrase, ' ') as w from f where k > 1
), x as (select c.*, unnest(range(2, k)) as m from c
), inside as (
    select lang, phrase, max(a) as within
    from (select lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) as phrase from x) group by all
), j as (
    select lang, phrase, a, j, array_to_string(w[1 : j], ' ') as first, array_to_string(w[j + 1 :], ' ') as rest
    from (select c.*, unnest(range(1, k)) as j from c)
), cut as (
    select j.lang, j.phrase, j.a, l.a as l, r.a as r, n, j, (1000::hugeint * j.a * n) // (l.a::hugeint * r.a) as score
    from j join t on t.lang = j.lang
    join f l on l.lang = j.lang and l.phrase = j.first
    join f r on r.lang = j.lang and r.phrase = j.rest
), best as (
    select lang, phrase, a, l, r, n, score::bigint as score from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1
)
select best.lang, row_number() over (partition by best.lang order by score desc, a desc, best.phrase) as rank, best.phrase, a, l, r, n, score
from best left join inside on inside.lang = best.lang and inside.phrase = best.phrase
where within is null or 100 * within < 100 * a qualify rank <= 2000
"""

SOURCE_AUDIT = rf"""
with d as (
    select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
), o as (select i, lang, source, unnest(terms) as term from d
), k as (select lang, term, count(*)::hugeint as n from o group by all having count(distinct i) >= 3
), c as (select lang, source, term, count(*)::hugeint as n from o semi join k using (lang, term) group by all
), l as (select lang, count(*) as v, sum(n) as n from k group by 1
), s as (select distinct lang, source from d
), g as (select lang, source, coalesce(sum(c.n), 0) as n from s left join c using (lang, source) group by all
), p as (
    select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.n + l.v) as p, 1 + 1000000000 * (k.n + 1) // (l.n + l.v) as q
    from g join l on l.lang = g.lang join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), pairs as (
    select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), every as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
    from s a join s b on a.lang = b.lang and a.source <> b.source
    left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
    union all
    select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q
)
select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank
from every qualify part = 'pair' or rank <= 200
"""


def _chars(chars: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in chars)


def _quality() -> str:
    cells = word_cells()
    counts = ", ".join(f"len(t) - len(translate(t, {_chars(c)}, ''))" for _, c in CLASSES)
    hits = ", ".join(
        f"len(list_filter(words, lambda w: w in ({', '.join(repr(v) for v in (w, w.upper(), w.capitalize()))})))" for w in cells
    )
    n, m = len(CLASSES) + 1, len(cells) + 1
    langs = ", ".join(repr(x) for x in COMMON_WORDS)
    at = {name: i for i, (name, _) in enumerate(CLASSES, 1)}

    def distance(p: str, q: str, k: int) -> str:
        x, y = f"{p}[i]", f"{q}[i]"
        return (
            f"sqrt(greatest(list_sum(list_transform(range(1, {k + 1}), lambda i: "
            f"case when {x} > 0 then {x} * log2(2 * {x} / ({x} + {y})) else 0.0 end + case when {y} > 0 then {y} * log2(2 * {y} / ({x} + {y})) else 0.0 end)) / 2, 0.0))"
        )

    def sums(c: str, k: int) -> str:
        total = f"sum(list_sum({c}))"
        return "[" + ", ".join(f"sum({c}[{i}]) / {total}" for i in range(1, k + 1)) + "]"

    return f"""
with d as (
    select doc_id, lang, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda w: w <> '') as words from documents
), win as (
    select doc_id, i, array_to_string(words[i : i + 7], ' ') as w from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from d)
), rep as (select doc_id, w from win group by all having count(*) > 1
), cov as (
    select doc_id, count(distinct i + o) as n_repeat_words from win join rep using (doc_id, w), range(8) r(o) group by doc_id
), c as (
    select doc_id, lang, len(t) as total, len(words) as n_words,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines,
        [{counts}] as known, [{hits}] as hit, coalesce(n_repeat_words, 0) as n_repeat_words
    from d left join cov using (doc_id)
), b as (
    select *, list_append(known, total - list_sum(known)) as chars, list_append(hit, n_words - list_sum(hit)) as common,
        n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed
    from c
), r as (
    select lang, {sums('chars', n)} as q1, {sums('common', m)} as q2 from b
    where not base_failed and total >= 200 and n_words >= 50 and lang in ({langs}) group by lang
), s as (
    select doc_id, list_transform(chars, lambda x: x / total) as p1, list_transform(common, lambda x: x / n_words) as p2, total, n_words from b where total > 0 and n_words > 0
), near as (
    select doc_id, round(min(case when total >= 200 then {distance('p1', 'q1', n)} end), 6) as char_distance,
        round(min(case when n_words >= 50 then {distance('p2', 'q2', m)} end), 6) as word_distance
    from s, r group by doc_id
)
select b.doc_id, n_words, total - known[{at['space']}] as word_chars, known[{at['symbol']}] as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance,
    not base_failed and not coalesce(char_distance > 0.3, false) and not coalesce(word_distance > 0.4, false) as kept
from b left join near using (doc_id)
"""


QUALITY = _quality()
