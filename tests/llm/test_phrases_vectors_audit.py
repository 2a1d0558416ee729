"""Operators 11 to 13 against brute force, and their defined results on odd input."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from savorgrid.llm import phrases
from savorgrid.llm.phrases import LONGEST, cohesion, collocations, parse
from savorgrid.llm.source_audit import share, source_audit
from savorgrid.llm.vector_search import InvertedFile, Pivots, _weights, nearest_vectors

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string"
VECTORS = "vec_id long, embedding array<double>"


def phrases_by_hand(rows, least, longest=5, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        inside = {g[i : i + w] for g, a in found.items() for w in range(2, len(g)) for i in range(len(g) - w + 1) if a >= found[g[i : i + w]]}
        scored = []
        for g in found.keys() - inside:
            s, _, left, right = min((1000 * found[g] * n[lang] // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            scored.append((-s, -found[g], " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    loop = "a b " * 3000  # far longer than a chunk, without an end of piece
    odd = [(None, None), ("en", ""), ("en", " \t\n..;"), (None, "One two. one TWO\rone two"), ("und", "one two"), ("xx", loop), ("xx", "b a" * 40)]
    copies = [("en", "New  York is\ta big city, New York is it!\n")] * 30 + [("fr", "É Été é été. É été")] * 12
    return odd + copies + [("en", f"new york {i} is a big town: the city of new york {i % 3}") for i in range(40)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s") for i, (lang, t) in enumerate(rows)], DOCS)


@pytest.mark.parametrize("least,longest", [(3, 5), (9, 3), (1, 2)])
def test_phrases(spark, rows, least, longest):
    got = collocations(docs_of(spark, rows), min_count=least, longest=longest).collect()
    assert sorted(map(tuple, got)) == phrases_by_hand(rows, least, longest)


def test_phrases_top_and_clashing_columns(spark, rows):
    docs = docs_of(spark, rows).selectExpr("*", "'x' as n", "'x' as phrase", "1 as salt", "'x' as chunk", "'x' as rank")
    got = collocations(docs, min_count=3, top=5).collect()
    assert sorted(map(tuple, got)) == phrases_by_hand(rows, 3, top=5)
    assert collocations(docs.where("false")).collect() == []


def test_phrase_maps_only_filter(spark, rows, monkeypatch):
    """A map that is full of other phrases' bits loses and adds nothing."""
    monkeypatch.setattr(phrases, "_bit_map", lambda hashes: np.full(1 << (phrases.BITS - 3), 255, dtype=np.uint8))
    got = collocations(docs_of(spark, rows), min_count=4).collect()
    assert sorted(map(tuple, got)) == phrases_by_hand(rows, 4)


def test_phrase_maps_give_memory_back():
    from savorgrid.llm import phrases as ph

    maps = [ph._parse(4), ph._count_hashes(2, None), ph._count_texts(range(1, 2), None), ph._word_hashes]
    assert all(hasattr(f, "__wrapped__") for f in maps)


def test_parse_covers_every_token_once(spark, rows):
    got = parse(docs_of(spark, rows), overlap=4).collect()
    tokens = Counter()
    for r in got:
        words = r.chunk.split(" ")
        assert 0 < r.owned <= LONGEST and r.owned <= len(words) <= r.owned + 4
        tokens.update({(r.lang, w): r.freq * words[: r.owned].count(w) for w in set(words[: r.owned]) - {"."}})
    want = Counter()
    for lang, text in rows:
        want.update(("und" if lang is None else lang, w) for w in re.findall(r"[^ \t.,;:!?\n\x0b\x0c\r]+", (text or "").translate(LOW)))
    assert +tokens == want
    assert sum(r.freq for r in got if r.lang == "fr") == 12 and sum(r.lang == "fr" for r in got) == 1


def test_cohesion_beyond_64_bits(spark):
    data = [(10**13 + 7, 3 * 10**15 + 1, 10**13 + 9, 10**14 + 3), (100, 9 * 10**17, 100, 100), (5, 5, 5, 5)]
    got = spark.createDataFrame(data, "a long, n long, l long, r long").select(cohesion(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("x")).collect()
    assert [r.x for r in got] == [1000 * a * n // (x * y) for a, n, x, y in data]


def neighbours_by_hand(rows, k):
    known = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            known.setdefault(i, []).append(v)
    out = {}
    for q, vs in known.items():
        if q % 20 == 0:
            near = {i: max(float(np.dot(a, b)) for a in vs for b in us) for i, us in known.items() if i != q}
            out[q] = [(i, s) for i, s in sorted(near.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def test_vectors_with_everything_reranked(spark):
    rng = np.random.default_rng(3)
    hot = [1.0, 2.0, 0.0, -1.0]
    rows = [(i, hot if i % 3 == 0 else (rng.normal(size=4) * rng.integers(1, 9)).round(1).tolist()) for i in range(400)]
    rows += [rows[40], rows[60], (None, hot), (1000, None), (1020, []), (1040, [0.0] * 4), (1060, [None, 1.0, 1.0, 1.0]), (1080, [float("nan"), 1.0, 1.0, 1.0]), (1100, [float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' as score", "'x' as id", "1 as rank")
    got, want = found(nearest_vectors(df, F.col("vec_id") % 20 == 0, reranked=1000.0, block=64)), neighbours_by_hand(rows, 20)
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near]
        assert np.allclose([s for _, s in got[q]], [s for _, s in near], rtol=1e-12)


def test_vectors_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = found(nearest_vectors(df, F.col("vec_id") % 20 == 0))
    x, ids = np.array([v for _, v in rows], dtype=np.float64), np.array([i for i, _ in rows])
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        products = x @ x[at]
        order = [j for j in np.lexsort((ids, -products)) if j != at][:20]
        hits, total = hits + len({i for i, _ in got[ids[at]]} & set(ids[order].tolist())), total + 20
        assert all(abs(dict(zip(ids.tolist(), products, strict=True))[i] - s) < 1e-12 for i, s in got[ids[at]])
    assert hits >= 0.95 * total


def test_vectors_small_tables(spark):
    def run(rows):
        return found(nearest_vectors(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0))

    assert run([]) == {}
    assert run([(20, [1.0])]) == {}
    assert run([(20, [1.0]), (21, [-3.0]), (40, [2.0]), (7, [1.0, 1.0])]) == {20: [(40, 2.0), (21, -3.0)], 40: [(20, 2.0), (21, -6.0)]}


def test_inverted_file_is_footrule():
    rng = np.random.default_rng(1)
    x, q, n = rng.normal(size=(50, 6)), rng.normal(size=(9, 6)), 10
    pivots = Pivots(rng.normal(size=(24, 6)), 9.0)
    mine, theirs = pivots.order(x, False, n), pivots.order(q, True, n)
    got = InvertedFile(mine, 24).closeness(_weights(theirs, 24))
    for i in range(50):
        for j in range(9):
            a, b = ({p: k for k, p in enumerate(o)} for o in (mine[i].tolist(), theirs[j].tolist()))
            footrule = sum(abs(a.get(p, n) - b.get(p, n)) for p in a.keys() | b.keys())
            assert footrule == n * (n + 1) - 2 * got[i, j]


def audit_by_hand(rows, least=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    n, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        c = Counter(t.translate(LOW) for t in term.findall(text or ""))
        n[lang or "", source or ""].update(c)
        df[lang or ""].update(c.keys())
    out = []

    def gap(p, q):
        return (p - q) * (p - q) // q

    for lang in df:
        kept, sources = [t for t, c in df[lang].items() if c >= least], [s for x, s in n if x == lang]
        total, every = {s: sum(n[lang, s][t] for t in kept) for s in sources}, Counter()
        for s in sources:
            every.update(n[lang, s])
        p = {s: {t: 1 + 10**9 * (n[lang, s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (every[t] + 1) // (sum(total.values()) + len(kept)) for t in kept}
        for s in sources:
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-gap(p[s][t], q[t]), t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, o.decode(), -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, o) in enumerate(found, 1)]
    return sorted(out)


def test_source_audit(spark):
    rng = np.random.default_rng(9)
    words = ["The", "cat's", "été", "Éclair", "naïve9x", "日本", "a-b", "Z", "_q_"]
    rows = [(None if i % 11 == 0 else ("en", "de", "")[i % 3], None if i % 13 == 0 else f"s{rng.integers(6)}", " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(200)]
    rows += [("solo", "only", "one two"), ("en", "empty", None), ("en", "odd", "\x00\t12 34 ..."), ("no", "a", "x"), ("no", "b", "y")] + [("en", "hot", "the the cat")] * 120
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as n", "'x' as term", "'x' as g", "2 as p", "'x' as value")
    for top in (200, 2):
        assert sorted(map(tuple, source_audit(df, top=top).collect())) == audit_by_hand(rows, top=top)
    assert source_audit(df.where("false")).collect() == []


def test_source_audit_hands_on_in_parts(spark, monkeypatch):
    from savorgrid.llm import source_audit as module

    rows = [(f"l{i % 2}", f"s{i % 5}", " ".join(chr(97 + (i * k) % 26) * 3 for k in range(12))) for i in range(60)]
    batch = __import__("pyarrow").RecordBatch.from_pylist([dict(zip(("lang", "source", "text"), r, strict=True)) for r in rows])
    whole = Counter()
    for limit in (10**6, 5):
        monkeypatch.setattr(module, "ENTRIES", limit)
        sums = Counter()
        for out in module._counts(iter([batch])):
            for r in out.to_pylist():
                sums[r["lang"], r["source"], r["term"], "n"] += r["n"]
                sums[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        assert not whole or whole == sums
        whole = sums


def test_share_beyond_64_bits(spark):
    data = [(10**11, 10**15 + 3), (9_223_372_036, 10**12), (9_223_372_034, 10**12), (0, 7)]
    got = spark.createDataFrame(data, "n long, t long").select(share(F.col("n"), F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [1 + 10**9 * (n + 1) // t for n, t in data]

