"""The training-data operators against brute force, and their defined results on odd input."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from savorgrid.llm import near_dedup, queries, sentencepiece_codec, simhash, suffix_dedup, textcore
from savorgrid.llm.exact_dedup import DigestIndex
from savorgrid.llm.graph import components
from savorgrid.llm.language_id import LanguageModel
from savorgrid.llm.licenses import TEMPLATES, TemplateIndex, scan_licenses, shingles, windows_of
from savorgrid.llm.lm_score import Discounts, KatzScorer
from savorgrid.llm.packing import _plan, pack, packing_plan, tokenised_pieces
from savorgrid.llm.quality import quality_rules
from savorgrid.llm.shards import shard_by_bytes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
PASSAGE = " ".join(f"shared{i}" for i in range(60))
BPE = queries.tokenizer_file("word_bpe_49k.json")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty and very long texts, repeated rows and ids, copies, shared passages."""
    long_ = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        (1, "the cat and the dog.\nthe cat and the dog.\n", "en", "a", 3), (2, None, None, None, None), (3, "", "en", "a", 0),
        (None, "der Hund und die Katze", "de", None, 1), (4, "the cat  and\tthe dog.\nthe cat and the dog.\n", "en", "a", 3),
        (5, long_, "en", "b", 9), (5, long_, "en", "b", 9), (6, PASSAGE + " one end", "en", "c", 1), (7, "start " + PASSAGE, None, "c", 1),
        (8, "é😀 ▁   x", "fr", "c", 1), (9, " \n \t", None, "c", 1), (10, "12345 67 !!", None, "c", 1),
        (11, "Licensed under the Apache License, Version 2.0.\nmore words here", "en", "d", 1), (12, PASSAGE[:380], "en", "d", 1),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(docs):
    """Columns called like results and like helpers."""
    return docs.selectExpr("*", *[f"'x' as {c}" for c in ("kept", "keep_id", "shard", "fingerprint", "lang_pred", "score", "spans", "ids", "license", "offset", "digest", "h", "fp", "w")])


OPERATORS = {
    1: lambda d: quality_rules(d), 2: lambda d: shard_by_bytes(d, 4), 3: lambda d: scan_licenses(d),
    4: lambda d: sentencepiece_codec.encode(d, queries.tokenizer_file("piece_bpe_32k.model")), 5: lambda d: pack(d, BPE),
    6: lambda d: simhash.near_duplicates(d), 7: lambda d: DigestIndex(d.sparkSession).add(d), 8: lambda d: LanguageModel.fit(d).predict(d),
    9: lambda d: KatzScorer(d.sparkSession).score(d, F.col("doc_id") > 1), 10: lambda d: suffix_dedup.repeated_spans(d),
}
PER_ROW = {1, 2, 4, 6, 7, 8, 9, 10}


@pytest.mark.parametrize("n", OPERATORS)
def test_odd_input(spark, docs, n):
    assert OPERATORS[n](docs.where("false")).collect() == []
    plain, clashing = OPERATORS[n](docs), OPERATORS[n](with_clashes(docs))
    assert len(set(clashing.columns)) == len(clashing.columns)
    if n in PER_ROW:
        assert plain.count() == clashing.count() == docs.count()


def test_quality(spark, docs, rows):
    got = {(r.doc_id, r.n_words): r for r in quality_rules(docs).collect()}
    for doc_id, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        n = Counter(wins)
        covered = {i + o for i, w in enumerate(wins) if n[w] > 1 for o in range(8)}
        r = got[doc_id, len(words)]
        assert (r.word_chars, r.n_symbols) == (sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    from tools.check_oracle import rows_of

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df, rel = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLES[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, rel.fetchall())


def test_shards(spark):
    data = [(i, "hot text" if i % 3 == 0 else f"text {i} " * (i % 40)) for i in range(3000)]
    got = shard_by_bytes(spark.createDataFrame(data, "doc_id long, text string"), 7, piece_bytes=2000).collect()
    assert {(r.doc_id, r.size) for r in got} == {(i, len(t.encode()) + 16) for i, t in data}
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) < 0.04 * sum(sizes.values()) / 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_licenses(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(60):
        name = sorted(TEMPLATES)[i % len(TEMPLATES)]
        own = TEMPLATES[name].split()
        if i % 3 == 1 and len(own) > 20:
            own[int(rng.integers(len(own)))] = "other"
        text = " ".join([*[f"w{x}" for x in rng.integers(0, 999, rng.integers(0, 200))], *own, *[f"w{x}" for x in rng.integers(0, 999, 90)]])
        data.append((i, text))
    got = {(r.doc_id, r.license, r.containment, r.first_word) for r in scan_licenses(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    index, want = TemplateIndex(TEMPLATES), set()
    for i, text in data:
        own = shingles(low(text).encode().split())
        for c, names in index.classes.items():
            for name in names:
                share, first = max(((len(index.sets[name].intersection(own[a:b])) / len(index.sets[name]), -a) for a, b in windows_of(len(own), c)), default=(0, 0))
                if share >= 0.8:
                    first = -first
                    want.add((i, name, share, first + next(k for k, s in enumerate(own[first:]) if s in index.sets[name])))
    assert got == want and len(got) >= 55


def test_sentencepiece(spark, docs):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path), path).select("text", "decoded").collect()
    assert all(r.text == r.decoded for r in back)
    own = sentencepiece_codec.codec(path)
    scores = {t: s for t, (_, _, s) in own.automaton.items()}
    for text in ["Hello the world, éa 😀", "a▁b  c\n\n x", "   ", "der Hund\tund "]:
        t = " " + text
        best = [0.0]
        for e in range(1, len(t) + 1):
            best.append(max([best[e - 1] + own.lowest * len(t[e - 1].encode()), *[best[s] + scores[t[s:e]] for s in range(max(0, e - 20), e) if t[s:e] in scores]]))
        total = sum(scores[p] if isinstance(p := own.pieces[i], str) else own.lowest for i in own.encode(text))
        assert math.isclose(total, best[-1])


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    got = pack(docs, BPE, capacity=256).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((doc_id, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())) for k in range(0, len(ids), 256))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 256


def test_packing_keeps_added_tokens_whole(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    texts = ["hello <|endoftext|> x", "one<|endoftext|>Two", "<|startoftext|>Some text.<|endoftext|>", "<|EndOfText|> a<|endoftext|b", "x <|endoftext|><|endoftext|>'s", "Ab <|endoftext", "|> c", "É<|startoftext|>é"]
    got = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), BPE, capacity=256).collect()
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert want[0] == [3306, 49407, 343, 0]
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == {i: (len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, x in want.items()}


@pytest.mark.parametrize("small", [0.1, 0.4, 0.5])
def test_packing_plan_is_tight(small):
    rng = np.random.default_rng(3)
    sizes = Counter(np.minimum(2048, rng.lognormal(6, 1, 5000).astype(int) + 1).tolist())
    plan = _plan(dict(sizes), 2048, 20, small)
    placed, fill = Counter(), Counter()
    for length, rank, n, at, offset in plan:
        assert placed[length] == rank  # ranks run on without gaps
        placed[length] += n
        for k in range(n):
            assert fill[at + k] <= 2048 - length
            fill[at + k] += length
    assert placed == sizes
    used = max(at + n for _, _, n, at, _ in packing_plan(dict(sizes), 2048, 20))
    assert used <= 1.01 * math.ceil(sum(k * v for k, v in sizes.items()) / 2048) + 1


def fingerprint(text, width=4):
    words = WORD.findall(low(text))
    own = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, docs, rows):
    got = {(r.doc_id, r.fingerprint) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(i, f"{fingerprint(t):016x}") for i, t, *_ in rows}


@pytest.mark.parametrize("bucket_rows", [4096, 8])
def test_near_links(spark, bucket_rows):
    rng = np.random.default_rng(9)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds[:12]:
        x = int(s)
        for _ in range(25):
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in sorted(fps)]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), 4, bucket_rows)
    got = {r.node: r.root for r in components(links).collect()}
    ids = [x for x, in signed]
    owner = {x: x for x in ids}

    def root(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4:
                owner[max(root(a), root(b))] = min(root(a), root(b))
    assert {x: got.get(x, x) for x in ids} == {x: root(x) for x in ids}


def test_masks_cover():
    masks = simhash.covering_masks(4, seed=1)
    rng = np.random.default_rng(2)
    for _ in range(2000):
        gone = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not m & gone for m in masks)


@pytest.mark.parametrize("centres", [16, 1])
def test_similar_texts_equal_brute_force(spark, centres, monkeypatch):
    monkeypatch.setattr(near_dedup.similar_links, "__defaults__", (*near_dedup.similar_links.__defaults__[:-1], centres))
    rng = np.random.default_rng(6)
    data = [(0, ""), (1, " "), (2, "one two"), (3, "One  two")]
    for _ in range(25):  # copies with a few edited words, short ones above all, around a common passage
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(10, 80))] + ["common"] * 3 + [f"c{i}" for i in range(8)]
        for _ in range(6):
            own = list(base)
            for k in rng.integers(0, len(own), rng.integers(0, 3)):
                own[k] = f"e{rng.integers(9999)}"
            data.append((len(data), " ".join(own)))
    sets = []
    for _, t in data:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    owner, loose, far = {i: i for i, _ in data}, 0, 0

    def root(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9:
                far += bin(fingerprint(data[i][1]) ^ fingerprint(data[j][1])).count("1") > 4
                owner[max(root(i), root(j))] = min(root(i), root(j))
            else:
                loose += bool(a & b)
    assert far > 10 and loose > 100
    docs = spark.createDataFrame(data, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    assert {r.doc_id for r in stage(spark, docs, SF).collect()} == {i for i, _ in data if root(i) == i}


def test_fingerprints_join_near_copies_before_the_shingles(spark):
    base = " ".join(f"w{i * 37 % 101}" for i in range(300))
    data = [(i, base + f" tail{i % 40}") for i in range(120)] + [(200, "another text altogether with words of its own")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    own = docs.select(F.col("doc_id").alias("__i"), near_dedup.text_mark(F.col("text")).alias("h"), F.col("text").alias("__x"))
    named = own.mapInArrow(near_dedup._named(5, 2, 2), "__i long, h long, fp long, n int, sketch binary, print long")
    pairs = near_dedup.fingerprint_pairs(named).collect()
    assert len({r.v for r in pairs} | {r.u for r in pairs}) >= 20 and len(pairs) <= 31 * 40  # by masks and texts, not by pairs of texts
    assert [r.doc_id for r in near_dedup.keep_one_similar(docs).orderBy("doc_id").collect()] == [0, 200]


@pytest.mark.parametrize("at,some", [(5, True), (9, False)])
def test_a_shared_shingle_too_late_for_both_proposes_no_pair(at, some):
    """400 texts of 60 shingles share one. From the tenth place on, the 51 that are left are fewer than the 54 that
    two such texts need in common; a pair that has more shares an earlier one, in whose bucket it is found."""
    k, found = 400, 0
    rows = [np.zeros(k, np.int64), np.arange(k), np.full(k, 60), np.full(k, at), np.arange(k)]
    while len(rows[0]):
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["h", "fp", "n", "at", "root"])
        out = pa.Table.from_batches(near_dedup._candidates(0.8, 16)([batch]))
        found += out.num_rows - out["u"].null_count
        left = out.filter(pc.is_valid(out["h"]))
        rows = [left[c].to_numpy() for c in ("h", "fp", "n", "at", "fp")]
    assert found == (k * (k - 1) // 2 if some else 0)


def test_common_shingles_are_known_however_many_texts_there_are(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SAMPLE", 10)
    rows = [(" ".join([f"a{i} b{i} c{i} d{i} e{i}"] + (["one line that many texts have"] if i % 8 == 0 else [])),) for i in range(400)]
    assert len(near_dedup.common_shingles(spark.createDataFrame(rows, "text string"), 5, 400)) == 2  # both shingles of the line


def test_common_shingles_are_counted_over_all_texts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SAMPLE", 10)  # of 400 texts half were looked at
    rows = [" ".join([f"a{i} b{i} c{i} d{i} e{i}"] + (["one line that many texts have"] if i % 50 == 0 else ["the line that seven have here"] if 0 < i < 8 else [])) for i in range(400)]
    got = near_dedup.common_shingles(spark.createDataFrame([(x,) for x in rows], "text string"), 5, 400)
    counts = Counter(h for _, _, hashes, _ in near_dedup.shingle_sets(pa.array(rows), 5) for h in hashes.tolist())
    bits = near_dedup.name_bits(400)
    assert bits == 6 and sorted(got.tolist()) == sorted(h >> (32 - bits) for h, n in counts.items() if n >= 8) and len(got) == 2
    monkeypatch.setattr(near_dedup, "STRETCH", 100)  # sums of several stretches, with shingles that one has more than once
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + 100])], names=["text"]) for i in range(0, 400, 100)]
    packed = pa.Table.from_batches(near_dedup._packed(5, bits)(batches))
    assert packed.num_rows == 4 * 64
    again = pa.Table.from_batches(near_dedup._counted()(packed.sort_by("part").to_batches()))
    assert dict(zip(again["h"].to_pylist(), again["n"].to_pylist(), strict=True)) == {h >> (32 - bits): n for h, n in counts.items()}


def test_shingles_are_added_up_in_stretches_of_bounded_memory():
    """4 MB of texts that share a line: a row of each shingle and stretch, and small working arrays."""
    texts = pa.array([" ".join([*(f"w{i}x{j}" for j in range(400)), "one line that all texts have"]) for i in range(1500)])
    textcore._powers(1)  # not the tables of powers
    tracemalloc.start()
    out = pa.Table.from_batches(near_dedup._all_shingles(5)([pa.RecordBatch.from_arrays([texts], names=["text"])]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = Counter()
    for h, k in zip(out["h"].to_pylist(), out["n"].to_pylist(), strict=True):
        n[h] += k
    assert out.num_rows < len(n) + 10 and sum(n.values()) == 1500 * 402 and Counter(n.values()) == {1500: 2, 1: 1500 * 400}
    assert peak < 60e6
    assert len(textcore._POWERS) == len(textcore._INVERSES) == 1  # nor do those stay when a worker's rows are through
    assert len(textcore.PrefixHash(np.frombuffer(b"ab ab", np.uint8)).spans(np.array([0, 3]), np.array([2, 5]))) == 2


def test_workers_keep_no_tokenizers(spark, docs):
    def held(batches):
        from savorgrid.llm import packing

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing._TOKENIZERS)] * batch.num_rows, pa.int64())], names=["n"])

    assert tokenised_pieces(docs.select("doc_id", "text"), queries.tokenizer_file("word_bpe_49k.json"), 2048).count()
    assert spark.range(8).mapInArrow(held, "n long").agg(F.max("n")).first()[0] == 0


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_frequent_shingles_are_found_across_batches(size):
    h = np.array([-9, -9, -9, -1, 4, 4, 7, 8, 8, 8, 8])
    n = np.array([3, 3, 2, 7, 8, 1, 8, 1, 1, 1, 4], dtype=np.int32)
    batches = [pa.RecordBatch.from_arrays([pa.array(h[i : i + size]), pa.array(n[i : i + size])], names=["h", "n"]) for i in range(0, len(h), size)]
    out = pa.Table.from_batches(near_dedup._frequent(8)(batches))
    assert list(zip(out["h"].to_pylist(), out["n"].to_pylist(), strict=True)) == [(-9, 8), (4, 9), (7, 8)]
    assert pa.Table.from_batches(near_dedup._frequent(8)([batches[0].slice(0, 0)])).num_rows == 0


def test_digest_index(spark, docs, rows):
    index = DigestIndex(spark, buckets=3)
    first = index.add(docs).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest(), []).append(i)
    for r in first:
        own = groups[r.text_sha256]
        assert r.group_size == len(own) and r.keep_id == min((i for i in own if i is not None), default=None)
    assert sum(r.kept for r in first) == len(groups)
    later = index.add(spark.createDataFrame([(0, "", "en", "a", 0), (99, "new", "en", "a", 0)], SCHEMA)).collect()
    assert {(r.doc_id, r.kept, r.keep_id) for r in later} == {(0, False, 2), (99, True, 99)}
    again = DigestIndex(spark, path=index.path, buckets=3)  # opened anew
    assert not any(r.kept for r in again.add(docs).collect())


def test_stages_keep_the_same_rows(spark, docs):
    kept = DigestIndex(spark).add(docs).where("kept").select(docs.columns).collect()
    assert Counter(DigestIndex(spark).keep_new(docs).collect()) == Counter(kept)
    kept = simhash.near_duplicates(docs).where("stays").select(docs.columns).collect()
    assert Counter(simhash.keep_one(docs).collect()) == Counter(kept)
    cleaned = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert cleaned == {(r.doc_id, r.kept_sha256) for r in suffix_dedup.repeated_spans(docs).collect()}


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.QUERIES["op8_language_id"](spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_katz(spark, docs, rows):
    got = KatzScorer(spark).score(docs, F.col("doc_id") <= 9).collect()
    texts = [(i, [*WORD.findall(low(t)), "</s>"]) for i, t, *_ in rows]
    uni, bi = Counter(), Counter()
    for i, w in texts:
        if i is not None and i <= 9:
            uni.update(w)
            bi.update(zip(["</s>", *w[:-1]], w, strict=True))
    total, types = sum(uni.values()), len(uni)

    def good_turing(c):
        n = Counter(c.values())
        return Discounts.of(len(c), sum(c.values()), [n[r] for r in range(1, 7)]).factor

    du, db = good_turing(uni), good_turing(bi)
    left = 1 - sum(du[min(c, 6)] * c for c in uni.values()) / total
    p1 = lambda w: du[min(uni[w], 6)] * uni[w] / total if uni[w] else left
    after = {}
    for (a, b), c in bi.items():
        after.setdefault(a, []).append((b, c))

    def p2(a, w):
        if a not in after:
            return p1(w)
        rest = 1 - sum(db[min(c, 6)] * c for _, c in after[a]) / uni[a]
        full = rest <= 1e-9
        if bi[a, w]:
            return bi[a, w] / (uni[a] + 1) if full else db[min(bi[a, w], 6)] * bi[a, w] / uni[a]
        return (1 / (uni[a] + 1) if full else rest) / (1 - sum(p1(b) for b, _ in after[a])) * p1(w)

    for a in list(after)[:20]:  # the weights are exactly normalised
        assert math.isclose(sum(p2(a, w) for w in uni) + p2(a, "\0"), 1, rel_tol=1e-9)
    want = {}
    for i, w in texts:
        want[i, len(w)] = (sum(uni[x] > 0 for x in w), sum(math.log10((uni[x] + 1) / (total + types + 1)) for x in w), sum(math.log10(p2(a, b)) for a, b in zip(["</s>", *w[:-1]], w, strict=True)))
    for r in got:
        known, base, score = want[r.doc_id, r.n_tokens]
        assert (r.n_known, r.train_tokens) == (known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-6)


@pytest.mark.parametrize("group_rows", [4096, 0])
def test_suffix_dedup(spark, docs, rows, group_rows):
    data = [(i, t) for i, t, *_ in rows] + [(100 + k, "ab" * (190 + 10 * k)) for k in range(4)]
    data += [(200 + k, f"{k} " + PASSAGE[k * 7 :] + f" {k * 31}") for k in range(12)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_spans(df, group_rows=group_rows).collect())
    raw = [(i, (t or "").encode()) for i, t in data]
    often = Counter(b[k : k + 400] for _, b in raw for k in range(len(b) - 399))
    want = Counter()
    for i, b in raw:
        spans = suffix_dedup.merge_spans([(k, k + 400) for k in range(len(b) - 399) if often[b[k : k + 400]] > 1])
        kept = suffix_dedup.cut(b, spans)
        want[i, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()] += 1
    assert got == want


@pytest.mark.parametrize("group_rows", [4096, 0])
def test_repeated_passages_of_over_50_words(spark, group_rows):
    rng = np.random.default_rng(8)
    own = lambda n: [f"q{x}" for x in rng.integers(0, 10**6, n)]
    tiny = [chr(97 + x) for x in rng.integers(0, 26, 60)]  # 51 words are 101 bytes
    mid = [f"é{x}" for x in rng.integers(0, 99, 70)]
    data = [own(3) + tiny[:51] + own(60), own(9) + tiny[:51] + own(2), own(9) + tiny[5:55] + own(9), mid[:51], own(4) + mid[:51], mid[:50] + own(30)]
    data += [own(k) + mid[k : k + 52] + own(9) for k in range(8, 14)] + [own(5) + ["y" * 90] * 6 + own(2), own(7) + ["y" * 90] * 6 + own(5)]
    gaps = [" ", "\n", "  "]
    texts = [gaps[i % 3].join(w) + " " for i, w in enumerate(data)]
    runs = Counter(tuple(w[k : k + 51]) for w in data for k in range(len(w) - 50))
    raw = [t.encode() for t in texts]
    strings = Counter(b[k : k + 400] for b in raw for k in range(len(b) - 399))
    want, passages = [], []
    for w, t, b in zip(data, texts, raw, strict=True):
        at = [(len(t[: m.start()].encode()), len(t[: m.end()].encode())) for m in WORD.finditer(t)]
        spans = [(at[k][0], at[k + 50][1]) for k in range(len(w) - 50) if runs[tuple(w[k : k + 51])] > 1]
        passages.append(suffix_dedup.merge_spans(spans))
        spans += [(k, k + 400) for k in range(len(b) - 399) if strings[b[k : k + 400]] > 1]
        want.append(suffix_dedup.cut(b, suffix_dedup.merge_spans(spans)).decode(errors="ignore"))
    assert sum(a != b for a, b in zip(want, texts, strict=True)) == 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs, words=51, group_rows=group_rows).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.doc_id)] == want
    got = suffix_dedup.repeated_spans(docs, words=51, group_rows=group_rows).drop("text").collect()
    assert [(r.n_passages, r.passage_bytes, [tuple(x) for x in r.passages or []]) for r in sorted(got, key=lambda r: r.doc_id)] == [
        (len(p), sum(b - a for a, b in p), p) for p in passages
    ]
    plain = suffix_dedup.repeated_spans(docs, group_rows=group_rows)  # what is removed does not depend on the passages
    assert Counter(map(str, suffix_dedup.repeated_spans(docs, words=51, group_rows=group_rows).select(plain.columns).collect())) == Counter(map(str, plain.collect()))
    copies = spark.createDataFrame([(i, " ".join("z" for _ in range(n))) for i, n in enumerate((51, 51, 50, 50))], "doc_id long, text string")
    got = suffix_dedup.repeated_spans(copies, words=51).collect()
    assert sorted((r.doc_id, r.n_passages, r.passage_bytes, r.n_removed) for r in got) == [(0, 1, 101, 0), (1, 1, 101, 0), (2, 0, 0, 0), (3, 0, 0, 0)]


def test_pipeline_takes_out_short_words(spark):
    passage = " ".join(f"{chr(97 + i % 26)}{i // 26}" for i in range(51))
    docs = spark.createDataFrame([(1, f"one {passage} end", "en", "a", 1), (2, f"two more {passage} stop", "en", "a", 1)], SCHEMA)
    got = corpus_pipeline.suffix_dedup(spark, docs, SF).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["one  end", "two more  stop"]


def test_deep_shallow():
    rng = np.random.default_rng(4)
    data = {bytes(rng.integers(97, 99, rng.integers(0, 12)).tolist()) for _ in range(200)} | {b"x" * 90 + bytes([k]) * k for k in range(40)}
    data = list(data)
    order, shared = suffix_dedup.deep_shallow(data, shallow=16)
    assert [data[i] for i in order] == sorted(data)
    assert shared[1:] == [suffix_dedup.common(data[a], data[b]) for a, b in zip(order, order[1:], strict=False)]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    odd = docs.unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "123 !!", "en", "a", 6)], SCHEMA))
    first = stages["language_id"](spark, odd, SF)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect()}
    second = stages["exact_dedup"](spark, first, SF)
    assert second.count() == docs.select(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).distinct().count()
    fourth = stages["suffix_dedup"](spark, second, SF)
    assert fourth.columns == docs.columns and fourth.count() == second.count()
    out = entry.queries()["pipeline"](spark, SF)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


STAGE_CLASHES = ("score", "lang_pred", "__i", "__h", "__x", "__mark", "__n", "__digest", "__sha", "__t", "__spans", "h", "fp", "n", "sketch", "column_1")


def test_stages_on_odd_tables(spark, docs, rows):
    """Empty tables, clashing and missing columns, nulls and repeated ids: the same rows stay, with their own columns."""
    words = lambda t: {tuple(w[i : i + 5]) for w in [WORD.findall(low(t or ""))] for i in range(max(1, len(w) - 4)) if w}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), SF).collect() == []
        plain = stage(spark, docs, SF)
        assert plain.columns == docs.columns
        clashing = docs.selectExpr("*", *[f"7.5 as `{c}`" for c in STAGE_CLASHES])
        got = stage(spark, clashing, SF)
        assert got.columns == clashing.columns
        assert Counter(got.select(docs.columns).collect()) == Counter(plain.collect())
        assert got.where(" or ".join(f"`{c}` <> 7.5" for c in STAGE_CLASHES)).isEmpty()
        few = stage(spark, docs.select("text", "doc_id", "lang"), SF)
        assert Counter(few.select("doc_id", "text").collect()) == Counter(plain.select("doc_id", "text").collect())
    kept = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, SF).collect()
    sets = [words(r.text) for r in kept]
    assert all(len(a & b) < 0.8 * len(a | b) if a | b else False for i, a in enumerate(sets) for b in sets[:i])
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert corpus_pipeline.packing(spark, docs.where("false"), SF).collect() == []
    assert packed.where("piece = 0").count() == len(rows)


def test_index_keeps_its_buckets(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(200)], "doc_id long, text string")
    index = DigestIndex(spark, buckets=8)
    assert index.add(docs).where("kept").count() == 200
    for buckets in (None, 8):
        again = DigestIndex(spark, path=index.path, buckets=buckets)
        assert again.buckets == 8 and again.add(docs).where("kept").count() == 0
    with pytest.raises(ValueError, match="8 buckets"):
        DigestIndex(spark, path=index.path, buckets=3)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 3, 500, 513, 3000, 20_000)]
    sets += [np.concatenate([s[: len(s) - len(s) // 10], rng.integers(0, 1 << 63, len(s) // 10, dtype=np.uint64)]) for s in sets]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    found = near_dedup.sketches(np.concatenate(sets), bounds)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            bits = near_dedup.sketch_distance([found[i]], [found[j]])[0]
            assert bits <= len(np.setxor1d(a, b))
            if i != j and len(np.intersect1d(a, b)) < 2 and min(len(a), len(b)) > 400 and max(len(a), len(b)) < 2 * min(len(a), len(b)):
                assert bits > (len(a) + len(b)) / 9  # unrelated texts are told apart at any length
