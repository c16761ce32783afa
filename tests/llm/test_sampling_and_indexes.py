"""Importance resampling, collocations and decontamination against brute force on small tables with nulls, long, repeated and tied rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoweave.llm import collocations, fm_index, importance
from geoweave.llm.words import ALNUM, joined, read_words

own = np.random.default_rng(12)
LEXICON = ["".join(own.choice(list("abcdeéß9"), own.integers(1, 5))) for _ in range(60)]
ALNUM_RE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(text):
    return ALNUM_RE.findall((text or "").translate(LOW))


def prose(n, sep=" "):
    return sep.join(own.choice(LEXICON, n).tolist())


ITEMS = [(i, prose(int(own.integers(1, 30)))) for i in range(12)] + [(20, None), (21, " .. "), (22, prose(9)), (None, prose(12)), (3, prose(11))]
PASSAGES = [t for _, t in ITEMS if t and ALNUM_RE.search(t)]


def made():
    out = [(i, prose(int(own.integers(1, 150)))) for i in range(30)]
    out += [(40 + i, f"{prose(12)} {PASSAGES[i % len(PASSAGES)].upper()}! {prose(7, ', ')} {PASSAGES[(3 * i) % len(PASSAGES)]}") for i in range(30)]
    out += [(80, None), (81, ""), (82, " \n;"), (83, "One"), (84, "ab " * 700), (None, prose(40)), (85, "x" * 300), (86, prose(9000)), (87, "É a\x00b\x1fc-d_É")]
    return out + [out[33], out[33], out[5], (None, None)]


ROWS = made()


@pytest.fixture(scope="module")
def docs(spark):
    given = [(*r, k % 3, ["en", "de", None][k % 3]) for k, r in enumerate(ROWS)]
    # names that clash with results in all but case, and one with a dot
    return spark.createDataFrame(given, "doc_id long, text string, `a.b` int, lang string").withColumn("N_Words", F.lit("x")).withColumn("Score", F.lit("y")).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_words_joined_by_one_space():
    texts = ["One  two,THREE", None, "", "é"]
    w = next(read_words(pa.array(texts), ALNUM, 1 << 20))
    data, begin = joined(w)
    assert bytes(data) == "one two three é ".encode() and begin.tolist() == [0, 4, 8, 14] and (w.high - w.low).tolist() == [3, 0, 0, 1]


@pytest.mark.parametrize("size, letters", [(1, 1), (40, 2), (300, 3), (500, 400)])
def test_suffixes_are_sorted(size, letters):
    text = np.append(own.integers(1, letters + 1, size), 0)
    order = fm_index.suffix_order(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_wavelet_ranks_and_reads():
    x = own.integers(0, 37, 1000)
    words, zeros = fm_index.Wavelet.pack(x, 6)
    w = fm_index.Wavelet([fm_index.Bits(k) for k in words], zeros)
    at = own.integers(0, 1000, 200)
    symbol = own.integers(0, 37, 200)
    assert w.rank(symbol, at).tolist() == [int((x[:i] == s).sum()) for s, i in zip(symbol, at)]
    got, before = w.read(at)
    assert got.tolist() == x[at].tolist() and before.tolist() == [int((x[:i] == x[i]).sum()) for i in at]


def check_contamination(got, items, window):
    wanted = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t)
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if k and i is not None else 0):
            wanted[tuple(w[p : p + k])].add(str(i))
    for r in got:
        w = alnum(r.text)
        hit, named = np.zeros(len(w), bool), set()
        for k in {len(x) for x in wanted}:
            for p in range(len(w) - k + 1):
                if found := wanted.get(tuple(w[p : p + k])):
                    hit[p : p + k] = True
                    named |= found
        assert (r.n_words, r.n_hit, r.n_items, r.items, r.contaminated) == (len(w), int(hit.sum()), len(named), sorted(named), bool(hit.any())), r.doc_id
        assert sum(s.end - s.first for s in r.spans) == r.n_hit and all(hit[s.first : s.end].all() for s in r.spans)
        assert r.kept_text is None if r.text is None else r.kept_text == cut_by_hand(r.text, hit)
    return sum(r.contaminated for r in got)


def cut_by_hand(text, hit):
    places = [m.span() for m in ALNUM_RE.finditer(text.translate(LOW))]
    gone = np.zeros(len(text), bool)
    for k, (i, j) in enumerate(places):
        if hit[k]:
            gone[i:j] = True
            if k + 1 < len(hit) and hit[k + 1]:
                gone[j : places[k + 1][0]] = True
    return "".join(c for c, g in zip(text, gone) if not g)


@pytest.mark.parametrize("block", [fm_index.BLOCK, 7])
def test_decontamination_equals_brute_force(docs, items, block):
    got = fm_index.decontaminate(docs, items, window=10, texts_out=True, block=block)
    assert got.columns == ["doc_id", "text", "a.b", "lang", "Score", *fm_index.NEW]
    assert check_contamination(got.collect(), ITEMS, 10) > 25
    assert fm_index.decontaminate(docs.limit(0), items).count() == 0
    assert fm_index.decontaminate(docs, items.limit(0)).where("contaminated or n_words is null").count() == 0


def test_decontamination_of_texts_over_several_shards(docs, items, monkeypatch):
    shards = fm_index._index(10)
    monkeypatch.setattr(fm_index, "SHARD_BYTES", 500)
    monkeypatch.setattr(fm_index, "SHARD_WORDS", 60)
    texts = pa.RecordBatch.from_pydict({fm_index.ROW_ID: pa.array(range(len(ROWS))), "text": pa.array([t for _, t in ROWS], pa.string())})
    built = list(shards(iter([texts])))
    assert len(built) > 150
    patterns, want = [tuple(alnum(t)[:10]) for t in PASSAGES], collections.Counter()
    codes = {w: c for w, c in zip(LEXICON, next(read_words(pa.array([" ".join(LEXICON)]), ALNUM, 1 << 20)).codes())}
    by_size = [(np.array([i]), np.array([[codes[w] for w in p]], np.uint64)) for i, p in enumerate(patterns)]
    found, count = set(), 0
    for b in fm_index._search(by_size, True)(iter(built)):
        count += sum(b["n_words"].to_pylist())
        found |= {(row, w) for row, which in zip(b[fm_index.ROW_ID].to_pylist(), b["patterns"].to_pylist()) for w in which}
    for row, (_, t) in enumerate(ROWS):
        w = alnum(t)
        want.update((row, i) for i, p in enumerate(patterns) if any(tuple(w[k : k + len(p)]) == p for k in range(len(w))))
    assert count == sum(len(alnum(t)) for _, t in ROWS) and found == set(want)


def gains_by_hand(docs, items, grams, buckets):
    def features(t):
        w = alnum(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, grams + 1) for i in range(len(w) - k + 1)]

    source, target = collections.Counter(), collections.Counter()
    for _, t in docs:
        source.update(features(t))
    for _, t in items:
        target.update(features(t))
    s, t = sum(source.values()), sum(target.values())
    return features, [math.floor(1000 * math.log((target[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]


@pytest.mark.parametrize("grams, buckets, percent, block", [(1, 10_000, 10, 1024), (3, 70_000, 50, 2), (2, 11, 100, 1)])
def test_resampling_equals_brute_force(docs, items, grams, buckets, percent, block):
    features, gains = gains_by_hand(ROWS, ITEMS, grams, buckets)
    want = []
    for i, t in ROWS:
        u = (int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        weight = sum(gains[b] for b in features(t))
        want.append([i, len(features(t)), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None, len(alnum(t))])
    drawn = sorted((r for r in want if r[-1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = k + 1
    got = importance.resample(docs, items, grams=grams, buckets=buckets, percent=percent, block=block)
    assert got.columns == ["doc_id", "text", "a.b", "lang", "N_Words", *importance.NEW]
    known = lambda r: tuple((x is None, x or 0) for x in r)
    have = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    assert sorted(map(known, have)) == sorted(known(r[:5]) for r in want)
    assert importance.resample(docs.limit(0), items).count() == 0
    assert importance.resample(docs, items.limit(0)).where("rank is not null").count() == 10 * len(drawn) // 100


@pytest.mark.parametrize("runs", [1, 2, 5, 33])
def test_tournament_merges_sorted_runs_and_stops(runs):
    parts = [sorted((int(x), i) for i, x in enumerate(own.integers(0, 50, own.integers(1, 40)))) for _ in range(runs)]
    blocks = sorted((p[i], p[i : i + 3]) for p in parts for i in range(0, len(p), 3))
    everything = sorted(x for p in parts for x in p)
    opened = []
    lazily = (opened.append(b) or b for b in blocks)
    assert list(importance.merge(lazily, 10)) == everything[:10]
    assert len(opened) <= 10 // 1 + runs + 1 and list(importance.merge(iter(blocks), 10**9)) == everything


def test_crc_of_stretches():
    texts = [b"", b"a", "é".encode(), b"word", b"x" * 300, b"y" * 64, b"z" * 65]
    ends = np.cumsum([len(t) for t in texts])
    got = importance.crc32s(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends)
    assert got.tolist() == [zlib.crc32(t) for t in texts]


def phrases_by_hand(given, least, longest, top, percent):
    f, n, out = collections.defaultdict(collections.Counter), collections.Counter(), []
    for lang, text in given:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = {p[i : i + k] for p, a in chosen.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= percent * counts[p[i : i + k]]}
        best = []
        for p, a in chosen.items():
            if p not in inner:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), len(p), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), k, -a, left, right, n[lang], -score) for i, (score, a, p, k, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize("listed, percent", [(collocations.LISTED, 100), (0, 60)])
def test_collocations_equal_brute_force(docs, listed, percent):
    given = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    given += [(x, f"{x} u\x0bv  w\tx{i % 2}. U v, w x y\x1cz") for i in range(9) for x in ("en", None)]
    df = docs.sparkSession.createDataFrame(given, "lang string, text string").withColumn("score", F.lit(1)).repartition(3)
    got = collocations.mine(df, least=4, longest=4, top=40, listed=listed, bits=1 << 10, inside_percent=percent)
    want = phrases_by_hand(given, 4, 4, 40, percent)
    assert sorted(map(tuple, got.collect())) == want and {r[3] for r in want} >= {2, 3} and len({r[0] for r in want}) == 3
    assert collocations.mine(df.limit(0)).count() == 0


def test_what_is_broadcast_has_a_bound(docs):
    level = docs.sparkSession.createDataFrame([("en", f"w{i} x") for i in range(500)], "lang string, phrase string")
    few, bits = collocations.frequent_runs(level), collocations.frequent_runs(level, listed=10, bits=1 << 12)
    assert len(few.listed) == 500 and bits.listed is None and len(bits.bits) == 64
    assert few.has(few.listed).all() and bits.has(few.listed).all() and not few.has(few.listed + np.uint64(1)).any()


def test_scores_stay_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000
    words = spark.createDataFrame([("en", "a", big), ("en", "b", big - 1)], "lang string, phrase string, f long")
    pairs = spark.createDataFrame([("en", "a b", big - 7)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    r = collocations.score_cuts([words, pairs], totals).first()
    assert r.score == 1000 * (big - 7) * 9 * big // (big * (big - 1))
