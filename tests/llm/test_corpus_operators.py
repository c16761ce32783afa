"""Corpus operators against brute force on small tables with nulls, empty, long, repeated and tied rows."""

import base64
import collections
import hashlib
import math
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from geoweave.llm import anchors, embedding_dedup, language_id, mixing, phrase_dedup, quality_rules, sentencepiece_codec, simhash, suffix_dedup, toxicity, warc_archive
from geoweave.llm.anchors import multikey_quicksort

rng = np.random.default_rng(4)
WORDS = ["".join(rng.choice(list("abcdefgé"), rng.integers(1, 7))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS, n))


def corpus():
    passage, base = prose(90), prose(150)
    rows = [(i, prose(int(rng.integers(1, 200)))) for i in range(25)]
    rows += [(30, base), (31, base), (32, base.replace(" ", "  ", 3)), (33, base[:300] + " odd " + base[300:])]
    rows += [(40 + i, prose(30) + "\n" + passage + " " + prose(20)) for i in range(3)]
    rows += [(50, None), (51, ""), (52, "  \n "), (53, "one"), (54, "ab " * 900), (None, base), (55, passage), (55, passage), (56, prose(20_000))]
    return [(*r, "en", f"s{k % 3}" if k % 7 else None, "clash") for k, r in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    # columns of the names of results clash on purpose
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, score string").withColumn("n_removed", F.lit("x")).repartition(3)


def key(r):
    return (r.doc_id is None, r.doc_id, r.text or "")


def test_row_ids_do_not_depend_on_the_splits_of_a_scan(spark, tmp_path):
    from geoweave.llm.common import ROW_ID, with_row_id

    spark.range(3000).select("id", F.repeat(F.lit("x"), F.col("id").cast("int") % 50).alias("text")).repartition(3).write.parquet(f"{tmp_path}/t")
    rows, seen, conf = with_row_id(spark.read.parquet(f"{tmp_path}/t").where("id <> 7").select(F.struct("id").alias("doc"), "text")), [], "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(conf)
    for size in (usual, "1000"):
        spark.conf.set(conf, size)
        seen.append({r.id: r[1] for r in rows.select("doc.id", ROW_ID).collect()})
    spark.conf.set(conf, usual)
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 2999


def check_repeats(got, window):
    """Every byte of a window that starts twice is gone, and no other."""
    texts = [(r.text or "").encode() for r in got]
    count = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    for r, t in zip(got, texts):
        edge = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                edge[i] += 1
                edge[i + window] -= 1
        mask = np.cumsum(edge)[:-1] > 0
        cut = np.flatnonzero(np.diff(np.concatenate(([1], mask.astype(np.int8), [1]))))
        pieces = [t[i:j] for i, j in cut.reshape(-1, 2)]
        kept = b"".join(pieces)
        spans = len(re.findall(b"\1+", mask.astype(np.uint8).tobytes()))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
        assert "kept_text" not in r or (r.kept_text or "") == "".join(x.decode("utf-8", "ignore") for x in pieces)
    return sum(r.n_removed > 0 for r in got)


@pytest.mark.parametrize("many", [suffix_dedup.MANY, 2])
def test_suffix_dedup_equals_brute_force(docs, many):
    got = suffix_dedup.remove_repeats(docs, window=200, texts_out=True, many=many).collect()
    assert check_repeats(got, 200) > 5 and all(r.score == "clash" for r in got)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def shifted():
    base = prose(400)
    rows = [base[i : i + 450] if i % 3 else prose(20) + base[i : i + 430] + prose(9) for i in range(0, 700, 7)]
    return list(enumerate([*rows, "ab" * 900, "ab" * 300 + "c", base[:399], base[:400], base, base, "x y " * 99]))


def test_suffix_dedup_of_shifted_contexts_at_the_registered_window(spark):
    got = suffix_dedup.remove_repeats(spark.createDataFrame(shifted(), "doc_id long, text string").repartition(3), texts_out=True).collect()
    assert check_repeats(got, suffix_dedup.WINDOW) > 80


@pytest.mark.parametrize("many", [suffix_dedup.MANY, 50])
def test_suffix_dedup_gathers_anchors_that_span_buckets(spark, monkeypatch, many):
    own = np.random.default_rng(6)  # the shared one would give the tests below other rows
    words = lambda n: " ".join(own.choice(WORDS, n))
    passage = words(40)
    df = spark.createDataFrame([(i, f"{words(30)} {passage} {words(30)}") for i in range(120)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffix_dedup, "SAMPLE_SHARE", 1.0)  # splitters that cut through the frequent anchors
    found = suffix_dedup.find_repeats(df.select(F.col("doc_id").alias(suffix_dedup.ROW_ID), "text"), 100, 25, many).where("compare")
    sizes = {r.anchor: (r.n, r.lots, r.few) for r in found.groupBy("anchor").agg(F.count("*").alias("n"), F.max("many").alias("lots"), F.min("many").alias("few")).collect()}
    assert max(n for n, _, _ in sizes.values()) > 100
    assert all(lots == few == (n >= many) for n, lots, few in sizes.values())  # windows are counted singly only where there are many
    assert check_repeats(suffix_dedup.remove_repeats(df, window=100, texts_out=True, many=many).collect(), 100) == 120


def test_windows_shared_by_two_stretches_are_read_off_sorted_neighbours():
    texts = [b"xx" + b"abcdefgh" * 8 + b"yy", b"zx" + b"abcdefgh" * 8 + b"yz", b"xx" + b"abcdefgh" * 8 + b"zz"]
    size = np.array([len(t) for t in texts])
    args = [np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, np.full(3, 2), np.zeros(3, int), np.full(3, 4), np.zeros(3, int)]
    args[4] = np.full(3, 2)
    row, p, q = suffix_dedup.shared_windows(*args, 64, 8)
    assert sorted(zip(row.tolist(), p.tolist(), q.tolist())) == [(0, 0, 2), (1, 1, 2), (2, 0, 2)]


def test_suffix_dedup_settles_what_its_sample_knows_to_repeat():
    keys = lambda ids, col: ([np.zeros(3, np.int64)] * 5 + [np.array([7, 8, 7])], np.zeros(3, suffix_dedup.PLACE))
    run = suffix_dedup.place_batches(keys, suffix_dedup.KEYS, lambda k: np.zeros(len(k[0]), np.int32), {(0, 7)})
    out = next(run(iter([pa.RecordBatch.from_pydict({"__gw_row": [1], "text": ["x"]})]))).to_pylist()
    assert sorted((r["low"], r["known"], len(r["who"]) // suffix_dedup.PLACE.itemsize) for r in out) == [(7, False, 1), (7, True, 2), (8, False, 1)]
    assert suffix_dedup.repeated_classes(np.array([[1, 2], [1, 2], [1, 3]])) == {(1, 2)}


def test_word_codes_do_not_depend_on_the_pieces(monkeypatch):
    words = [b"ab", b"x" * 700, b"ab", b"c", b"ba", b"x" * 699] * 50
    data = np.frombuffer(b" ".join(words), np.uint8)
    first, end, _, _ = anchors.word_spans(data, np.array([0]), np.array([len(data)]))
    whole = anchors.word_codes(data, first, end)
    monkeypatch.setattr(anchors, "PIECE", 64)
    assert (anchors.word_codes(data, first, end) == whole).all()
    assert len(set(whole.tolist())) == len(set(words))


def test_multikey_quicksort_orders_like_tuples_and_counts_shared_words():
    k = rng.integers(0, 3, (5, 500)).astype(np.uint64)
    cuts = [0, 1, 250, 500]
    order, shared = multikey_quicksort(lambda i, level: k[level, i], np.array(cuts[:-1]), np.array(cuts[1:]), 5)
    for a, b in zip(cuts, cuts[1:]):
        rows = [tuple(k[:, i].tolist()) for i in order[a:b]]
        assert rows == sorted(rows) and sorted(order[a:b].tolist()) == list(range(a, b)) and shared[a] == -1
        assert shared[a + 1 : b].tolist() == [next((d for d in range(5) if x[d] != y[d]), 5) for x, y in zip(rows, rows[1:])]


def check_passages(got, window):
    """Every word of a window that starts twice is gone, and no other."""
    texts = [(r.text or "").encode().split() for r in got]
    count = collections.Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    for r, t in zip(got, texts):
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if count[tuple(t[i : i + window])] > 1:
                mask[i : i + window] = True
        kept = b" ".join(w for w, m in zip(t, mask) if not m)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(t), int(mask.sum()), hashlib.sha256(kept).hexdigest())
    return sum(r.n_removed > 0 for r in got)


@pytest.mark.parametrize("many", [suffix_dedup.MANY, 2])
def test_phrase_dedup_equals_brute_force(docs, spark, many):
    got = phrase_dedup.remove_passages(docs, texts_out=True, many=many).collect()
    assert check_passages(got, phrase_dedup.WINDOW) > 5 and all(len((r.kept_text or "").split()) == r.n_words - r.n_removed for r in got)
    more = phrase_dedup.remove_passages(spark.createDataFrame(shifted(), "doc_id long, text string").repartition(3), many=many).collect()
    assert check_passages(more, phrase_dedup.WINDOW) > 50
    assert phrase_dedup.remove_passages(docs.limit(0)).count() == 0


def test_automata_decide_which_passages_recur(monkeypatch):
    passage = " ".join(f"w{i}" for i in range(40)).encode()
    b = pa.RecordBatch.from_pydict({"gram": [5, 5, 6], "high": [1, 2, 3], "low": [1, 2, 3], "at": pa.array([0, 0, 0], pa.int32()), "twice": [False] * 3, "passage": [passage, passage + b" more", passage.replace(b"w1 ", b"other ")]})
    run = lambda: [x for t in phrase_dedup._match_passages(35, 6)(iter([b])) for x in t.to_pylist()]
    assert sorted((x["high"], x["first"], x["end"]) for x in run()) == [(1, 0, 35), (2, 0, 35)]  # what holds no confirmed phrase is not compared
    real = phrase_dedup.occurrences
    for k in range(2):  # without either of the two occurrences nothing is there twice
        monkeypatch.setattr(phrase_dedup, "occurrences", lambda *a: np.delete(real(*a), k))  # noqa: B023
        assert run() == []
    monkeypatch.setattr(phrase_dedup, "occurrences", real)
    auto = phrase_dedup.compile_automaton({b"w1 w2", b"w2 w3"})
    assert phrase_dedup.occurrences(auto, b" w1 w2 w3 w22 w3 w2 w3 ").tolist() == [1, 4, 17]
    monkeypatch.setattr(phrase_dedup, "compile_automaton", lambda found: phrase_dedup.ahocorasick.Automaton())
    assert run() == []


def test_simhash_equals_brute_force(docs):
    got = simhash.near_duplicates(docs).collect()

    def slow(text):
        w = [x.lower() for x in (text or "").encode().split()]
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [slow(r.text) for r in got]
    assert [r.fingerprint for r in got] == [f"{f:016x}" for f in fps]
    part = list(range(len(got)))
    for _ in range(len(got)):
        part = [min(part[j] for j in range(len(got)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(got))]
    low = {c: min((r.doc_id for r, p in zip(got, part) if p == c and r.doc_id is not None), default=None) for c in part}
    assert [r.component_id for r in got] == [low[c] for c in part]
    assert simhash.keep_one(docs).count() == len(set(part))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicate_stage_equals_brute_force_on_shingle_sets(spark):
    import corpus_pipeline

    rows = [(i, prose(150)) for i in range(20)]
    for i in range(60):  # copies with some words changed or cut off, on both sides of the threshold
        w = rows[i % 20][1].split()
        for at in rng.choice(140, i % 5, replace=False):
            w[at] = "changed"
        rows.append((100 + i, " ".join(w[: len(w) - 7 * (i % 4)])))
    rows += [(200, "two words"), (201, "Two  words"), (202, None), (203, ""), (None, rows[0][1])]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    near = lambda a, b: a == b or (a and b and len(a & b) >= 0.8 * len(a | b))
    edge = [[j for j, b in enumerate(sets) if near(a, b)] for a in sets]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in e) for e in edge]
    want = {min((r[0] for r, c in zip(rows, label) if c == k and r[0] is not None), default=None) for k in set(label)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(want) < len(rows) and len(set(label)) < len({x.doc_id for x in simhash.keep_one(df).collect()})
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == sorted(want)
    assert sorted(r.doc_id for r in simhash.keep_one_similar(df, part=3).collect()) == sorted(want)


def test_near_duplicate_stage_rests_on_fingerprints(spark, monkeypatch):
    own = np.random.default_rng(5)  # the shared one would give the tests below other rows
    base = [" ".join(own.choice(WORDS, 300)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t + " and more") for i, t in enumerate(base)] + [(30, None), (31, ""), (32, "one"), (33, "other")]
    sets = [simhash.shingle_set(t, 5) for _, t in rows]
    differ = [((simhash.set_fingerprint(sets[i]) ^ simhash.set_fingerprint(sets[6 + i])) & (2**64 - 1)).bit_count() for i in range(6)]
    assert 0 < max(differ) <= simhash.PROPOSED
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(simhash, "band_keys", lambda hashes: np.zeros(0, np.int64))  # no min-hash proposes anything
    assert sorted(r.doc_id for r in simhash.keep_one_similar(df).collect()) == [*range(6), 30, 32, 33]


def test_trie_join_finds_all_pairs_in_split_buckets(spark, monkeypatch):
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << np.uint64(k)) ^ (np.uint64(1) << np.uint64(k // 2)) for k in range(3, 60)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = {frozenset((a, b)) for a in fps.tolist() for b in fps.tolist() if a < b and (a ^ b).bit_count() <= 4}
    assert [simhash.blocks_per_key(n, 4, 4096) for n in (10, 1 << 31, 1 << 40)] == [2, 2, 4]
    for part, k in ((4096, 2), (7, 2), (4096, 3)):
        monkeypatch.setattr(simhash, "blocks_per_key", lambda *_, k=k: k)
        edges = [(r.u, r.v) for r in simhash.link_fingerprints(df, part=part).collect()]
        names = {int(x): int(y) for x, y in zip(fps.view(np.int64), fps)}
        root = {x: x for x in fps.tolist()}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in edges:
            root[find(names[u])] = find(names[v])
        assert all(len({find(x) for x in p}) == 1 for p in want)


def test_quality_rules_equal_brute_force(docs):
    line = "the very same line of text that many documents hold"
    more = docs.sparkSession.createDataFrame([(1000 + i, line + "\n" + prose(30 if i % 2 else 3), "en", "hot", "c") for i in range(30)], "doc_id long, text string, lang string, source string, score string").withColumn("n_removed", F.lit("x"))
    got = quality_rules.apply_rules(docs.unionByName(more), min_docs=20).collect()
    for r in got:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = collections.defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if x.split()]
        base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
        if r.source == "hot":
            assert r.removed_chars == len(line.replace(" ", "")) and r.kept == (not r.base_failed and r.word_chars - r.removed_chars >= 0.5 * r.word_chars)
        else:
            assert r.removed_chars == 0 and r.kept == (not r.base_failed)
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0


def test_line_limit_fires_by_default_on_hosts_of_every_size(spark):
    line = "the same footer that a few pages hold"
    rows = [(i, (line + "\n" if i < 6 else "") + prose(30), "small") for i in range(12)]
    rows += [(1000 + i, (line + "\n" if i < 6 else "") + prose(30), "large") for i in range(1500)]
    rows += [(5000 + i, (line + "\n" if i < 5 else "") + prose(30), "few") for i in range(12)]
    rows.append((9000, "\n".join([line] * 9) + "\n" + " ".join(WORDS[:12]), "small"))
    got = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    size = len(line.replace(" ", ""))
    assert {i for i, r in got.items() if r.removed_chars} == {*range(6), *range(1000, 1006), 9000}
    assert got[0].removed_chars == size and got[9000].removed_chars == 9 * size and not got[9000].kept


def labelled(spark, n=300):
    rows = [(i, prose(20) + (" you idiot zorgblat " if i % 3 == 0 else " ") + prose(10)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, toxic int")


def test_levenshtein_automata_meet_the_lexicon():
    entries = [("chlla", True), ("idiot", False), ("worthless", False)]
    points = np.frombuffer("idiot idjot idiots idot idxxt chllagu chxlagu worthles".encode("utf-32-le"), np.uint32)
    want = [3, 4, 4, 4, 0, 1, 2, 6]
    assert toxicity.scan_words(toxicity.build_automata(entries), points)[2].tolist() == want
    one_by_one = [toxicity.build_automaton([e], k) for k, e in enumerate(entries)]
    assert toxicity.scan_words(one_by_one, points)[2].tolist() == want

    def edits(a, b):  # brute force
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            d, old = [i + 1], d
            for j, y in enumerate(b):
                d.append(min(old[j] + (x != y), old[j + 1] + 1, d[j] + 1))
        return d[-1]

    many = ["".join(rng.choice(list("abcd"), rng.integers(3, 9))) for _ in range(60)]
    words = many[:20] + [w[:2] + "x" + w[3:] for w in many[:20]] + ["".join(rng.choice(list("abcdx"), rng.integers(1, 10))) for _ in range(400)]
    auto = toxicity.build_automata([(w, False) for w in sorted(set(many))])
    got = toxicity.scan_words(auto, np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32))[2]
    for w, k in zip(words, got.tolist()):
        near = [edits(w, m) for m in set(many) if edits(w, m) <= toxicity.edits_for(len(m))]
        assert (k > 0) == bool(near) and (k == 0 or (k - 1) % 2 == min(near))


def test_toxicity_tells_abuse_and_typos_from_quotation(spark):
    d, y = labelled(spark)
    model = toxicity.fit(d, y)
    assert ("zorgblat", False) in model.entries or any(stem and "zorgblat".startswith(s) for s, stem in model.entries)
    calm = prose(18)
    cases = {
        "you idiot": 1, calm + " idiot": 1, f"{calm} you idjot": 1, f"{calm} wortless {prose(4)}": 1, "you zorgblat": 1,
        f'he said "idiot" to them {calm}': 0, f"the word 'idiot' is in the dictionary {calm}": 0, f"don't you idiot, it's {calm}": 1,
        calm: 0, "": 0, "12 34": 0, f"{prose(3000)} idiot": 1,
    }
    rows = [(k, t, 9) for k, t in enumerate(cases)] + [(99, None, 9), (0, "you idiot", 9)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score int"), model).collect()
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    assert {r.text: r.predicted for r in got} == {**cases, None: 0}
    assert toxicity.score(d.limit(0), model).count() == 0
    constant = toxicity.fit(d, y.limit(0))
    assert {r.predicted for r in toxicity.score(d, constant).collect()} == {0}
    assert toxicity.fit(d.limit(0), y).base == 0


def test_toxicity_needs_its_automata(spark, monkeypatch):
    d, y = labelled(spark, 90)
    model = toxicity.fit(d, y)
    held = [toxicity.scores(model, toxicity.build_automata(model.entries), ["you idjot"])[0], toxicity.scores(model, toxicity.build_automata([]), ["you idjot"])[0]]
    assert held[0] >= 0.3 > held[1]


def test_sentencepiece_equals_the_library_and_round_trips(spark):
    import sentencepiece

    raw = open(sentencepiece_codec.MODEL_PATH, "rb").read()

    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes(out + bytes([n]))

    def message(pairs, fixed=()):
        return b"".join(varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 5) + v if k in fixed else varint(k << 3 | 2) + varint(len(v)) + v for k, v in pairs)

    trainer = lambda v: message([(k, 1 if k == 3 else x) for k, x in sentencepiece_codec._fields(v)], fixed=(10, 15))
    unigram = message([(k, trainer(v) if k == 2 else v) for k, v in sentencepiece_codec._fields(raw)])
    library = sentencepiece.SentencePieceProcessor(model_proto=unigram)
    vocab = sentencepiece_codec.load()
    plain = ["the quick brown fox", "a", "Hello there, general.", "to be or not to be that is the question"]
    for t, ids in zip(plain, sentencepiece_codec.Encoder(vocab).encode(plain)):
        total = lambda x: sum(float(vocab.scores[i]) for i in x)
        assert total(ids.tolist()) == pytest.approx(max(map(total, library.nbest_encode_as_ids(t, 16))))
        assert library.decode(ids.tolist()) == t
    texts = [*plain, None, "", " ", "  two  spaces ", "tab\tand\nline\r\n", "日本語 テスト 😀", "é" * 3000, prose(3000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, n_tokens int")
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(df, vocab), vocab).collect()
    assert all(r.round_trip and r.decoded_text == (r.text or "") for r in out)
    assert {r.doc_id: r.n_tokens for r in out}[4] == 0


def test_mixing_meets_the_targets(docs, spark):
    rows = [(i, prose(20 + i % 30), ["en", "de"][i % 4 == 0], ["a", "b", None][i % 3 % 2 if i % 10 else 2]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    shares = {"lang": {"en": 0.5, "de": 0.5}}
    got = mixing.mix(df, shares=shares, keep_share=0.4).collect()
    total = sum(r.n_tokens for r in got)
    expected = sum(r.n_tokens * r.probability for r in got)
    assert expected == pytest.approx(0.4 * total, rel=1e-3)
    german = sum(r.n_tokens * r.probability for r in got if r.lang == "de")
    assert german / expected == pytest.approx(0.5, abs=0.02)
    assert sum(r.kept * r.n_tokens for r in got) == pytest.approx(expected, rel=0.15)
    assert all(0 <= r.probability <= 1 for r in mixing.mix(docs).collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_reads_texts_once(spark):
    text = [*["".join(rng.choice(list("ab #*$%&|<>\n\té"), 300)) for _ in range(60)], prose(60), "| " + prose(60), None, "", "a\n" * 50, "a" * 100 + " b" * 45 + "|" * 6]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(text)], "doc_id long, text string, lang string, source string")

    def topic(t):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        if n < 40:
            return "short"
        found = (("table", 8 * t.count("|")), ("symbols", 8 * len(re.findall(r"[#*$%&|<>]", t))), ("lines", 25 * t.count("\n")))
        return next((k for k, x in found if x > n), "prose")

    out = mixing.mix(df, texts_out=False)
    assert "text" not in out.columns and "split" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.doc_id: r for r in out.collect()}
    assert [rows[i].topic for i in range(len(text))] == [topic(t or "") for t in text]
    assert {"short", "table", "symbols", "lines", "prose"} >= {r.topic for r in rows.values()} > {"short", "prose"}


def test_mixing_meets_all_targets_that_can_be_met_at_the_registered_share(spark):
    kinds = [(s, x) for s, n in (("a", 12), ("b", 4), ("c", 2)) for x in ["en"] * n + ["de"] * (n // 2) + ["es"] * max(1, n // 6)]
    rows = [(i, prose(30 + i % 60), *kinds[i % len(kinds)][::-1]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df).cache()
    shares = mixing.report(got).collect()
    total, kept = got.agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("probability"))).first()
    assert kept == pytest.approx(mixing.KEEP_SHARE * total, rel=2e-3)
    for d in mixing.DIMENSIONS:
        part = [r for r in shares if r.dimension == d]
        low = [r for r in part if r.target >= r.most]
        scarce = {r.value for r in low}
        for _ in part:  # values that cannot reach their target give all; the others divide the rest in proportion
            k = (1 - sum(r.most for r in part if r.value in scarce)) / sum(r.target for r in part if r.value not in scarce)
            scarce |= {r.value for r in part if r.target * k >= r.most}
        for r in part:
            assert r.expected == pytest.approx(r.most if r.value in scarce else k * r.target, abs=0.004), r
    assert any(r.target > r.most for r in shares)


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "u", "abc"), (2, "u", "abc"), (2, "v", "abc"), (None, "u\nx", None), (4, None, ""), (5, "q", "é" * 5000), *((10 + i, "w", prose(40)) for i in range(50))]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    archives = warc_archive.write_archives(df)
    got = warc_archive.read_archives(archives).collect()
    assert len(got) == len(pages) and sum(r.record_type == "response" for r in got) == len(pages) - 3
    want = collections.Counter((p, base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), len((h or "").encode())) for p, _, h in pages)
    assert collections.Counter((r.page_id, r.payload_digest, r.payload_bytes) for r in got) == want
    assert sorted((r.page_id or 0, r.refers_to) for r in got if r.record_type == "revisit") == [(0, 4), (1, 2), (2, 2)]
    ids = {r.record_id: r.page_id for r in got if r.record_type == "response"}
    assert len({r.record_id for r in got}) == len(pages) and all(ids[r.refers_to_record] == r.refers_to for r in got if r.record_type == "revisit")
    assert warc_archive.export(archives, str(tmp_path)) >= 1
    data = next(tmp_path.iterdir()).read_bytes()
    assert int.from_bytes(data[:4], "little") == warc_archive.SKIPPABLE_MAGIC
    assert warc_archive.write_archives(df.limit(0)).count() == 0


def test_embeddings_equal_brute_force(spark):
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + 0.02 * rng.normal(size=(20, 16)), base[:5]]).astype(np.float32)
    rows = [(i, [float(v) for v in r], int(i % 60 % 3)) for i, r in enumerate(x)]
    odd = [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 1), (103, rows[0][1], None), (104, [None] * 16, 1), (105, [], 1), (0, rows[0][1], 0), (106, rows[0][1][:4], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("x"))
    got = embedding_dedup.near_duplicates(df, part=8).collect()
    assert len(got) == len(rows) + len(odd)
    good = [r for r in rows + odd if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) for r in good]
    links = [sum(j != i and len(unit[i]) == len(unit[j]) and good[i][2] == good[j][2] and float(unit[i] @ unit[j]) >= 0.98 for j in range(len(good))) for i in range(len(good))]
    assert sorted((r.vec_id, r.n_links) for r in got if r.n_links) == sorted((g[0], n) for g, n in zip(good, links) if n)
    assert {r.component_id for r in got if r.vec_id == 60} == {0}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_language_id(spark):
    de, en = ["der die das und nicht ein ist mit auf für", "the and of to in is that for with on"]
    rows = [(i, " ".join(rng.choice((de if i % 2 else en).split(), 30)), "de" if i % 2 else "en") for i in range(60)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [(1, "der Hund und die Katze", "x"), (2, "the dog and that cat", "x"), (3, None, "x"), (4, "12 34 !", "x"), (5, "nichtig " * 30_000, "x"), (6, "", "x"), (7, "½ ² Ⅷ ①", "x"), (8, "nicht" * 20_000, "x"), (8, "nicht" * 20_000, "x")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(texts, "doc_id long, text string, lang_pred string"), model).collect()}
    assert [got[i].lang_pred for i in range(1, 9)] == ["de", "en", "und", "und", "de", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert language_id.predict(empty, ["the"]) == [("und", 0.0)]


def test_language_scores_equal_brute_force():
    counts = [("de", "nicht", 5), ("de", "haus", 3), ("en", "house", 4), ("en", "nicht", 1), ("de", "x" * 70, 2)]
    model = language_id.build(pd.DataFrame(counts, columns=["lang", "w", "n"]), {"de": 10, "en": 6})
    words = {"nicht": (5, 1), "haus": (3, 0), "house": (0, 4), "x" * 70: (2, 0)}

    def slow(word):
        if word in words:
            return [math.log((c + 0.5) / (t + 0.5 * len(words))) for c, t in zip(words[word], (10, 6))]
        for n in range(min(4, len(word) + 2), 0, -1):
            table = collections.defaultdict(lambda: [0.0, 0.0])
            for lang, w, c in counts:
                p = f" {w} "
                for i in range(len(p) - n + 1):
                    table[p[i : i + n]][lang == "en"] += 1 + math.log(c)
            sums = [sum(v[k] for v in table.values()) for k in (0, 1)]
            p = f" {word} "
            held = [table[p[i : i + n]] for i in range(len(p) - n + 1) if p[i : i + n] in table]
            if held:
                return [sum(math.log((v[k] + 0.5) / (sums[k] + 0.5 * len(table))) for v in held) / len(held) for k in (0, 1)]
        return [0.0, 0.0]

    for text in ("haus nicht unknown", "hous", "hauser " * 9 + "house", "x" * 300, "q"):
        each = [slow(w) for w in text.split()]
        best = int(sum(e[1] for e in each) > sum(e[0] for e in each))
        share = sum(math.exp(e[best]) / (math.exp(e[0]) + math.exp(e[1])) for e in each) / len(each)
        (lang, score), = language_id.predict(model, [text])
        assert (lang, score) == (["de", "en"][best], pytest.approx(min(1.0, share)))


def test_language_model_and_texts_are_held_in_pieces(monkeypatch):
    words = ["a", "b", *(f"{x}{y}{z}" for x in WORDS[:40] for y in WORDS[40:80] for z in WORDS[80:90])]
    counts = pd.DataFrame({"lang": ["de", "en"] * (len(words) // 2), "w": words, "n": [2 + i % 7 for i in range(len(words))]})
    whole = language_id.build(counts, {"de": 9, "en": 9})
    monkeypatch.setattr(language_id, "STEP", 2)  # the first two words have no 4-gram
    few = language_id.build(counts[:30], {"de": 9, "en": 9})
    monkeypatch.undo()
    once = language_id.build(counts[:30], {"de": 9, "en": 9})
    assert few.grams == once.grams and few.words == once.words and (few.gram_rows == once.gram_rows).all()

    texts = pa.array([" ".join(words[:20_000])[:100_000], None, "", "12"] * 200)
    known = language_id._Known(whole)
    language_id.label(whole, texts[:4], known)
    tracemalloc.start()
    got = language_id.label(whole, texts, known).to_pylist()
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [dict(zip(("lang_pred", "score"), x)) for x in language_id.predict(whole, texts[:4].to_pylist())] * 200
    assert used < 16 << 20, used  # all texts as strings are 20 MB by themselves


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("score", F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, ""), name)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count() and {r.score for r in out.select("score").distinct().collect()} == {"mine"}
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.count() == docs.count() and last.where("not round_trip").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


CLASHES = {
    "op1": (lambda d: suffix_dedup.remove_repeats(d, texts_out=True), ["N_BYTES", "Spans", "KEPT_text"]), "op2": (lambda d: toxicity.score(d, toxicity.fit(d.select("doc_id", "text"), d.selectExpr("doc_id", "1 AS toxic"))), ["Score", "Predicted"]),
    "op3": (lambda d: sentencepiece_codec.encode(d, sentencepiece_codec.load()), ["N_Tokens"]), "op4": (simhash.near_duplicates, ["Component_ID", "FINGERPRINT"]), "near": (simhash.keep_one_similar, []),
    "op5": (quality_rules.apply_rules, ["Removed_Chars", "KEPT"]), "op6": (mixing.mix, ["Probability", "TOPIC"]), "op8": (embedding_dedup.near_duplicates, ["N_Links"]),
    "op9": (lambda d: language_id.identify(d, language_id.fit(d)), ["SCORE"]), "op10": (lambda d: phrase_dedup.remove_passages(d, texts_out=True), ["Spans", "N_words"]),
}


@pytest.mark.parametrize("name", CLASHES)
def test_columns_of_any_name(spark, name):
    operator, clashing = CLASHES[name]
    rows = [(i, f"some words of a text {i} and the same again", "s", "en", [1.0, float(i), 0.5], 1) for i in range(4)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, embedding array<float>, label int").withColumn("vec_id", F.col("doc_id"))
    odd = plain.withColumns({"a.b": F.lit(7), "tick`s": F.lit(8), **{c: F.lit("mine") for c in clashing}})
    got, want = operator(odd), operator(plain)
    assert [c for c in got.columns if c not in ("a.b", "tick`s")] == want.columns
    found = [r.asDict() for r in got.collect()]
    assert len(found) == want.count() and all(r["a.b"] == 7 and r["tick`s"] == 8 and "mine" not in [str(x) for x in r.values()] for r in found)
