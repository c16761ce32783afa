"""Every registered query of the corpus operators on a given table, and results against computations made apart from the operators."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweave.llm import embedding_dedup, mixing, queries, sentencepiece_codec

SF = "/root/testdata/sf0.001"
own = np.random.default_rng(31)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no given tables here")
@pytest.mark.parametrize("name", queries.queries())
def test_registered_queries_on_a_given_table(spark, name):
    got = queries.queries()[name](spark, SF)
    rows = got.collect()
    if name not in queries.oracle_sql():
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and "doc_id" in got.columns
        return
    with duckdb.connect() as con:
        for t in ("documents", "benchmark", "pages", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = con.execute(queries.oracle_sql()[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(tuple(str(r[c]) for c in names) for r in rows) == sorted(tuple(map(str, r)) for r in found.fetchall())


def vectors_near(base, cosine):
    """Unit vectors at a given cosine to base, in random directions."""
    noise = own.normal(size=base.shape)
    noise -= (noise * base).sum(axis=1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return cosine * base + np.sqrt(1 - cosine**2) * noise


@pytest.mark.parametrize("size", [16, 64, 256])
def test_pivot_lists_find_nine_in_ten_of_the_links_at_the_limit(spark, size):
    """Recall of the index at the production parameters: pairs just above the cosine that is asked for, among 3,000 vectors of one label."""
    base = own.normal(size=(1500, size))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = vectors_near(base, own.uniform(0.9802, 0.985, (1500, 1)))
    rows = [(i, [float(v) for v in x], 1) for i, x in enumerate(np.concatenate((base, near)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    x = np.concatenate((base, near))
    want = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T >= 0.98
    want = want.sum(axis=1) - 1
    assert all(got[i] <= n for i, n in enumerate(want.tolist()))
    assert sum(got.values()) >= 0.9 * want.sum() and want.sum() >= 3000


def test_raking_equals_a_fitting_by_hand(spark):
    """Cells raked by the operator against proportional fitting in an array."""
    t = own.integers(50, 5000, (4, 3, 2)).astype(float)
    names = [[f"s{i}" for i in range(4)], ["en", "de", "fr"], ["prose", "lines"]]
    cells = spark.createDataFrame([(names[0][i], names[1][j], names[2][k], float(t[i, j, k])) for i in range(4) for j in range(3) for k in range(2)], "source string, lang string, topic string, t double")
    temperature = {"source": 0.5, "lang": 0.4, "topic": 0.8}
    goals = {d: mixing.targets(cells, d, temperature[d]) for d in mixing.DIMENSIONS}
    w, marginals = t.copy(), []
    for axis, d in enumerate(mixing.DIMENSIONS):
        have = t.sum(axis=tuple(a for a in range(3) if a != axis)) ** temperature[d]
        marginals.append(have / have.sum() * t.sum())
        got = {r[0]: r.target for r in goals[d].collect()}
        assert [got[n] for n in names[axis]] == pytest.approx(marginals[-1].tolist())
    for _ in range(300):
        for axis, goal in enumerate(marginals):
            shape = [1, 1, 1]
            shape[axis] = -1
            w *= (goal / w.sum(axis=tuple(a for a in range(3) if a != axis))).reshape(shape)
    raked = {(r.source, r.lang, r.topic): r.w for r in mixing.rake(cells, goals, tolerance=1e-9).collect()}
    for (i, j, k), v in np.ndenumerate(w):
        assert raked[names[0][i], names[1][j], names[2][k]] == pytest.approx(v, rel=1e-6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no given tables here")
def test_segmentations_score_as_the_library_finds_them():
    """200 whole texts: the best segmentation of the library, with the same pieces as a unigram model, scores no higher."""
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
    library = sentencepiece.SentencePieceProcessor(model_proto=message([(k, trainer(v) if k == 2 else v) for k, v in sentencepiece_codec._fields(raw)]))
    vocab = sentencepiece_codec.load()
    with duckdb.connect() as con:
        texts = [r[0] for r in con.execute(f"SELECT text FROM '{SF}/documents.parquet' WHERE length(text) BETWEEN 1 AND 4000 ORDER BY doc_id LIMIT 200").fetchall()]
    texts = [" ".join(t.split()) for t in texts]  # other white space is a byte piece here and a space there
    total = lambda ids: sum(float(vocab.scores[i]) for i in ids)
    equal = 0
    for t, ids in zip(texts, sentencepiece_codec.Encoder(vocab).encode(texts)):
        theirs = library.encode(t)
        assert library.decode(ids.tolist()) == t
        equal += abs(total(ids.tolist()) - total(theirs)) <= 1e-3 * max(1.0, abs(total(theirs)))
    assert len(texts) > 150 and equal >= 0.99 * len(texts)
