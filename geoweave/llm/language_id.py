"""Language identification, word first, with back-off to character n-grams.

A word that the training rows know is scored by its log frequency in each language. Any other word is
scored by the longest character n-grams of it that are known: 4-grams first, and only if none is known
3-grams, and so on down to single letters.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import any_names, chunks_of, text_bytes

#: Rows that the model may see, at most about so many; a word of fewer training rows' texts is left to its n-grams.
MAX_ROWS, MIN_COUNT = 20_000, 2
#: BATCH: letters of texts that are split at once; STEP: words whose n-grams are counted at once.
GRAM, SMOOTH, CACHE, BATCH, STEP = 4, 0.5, 250_000, 1 << 20, 1 << 14
LETTERS = regex.compile(r"\p{L}+")
UNKNOWN = "und"


@dataclass
class Model:
    """Rows of log frequencies in each language, of words and of n-grams."""

    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)
    word_rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    grams: dict[str, int] = field(default_factory=dict)
    gram_rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def grams_of(self, word: str) -> list[int]:
        """Rows of the longest n-grams of the word that are known."""
        padded = f" {word} "
        for n in range(min(GRAM, len(padded)), 0, -1):
            found = [g for i in range(len(padded) - n + 1) if (g := self.grams.get(padded[i : i + n])) is not None]
            if found:
                return found
        return []


def fit(train: DataFrame, text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Count words and n-grams per language over at most about max_rows rows with text and lang.

    Rows are drawn by a hash of their content, so the model does not depend on how the table is partitioned; rows that
    repeat are drawn together. An empty table gives a model without languages.
    """
    rows = train.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    n = rows.count()
    drawn = F.xxhash64(F.lit("language"), "text").bitwiseAND(F.lit(0xFFFFFF)) < int(max_rows / max(n, 1) * 0x1000000)
    words = (rows.where(drawn) if n > max_rows else rows).select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w <> ''")
    counts = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    kept = counts.where(F.col("n") >= MIN_COUNT).orderBy("w", "lang").toArrow().to_pandas()
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    return build(kept, totals)


def _table(pieces: Iterator[Iterator[str]], langs: np.ndarray, weights: np.ndarray, n: int) -> tuple[dict[str, int], np.ndarray]:
    """Row number of each distinct piece, and by row and language the sums of the weights of the words that the pieces are of."""
    rows: dict[str, int] = {}
    sums, numbered = np.zeros(0), enumerate(pieces)
    while n:
        at, word, k = array("q"), array("q"), None
        for k, found in islice(numbered, STEP):
            for x in found:
                at.append(rows.setdefault(x, len(rows)))
                word.append(k)
        if k is None:
            break
        if not word:
            continue
        sums = np.concatenate((sums, np.zeros(len(rows) * n - len(sums))))
        word = np.frombuffer(word, np.int64)
        np.add.at(sums, np.frombuffer(at, np.int64) * n + langs[word], weights[word])
    return rows, sums.reshape(len(rows), n)


def build(counts: pd.DataFrame, totals: dict[str, int]) -> Model:
    """Log frequencies from counts (lang, w, n) and the words of each language."""
    langs = sorted(totals)
    at = {x: i for i, x in enumerate(langs)}
    lang, weight = np.array([at[x] for x in counts["lang"]], np.int64), counts["n"].to_numpy(dtype=float)
    total = np.array([totals[x] for x in langs], float)
    words, sums = _table(([w] for w in counts["w"]), lang, weight, len(langs))
    model = Model(langs, words, np.log((sums + SMOOTH) / (total + SMOOTH * max(1, len(words)))))
    rows = []
    for size in range(1, GRAM + 1):
        pieces = ((p[i : i + size] for i in range(len(p) - size + 1)) for p in (f" {w} " for w in counts["w"]))
        grams, sums = _table(pieces, lang, 1 + np.log(weight), len(langs))
        model.grams.update(zip(grams, range(len(model.grams), len(model.grams) + len(grams))))
        rows.append(np.log((sums + SMOOTH) / (sums.sum(axis=0) + SMOOTH * max(1, len(grams)))))
    model.gram_rows = np.concatenate(rows)
    return model


class _Known(dict):
    """Word -> row of the score table (log frequencies, then shares); new words of a batch are scored together."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.scores = np.zeros((0, 2 * len(model.langs)))

    def learn(self, words: set[str]) -> None:
        if len(self) > CACHE:
            self.clear()
            self.scores = self.scores[:0]
        new = list(words - self.keys())
        if not new:
            return
        scores = np.zeros((len(new), len(self.model.langs)))
        flat: list[int] = []
        at, sizes = [], []
        for k, w in enumerate(new):
            known = self.model.words.get(w)
            if known is not None:
                scores[k] = self.model.word_rows[known]
            elif found := self.model.grams_of(w):
                flat += found
                at.append(k)
                sizes.append(len(found))
        if at:
            first = np.cumsum(sizes) - sizes
            scores[at] = np.add.reduceat(self.model.gram_rows[flat], first, axis=0) / np.array(sizes)[:, None]
        share = np.exp(scores - scores.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        self.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
        self.scores = np.concatenate((self.scores, np.concatenate((scores, share), axis=1)))


def predict(model: Model, texts: list[str | None], known: _Known | None = None) -> list[tuple[str, float]]:
    """(language, score) of each text; the score is the mean share of its words' weight that goes to the language."""
    known, out, n = known if known is not None else _Known(model), [], len(model.langs)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < BATCH):
            size += len(texts[j] or "")
            j += 1
        split = [LETTERS.findall(t.lower()) if t and n else [] for t in texts[i:j]]
        known.learn(set().union(*split))
        for words in split:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            sums = known.scores[list(map(known.__getitem__, words))].sum(axis=0)
            best = int(np.argmax(sums[:n]))
            out.append((model.langs[best], float(min(1.0, sums[n + best] / len(words)))))
        i = j
    return out


def label(model: Model, texts: pa.Array, known: _Known) -> pa.StructArray:
    """lang_pred and score of each text; about BATCH bytes of texts are Python strings at once."""
    _, starts, ends = text_bytes(texts)
    got = [x for i, j in chunks_of(starts, ends, BATCH) for x in predict(model, texts.slice(i, j - i).to_pylist(), known)]
    return pa.StructArray.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["lang_pred", "score"])


@any_names(("lang_pred", "score"), "text")
def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs plus lang_pred and score.

    lang_pred is `und`, with score 0, if the text is null or has no letter, or if there was no
    training row; ties go to the first language in order. Letters are those of Unicode's letter classes, so digits in any
    form (½, Ⅷ, ①) are none. Whole texts and all n-grams of a word are scored, however long; repeated rows score alike; an
    empty table gives an empty result; columns of docs with the names of result columns are replaced.
    """
    keep = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Known(shared.value)
        for texts in batches:
            yield label(shared.value, texts, known)

    return docs.select(*keep, run(F.col(text)).alias("__gw_lang")).select(*keep, "__gw_lang.lang_pred", "__gw_lang.score")
