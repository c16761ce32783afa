"""Toxicity scores from a lexicon trie met with Levenshtein automata, and the context of each hit.

The lexicon holds whole terms and stems: a short fixed list, and terms and stems that the labelled
training rows associate with the toxic label. The Levenshtein automata of its entries are run over its trie together and
made deterministic once (in groups of entries, so that no automaton grows with the lexicon), so a word costs one table look-up a
letter, and all words of a batch advance together. Each hit is judged by the words around it: between
quotation marks or next to words of reporting it counts as quotation, else as abuse. An entry's strength, met exactly or with
one edit, is the share of toxic rows among the training rows that hold it so, with a prior; one below WEAK has no say.
A text's score is the chance that one of its hits is meant, quotations counting little and once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from geoweave.llm.common import any_names, materialize

#: Insults that need no label to be known, words of reporting, and quotation marks.
INSULTS = "idiot moron stupid scum trash loser clown pathetic worthless disgusting imbecile dumb filthy vermin retard bastard".split()
REPORTING = frozenset("said says wrote writes called calls quoted quote quotes word words term terms phrase insult insults slur slurs reads read titled dictionary".split())
ADDRESS = frozenset("you your youre u ur yourself".split())
QUOTES = "\"'“”‘’«»„`"
#: Labelled rows that the model may see, at most about so many.
MAX_ROWS = 20_000
STEMS, MIN_DOCS, MIN_SHARE, NEAR, EDITS = (5, 6, 7), 8, 0.8, 6, 1
#: Chance that a hit is meant before any row is seen, rows that this counts for, and the least strength that has a say.
#: Edited forms of learnt entries need rows that speak for them.
PRIOR, PRIOR_EDITED, PRIOR_LEARNT, PRIOR_ROWS, WEAK = 0.8, 0.65, 0.4, 3, 0.6
#: Strength of a quoted hit against a plain one; entries of one automaton; letters that are scanned at once.
QUOTED, ENTRIES, CHUNK = 0.2, 128, 1 << 20
IN_WORD = re.compile(r"(?<=\w)['’](?=\w)")


@dataclass
class Automaton:
    table: np.ndarray  # state x letter class -> state
    kind: np.ndarray  # of a word that ends in the state: 0, or 1 + 2 * entry, one more if it is met with an edit
    letters: np.ndarray  # code point -> letter class; 255: not part of a word
    depth: int
    stems: np.ndarray  # by kind: whether its entry is a stem


def edits_for(length: int) -> int:
    return EDITS if length >= 5 else 0


def better(a: int, b: int) -> int:
    """Of two kinds the exact one, else the first."""
    return min((x for x in (a, b) if x), key=lambda x: ((x - 1) % 2, x), default=0)


def build_automaton(entries: list[tuple[str, bool]], first_entry: int = 0) -> Automaton:
    """Deterministic intersection of the trie of entries (text, whether a stem) with their Levenshtein automata."""
    children: list[dict[str, int]] = [{}]
    ends: list[dict[bool, tuple[int, int]]] = [{}]
    for k, (t, stem) in enumerate(entries):
        at = 0
        for c in t:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                ends.append({})
            at = children[at][c]
        ends[at].setdefault(stem, (1 + 2 * (first_entry + k), edits_for(len(t))))
    alphabet = sorted({c for n in children for c in n})
    letters = np.full(0x110000, 255, np.uint8)
    letters[: 1 << 16] = np.array([0 if chr(i).isalnum() or chr(i) in "@$" else 255 for i in range(1 << 16)], np.uint8)
    for k, c in enumerate(alphabet):
        letters[ord(c)] = k + 1

    def close(state: dict[int, int]) -> dict[int, int]:
        todo = list(state.items())
        while todo:  # a letter of the entry is missing in the word
            node, e = todo.pop()
            if e < EDITS:
                for n in children[node].values():
                    if state.get(n, 9) > e + 1:
                        state[n] = e + 1
                        todo.append((n, e + 1))
        return state

    def ended(nodes, stem: bool, best: int) -> int:
        for node, e in nodes:
            kind, allowed = ends[node].get(stem, (0, -1))
            if e <= allowed:
                best = better(best, kind + (e > 0))
        return best

    def step(state: tuple, c: str | None) -> tuple:
        nodes, best = state
        out: dict[int, int] = {}
        for node, e in nodes:
            for letter, n in children[node].items():
                cost = e if letter == c else e + 1
                if cost <= EDITS and out.get(n, 9) > cost:
                    out[n] = cost
            if e + 1 <= EDITS and out.get(node, 9) > e + 1:
                out[node] = e + 1
        nodes = tuple(sorted(close(out).items()))
        return nodes, ended(nodes, True, best)

    first = (tuple(sorted(close({0: 0}).items())), 0)
    known, order, rows = {first: 0}, [first], []
    for state in order:
        row = []
        for c in [None, *alphabet]:
            nxt = step(state, c)
            if nxt not in known:
                known[nxt] = len(order)
                order.append(nxt)
            row.append(known[nxt])
        rows.append(row)
    kind = [ended(nodes, False, best) for nodes, best in order]
    stems = np.zeros(2 * (first_entry + len(entries)) + 1, bool)
    for k, (_, stem) in enumerate(entries):
        stems[1 + 2 * (first_entry + k) : 3 + 2 * (first_entry + k)] = stem
    depth = max((len(t) for t, _ in entries), default=0) + EDITS + 1
    return Automaton(np.array(rows, np.int32), np.array(kind, np.int32), letters, depth, stems)


def build_automata(entries: list[tuple[str, bool]]) -> list[Automaton]:
    """One automaton for each ENTRIES entries; neighbours in the order of letters share most of their trie."""
    return [build_automaton(entries[k : k + ENTRIES], k) for k in range(0, max(1, len(entries)), ENTRIES)]


def scan_words(automata: list[Automaton], points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end position of each word among code points, and its kind of hit (0: none)."""
    ink = automata[0].letters[points] != 255
    for auto in automata[1:]:
        ink |= auto.letters[points] != 255
    edge = np.diff(np.concatenate(([0], ink.astype(np.int8), [0])))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - first
    out = np.zeros(len(first), np.int32)
    for auto in automata:
        cls = auto.letters[points]
        cls[cls == 255] = 0
        state = np.zeros(len(first), np.int32)
        live = np.arange(len(first))
        for j in range(auto.depth):  # all words advance together
            live = live[size[live] > j]
            state[live] = auto.table[state[live], cls[first[live] + j]]
        kinds = auto.kind[state]
        kinds[(size > auto.depth) & ~auto.stems[kinds]] = 0  # only a stem can still be in a longer word
        worse = (out > 0) & ((out - 1) % 2 <= (kinds - 1) % 2)
        out = np.where((kinds > 0) & ~worse, kinds, out)
    return first, end, out


@dataclass
class Hit:
    doc: int
    kind: int
    quoted: bool
    addressed: bool


def find_hits(automata: list[Automaton], texts: list[str | None], says: np.ndarray | None = None) -> Iterator[Hit]:
    """The hits of texts, each with its context; with says, only of kinds that have a say."""
    lowered = [(t or "").lower() for t in texts]
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(lowered[j]) < CHUNK):
            total += len(lowered[j]) + 1
            j += 1
        joined = "\n".join(lowered[i:j])
        first, end, kinds = scan_words(automata, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in lowered[i:j]])))
        low = np.searchsorted(first, starts)
        hits = np.flatnonzero(kinds if says is None else says[kinds])
        docs = np.searchsorted(starts, first[hits], "right") - 1
        for h, d in zip(hits.tolist(), docs.tolist()):
            a, z = max(int(low[d]), h - NEAR), min(int(low[d + 1]), h + NEAR + 1)
            before = IN_WORD.sub("", joined[max(int(starts[d]), first[h] - 24) : first[h]])
            after = IN_WORD.sub("", joined[end[h] : min(int(starts[d + 1]), end[h] + 24)])
            near = [joined[first[k] : end[k]] for k in range(a, z) if k != h]
            marked = any(c in QUOTES for c in before) and any(c in QUOTES for c in after)
            yield Hit(i + d, int(kinds[h]), marked or any(w in REPORTING for w in near), any(w in ADDRESS for w in near))
        i = j


@dataclass
class Model:
    entries: list[tuple[str, bool]]
    strength: np.ndarray  # by kind
    base: float  # of a text without hits


def scores(model: Model, automata: list[Automaton], texts: list[str | None]) -> np.ndarray:
    """The chance that a hit of the text is meant. Hits addressed to a reader count twice; of quoted ones the strongest counts."""
    clean, quoted = np.full(len(texts), 1 - model.base), np.zeros(len(texts))
    for x in find_hits(automata, texts, model.strength >= WEAK):
        p = min(model.strength[x.kind], 0.999)
        if x.quoted:
            quoted[x.doc] = max(quoted[x.doc], QUOTED * p)
        else:
            clean[x.doc] *= (1 - p) ** (2 if x.addressed else 1)
    return 1 - clean * (1 - quoted)


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool]]:
    """Terms and stems that the toxic rows of the sample (text, toxic) hold far more often than others.

    Texts that repeat count once; the shortest stem stands for its extensions. The sample is bounded, and so is the lexicon.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}@$]+"))
    each = (
        sample.where("text is not null").groupBy(F.xxhash64("text")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
        .select("toxic", F.explode(words).alias("w")).where("w <> ''")
    )
    keys = F.array(F.concat(F.lit("="), "w"), *[F.when(F.length("w") > n, F.substring("w", 1, n)) for n in STEMS])
    counts = each.select("toxic", F.explode(keys).alias("k")).where("k is not null").groupBy("k").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    strong = counts.where((F.col("t") >= MIN_DOCS) & (F.col("t") >= MIN_SHARE * F.col("n"))).orderBy("k")
    got = [r.k for r in strong.collect()]
    stems: list[str] = []
    for s in sorted((k for k in got if k[0] != "="), key=lambda s: (len(s), s)):
        if not any(s.startswith(x) for x in stems):
            stems.append(s)
    terms = [k[1:] for k in got if k[0] == "="]
    terms = [t for t in terms if not any(t.startswith(s) for s in stems)]
    known = sorted(set(terms) | set(INSULTS))
    return sorted([(t, False) for t in known] + [(s, True) for s in stems if not any(t.startswith(s) for t in known)])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", id_col: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """Learn lexicon and weights from the texts of at most about max_rows rows of labels (id_col, label).

    The labels are sampled before any text is read, and go to the documents by broadcast: their number is
    bounded by max_rows. Rows without a label are left out; of several labels of an id the greatest
    counts; null ids meet no document; repeated texts are rows of their own. With no labelled document, or labels of one
    kind only, the score is a constant.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("toxic"))
    n = marks.count()
    share = min(1.0, max_rows / max(n, 1))
    chosen = marks.where(F.xxhash64(F.lit("toxicity"), id_col).bitwiseAND(F.lit(0xFFFFFF)) < int(share * 0x1000000)) if share < 1 else marks
    sample = materialize(docs.select(id_col, F.col(text).alias("text")).join(F.broadcast(chosen), id_col).select("text", "toxic"), "labelled")
    entries = learn_lexicon(sample)
    automata = sample.sparkSession.sparkContext.broadcast(build_automata(entries))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = sorted({(x.doc, x.kind) for x in find_hits(automata.value, b["text"].to_pylist()) if not x.quoted})
            at = pa.array([d for d, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k for _, k in got], pa.int32()), b["toxic"].take(at)], names=["kind", "toxic"])

    held = sample.mapInArrow(count, "kind int, toxic int").groupBy("kind").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()
    toxic, rows = sample.agg(F.sum("toxic"), F.count("*")).first()
    if not rows or toxic in (0, rows):
        return Model(entries, np.zeros(1 + 2 * len(entries)), float(bool(toxic)))
    t, n = np.zeros(1 + 2 * len(entries)), np.zeros(1 + 2 * len(entries))
    for r in held:
        t[r.kind], n[r.kind] = r.t, r.n
    prior = np.array([0.0] + [p for x, _ in entries for p in (PRIOR, PRIOR_EDITED if x in INSULTS else PRIOR_LEARNT)])
    strength = (t + PRIOR_ROWS * prior) / (n + PRIOR_ROWS)
    strength[0] = 0
    return Model(entries, strength, 0.5 / (rows + 1))


@any_names(("score", "predicted"), "text")
def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs plus score (0 to 1) and predicted (1 from the threshold on).

    Null texts, empty texts and texts without words score as texts without hits. Whole texts are
    scored, however long; repeated rows score alike; an empty table gives an empty result; columns of docs with the names
    of result columns are replaced.
    """
    packed = docs.sparkSession.sparkContext.broadcast((model, build_automata(model.entries)))

    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scores(*packed.value, texts.tolist()))

    return docs.select("*", scored(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fold(id_col: str, parts: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % parts
