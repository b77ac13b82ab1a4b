"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text, from its bytes: densities of a fixed and of a learnt lexicon, how much of
either stands near a second-person word, capitals, punctuation, and obfuscation (letters mixed
with digits or signs, and lexicon words found once these are read as letters).

The learnt lexicon holds words and word beginnings that are far more common in rows labelled
toxic; they are counted over all labelled rows outside the held-out fifth. A unit must be in 0.4 %
of the toxic rows, so there are few of them for any number of rows: at most 250 times the units
of a row. Were there ever more than ``MAX_LEXICON``, the share asked for is doubled until not.
Trees are fitted on at most ``MAX_TRAIN`` of the labelled rows in the order of a hash of the id (all,
if fewer), four fifths of which grow the trees while the rest calibrates them.

Defined results: null and empty texts have features of zero and get the score of that. Without
training rows of both classes the score is the share of toxic ones (0 without any). Labels that
are null take no part; a row with several labels counts once for each, and so do rows that share
an id. Empty tables give no rows. Further columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.shingles import Runs, folding, slices
from blockweave.runtime import few_bytes, settle

#: Labelled rows that the trees are fitted on, at most.
MAX_TRAIN = 50_000
#: Learnt words and beginnings that are held, at most (20 bytes each).
MAX_LEXICON = 200_000
#: Lengths of word beginnings in bytes.
HEADS = (4, 5, 6)
#: Words around a lexicon word in which a second-person word counts as near.
NEAR = 4

#: Common insults, and second-person words of the languages at hand.
INSULTS = (
    "idiot idiots moron morons stupid loser losers pathetic scum trash worthless clown disgusting dumb fool imbecile jerk "
    "filth vermin garbage retard bastard bitch asshole dipshit scumbag shut hate kill die freak pig coward liar ugly "
    "idiota estúpido imbécil basura asqueroso payaso idiote stupide imbécile ordure crétin débile dummkopf trottel abschaum "
    "arschloch dreck blöd widerlich"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()
#: Signs read as letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "*"}

FEATURES = (
    "fixed fixed_any learnt learnt_weight learnt_any heads heads_weight hidden near_fixed near_learnt second_person capitals all_caps "
    "exclaims questions marks repeated digits mixed length words word_length"
).split()


@cache
def _tables() -> dict[str, np.ndarray]:
    fold, space = folding()
    code = np.arange(256)
    letter = (code >= 128) | ((code | 32) >= 97) & ((code | 32) <= 122) & (code < 128)
    upper = (code >= 65) & (code <= 90)
    digit = (code >= 48) & (code <= 57)
    mark = ~letter & ~digit & ~space & (code > 32)
    plain = fold.copy()
    leet = np.zeros(256, bool)
    for a, b in LEET.items():
        leet[ord(a)] = True
        plain[ord(a)] = ord(b)
    return {"fold": fold, "letter": letter, "upper": upper, "digit": digit, "mark": mark, "plain": plain, "leet": leet, "space": space}


@cache
def _hashes_of(words: tuple[str, ...]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    t = _tables()
    return np.unique(Runs(data, np.array([0, len(data)]), t["letter"][data], t["fold"]).hashes())


def _member(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


class Lexicon:
    """Sorted hashes of learnt words (length 0) and beginnings, with their weights."""

    def __init__(self, entries: list[tuple[int, int, float]]):
        self.parts = {}
        for size in (0, *HEADS):
            own = sorted((np.uint64(h % (1 << 64)), w) for s, h, w in entries if s == size)
            self.parts[size] = np.array([h for h, _ in own], np.uint64), np.array([w for _, w in own])

    def weights(self, size: int, h: np.ndarray) -> np.ndarray:
        known, weight = self.parts[size]
        if not len(known):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, weight[at], 0.0)


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES per text."""
    t, n = _tables(), len(offsets) - 1
    out = np.zeros((n, len(FEATURES)), np.float32)
    if not len(data):
        return out
    letter = t["letter"][data]
    runs = Runs(data, offsets, letter, t["fold"])
    h, before = runs.hashes(), runs.before

    def total(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    words = np.maximum(1, np.diff(before))
    length = np.maximum(1, np.diff(offsets))
    fixed = _member(h, _hashes_of(tuple(INSULTS)))
    learnt = lexicon.weights(0, h)
    heads = np.max([lexicon.weights(s, runs.heads(s)) for s in HEADS], axis=0) if len(h) else np.zeros(0)
    second = _member(h, _hashes_of(tuple(SECOND_PERSON)))
    count = np.concatenate([[0], np.cumsum(second)])
    owner = np.repeat(np.arange(n), np.diff(before))
    low, high = np.maximum(np.arange(len(h)) - NEAR, before[owner]), np.minimum(np.arange(len(h)) + NEAR + 1, before[owner + 1])
    near = count[high] > count[low]
    # signs between letters, and the words they give when read as letters
    odd = (t["leet"] | t["digit"])[data] & ~t["space"][data]
    left, right = np.zeros(len(data), bool), np.zeros(len(data), bool)
    left[1:], right[:-1] = letter[:-1], letter[1:]
    between = odd & left & right
    wide = Runs(data, offsets, letter | t["leet"][data], t["plain"])
    has_sign = np.concatenate([[0], np.cumsum(t["leet"][data])])
    hidden = _member(wide.hashes(), _hashes_of(tuple(INSULTS))) & (has_sign[wide.ends] > has_sign[wide.starts])
    size = runs.ends - runs.starts
    upper_sum = np.concatenate([[0], np.cumsum(t["upper"][data])])
    caps = (upper_sum[runs.ends] - upper_sum[runs.starts] == size) & (size > 1)
    mark = t["mark"][data]
    again = np.zeros(len(data), bool)
    again[1:] = mark[1:] & (data[1:] == data[:-1])
    values = {
        "fixed": total(fixed, before) / words, "fixed_any": np.log1p(total(fixed, before)),
        "learnt": total(learnt > 0, before) / words, "learnt_weight": np.log1p(total(learnt, before)), "learnt_any": np.log1p(total(learnt > 0, before)),
        "heads": total(heads > 0, before) / words, "heads_weight": np.log1p(total(heads, before)),
        "hidden": np.log1p(total(hidden, wide.before)),
        "near_fixed": total(fixed & near, before), "near_learnt": total(((learnt > 0) | (heads > 0)) & near, before),
        "second_person": total(second, before) / words,
        "capitals": total(t["upper"][data], offsets) / length, "all_caps": total(caps, before) / words,
        "exclaims": total(data == ord("!"), offsets) / length, "questions": total(data == ord("?"), offsets) / length,
        "marks": total(mark, offsets) / length, "repeated": total(again, offsets) / length,
        "digits": total(t["digit"][data], offsets) / length, "mixed": total(between, offsets) / words,
        "length": np.log1p(np.diff(offsets)), "words": np.log1p(np.diff(before)), "word_length": total(size, before) / words,
    }
    for i, name in enumerate(FEATURES):
        out[:, i] = values[name]
    return out


class Trees:
    """Boosted regression trees for the logistic loss, over binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.base, self.edges, self.trees = 0.0, [], []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b, width = self._binned(x), self.bins + 1
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, feature, cut = np.zeros(len(y), np.int64), [], []
            for level in range(self.depth):
                k = 1 << level
                best = np.full(k, 1e-9)
                which, where = np.zeros(k, np.int64), np.full(k, width)
                for j in range(x.shape[1]):
                    at = node * width + b[:, j]
                    gs = np.bincount(at, g, k * width).reshape(k, width).cumsum(axis=1)
                    hs = np.bincount(at, h, k * width).reshape(k, width).cumsum(axis=1)
                    total_g, total_h = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (total_g - gs) ** 2 / (total_h - hs + self.ridge) - total_g**2 / (total_h + self.ridge)
                    gain[(hs < 1) | (total_h - hs < 1)] = 0
                    top = gain.argmax(axis=1)
                    better = gain[np.arange(k), top] > best
                    best[better], which[better], where[better] = gain[np.arange(k), top][better], j, top[better]
                feature.append(which)
                cut.append(where)
                node = 2 * node + (b[np.arange(len(y)), which[node]] > where[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            self.trees.append((feature, cut, value))
            f += value[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for which, where in zip(feature, cut):
                node = 2 * node + (b[rows, which[node]] > where[node])
            f += value[node]
        return f


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and heights of the best non-decreasing steps (pool adjacent violators)."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of raw scores
    for r, label in zip(raw[order].tolist(), y[order].tolist()):
        blocks.append([label, 1, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    """Lexicon, trees and calibration; scores features between 0 and 1."""

    def __init__(self, lexicon: Lexicon, x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.lexicon, self.trees = lexicon, None
        self.share = float(y.mean()) if len(y) else 0.0
        fit, held = fold != 0, fold == 0
        if len(set(y[fit].tolist())) == 2:
            if len(set(y[held].tolist())) < 2:  # too few rows to hold some back
                fit = held = np.ones(len(y), bool)
            self.trees = Trees().fit(x[fit], y[fit])
            self.centres, self.heights = isotonic(self.trees.raw(x[held]), y[held])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        # the steps, joined by lines; a thousandth of the uncalibrated score parts the rows of a step
        return np.clip(0.999 * np.interp(raw, self.centres, self.heights) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def labelled_rows(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, label) of the labelled rows outside the held-out fifth."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    own = known.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("label"))
    return own.where(~held_out(F.col("doc_id")))


def training_rows(labelled: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, label, fold) of at most ``most`` labelled rows."""
    deal = F.xxhash64("doc_id")
    return labelled.orderBy(deal, "doc_id", "label").limit(most).withColumn("fold", F.pmod(F.shiftright(deal, 7), F.lit(5)).cast("int"))


def held_out(doc_id):
    """Rows whose crc32 of the id as text is divisible by 5 are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_lexicon(rows: DataFrame, least: float = 0.004, odds: float = 12.0, most: int = MAX_LEXICON) -> Lexicon:
    """Words and beginnings of ``rows`` (text, label) that are ``odds`` times as common in toxic rows, and in a share of ``least`` of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tables()
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for at, rows, data, offsets in slices(batch.column(0)):
                runs = Runs(data, offsets, t["letter"][data], t["fold"])
                owner = np.repeat(np.arange(rows), np.diff(runs.before)).astype(np.uint64)
                for size in (0, *HEADS):
                    h = runs.heads(size) if size else runs.hashes()
                    pairs = np.unique(np.stack([h, owner], axis=1)[h != 0], axis=0) if len(h) else np.empty((0, 2), np.uint64)
                    unit, of = np.unique(pairs[:, 0], return_inverse=True)
                    toxic = label[at + pairs[:, 1].astype(np.int64)] > 0
                    ones = np.bincount(of, toxic, len(unit)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), size, np.int32)), pa.array(unit.view(np.int64)), pa.array(ones), pa.array(np.bincount(of, minlength=len(unit)) - ones)], names=["size", "unit", "ones", "zeros"])

    totals = rows.agg(F.sum("label"), F.count("*")).first()
    ones, size = totals[0] or 0, totals[1]
    if not ones or ones == size:
        return Lexicon([])
    counts = rows.select("text", "label").mapInArrow(run, "size int, unit long, ones long, zeros long").groupBy("size", "unit").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    ratio = (F.col("ones") / ones) / ((F.col("zeros") + 0.5) / (size - ones + 1))
    found = settle(counts.where((F.col("ones") >= max(3, least * ones)) & (ratio >= odds)).withColumn("weight", F.log(ratio)), "lexicon")
    while found.count() > most:
        least *= 2
        found = found.where(F.col("ones") >= least * ones)
    return Lexicon([(r["size"], r["unit"], r["weight"]) for r in found.collect()])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_TRAIN) -> Model:
    """A model learnt from the labelled rows of ``docs`` outside the held-out fifth."""
    labelled = settle(labelled_rows(labels, id_col, label_col), "labelled")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lexicon = learn_lexicon(texts.join(F.broadcast(labelled) if few_bytes(labelled) else labelled, "doc_id"))
    rows = settle(training_rows(labelled, most), "training")  # at most ``most`` rows of 16 bytes
    sample = texts.join(F.broadcast(rows), "doc_id")
    shape = "doc_id long, label int, fold int, x array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in slices(batch.column(3)):
                x = features(data, offsets, lexicon)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(at, n) for k in range(3)], pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "label", "fold", "x"])

    # in a fixed order, so that a fit that is run again gives the same trees; where ids repeat, the bound holds for their rows, too
    order = (F.xxhash64("doc_id"), "doc_id", "label", "x")
    table = sample.select("doc_id", "label", "fold", "text").mapInArrow(run, shape).orderBy(*order).limit(most).toArrow()
    x = np.array(table.column("x").to_pylist(), np.float32).reshape(table.num_rows, len(FEATURES))
    return Model(lexicon, x, table.column("label").to_numpy().astype(np.float64), table.column("fold").to_numpy())


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """All columns of ``docs`` and its score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: trees and at most MAX_LEXICON entries
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for first, n, data, offsets in slices(batch.column(at)):
                part = batch.slice(first, n)
                x = features(data, offsets, model.lexicon)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(x))], names=[*part.schema.names, into])

    shape = docs.limit(0).withColumn(into, F.lit(0.0)).schema
    return docs.mapInArrow(run, shape)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels, id_col, text_col)
    scored = score(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    known, into = {c.lower() for c in docs.columns}, "_score"
    while into in known:
        into += "_"
    return score(docs, model, text_col, into).where(F.col(into) < threshold).drop(into)
