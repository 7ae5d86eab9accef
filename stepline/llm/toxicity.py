"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other, each by a logistic regression on words and
beginnings of words and on the probabilities of the categories before it.  For training,
those probabilities are out of fold: each labelled document gets them from models that
have not seen it, as an unseen document will; so a later model does not learn to trust the
earlier ones more than they deserve.  The final models are fitted on all folds.

How it runs.  Labelled documents for training are a bounded sample (``most_labelled``, those
whose ids hash lowest), so one task can fit them and the driver gets the models alone; features are counted in tasks.  Scoring
goes through all whole documents in place, without a shuffle; the model is as large as
``most_features`` entries for each category: features of at least four documents, those with the
strongest association first.  That is a limit of the model, not of the texts: each text is read whole.

Cases: a null or empty text has no features and gets the models' intercepts; a label that is
null is no label for that category; a document with several labels counts once for each; of rows that share an id, the least text is the one that is learnt from; with no
labelled documents, or only one class, a category's probability is its share among the
labelled ones (0 if there are none); repeated rows get equal scores; no rows give no rows;
other columns come through ``drop_toxic`` as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepline.llm.common import as_text

LETTERS = re.compile(r"[^\W\d_]+")
FOLDS = 5
#: Labelled documents that a chain is fitted on, at most.
MOST_LABELLED = 8_000
#: Features of a category's model, at most: those with the strongest association.
MOST_FEATURES = 400
PREFIXES = (4, 5)


def features_of_word(word: str) -> list[int]:
    names = [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]
    return [xxhash.xxh32_intdigest(x) - (1 << 31) for x in names]


class Features:
    """The set of hashed features of a text; words seen are remembered, up to a bound."""

    def __init__(self):
        self.known: dict[str, list[int]] = {}

    def __call__(self, text: str) -> set[int]:
        out: set[int] = set()
        for w in set(LETTERS.findall(text.lower())):
            if (x := self.known.get(w)) is None:
                if len(self.known) > 200_000:
                    self.known.clear()
                x = self.known[w] = features_of_word(w)
            out.update(x)
        return out


@dataclass
class Model:
    """One category's model: weights of features and of the earlier categories' log-odds."""

    intercept: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)
    earlier: list[float] = field(default_factory=list)

    def log_odds(self, found: set[int], before: list[float]) -> float:
        weights = self.weights
        return self.intercept + sum(weights[k] for k in weights.keys() & found) + sum(w * x for w, x in zip(self.earlier, before))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Sample:
    """Features of some documents as two flat arrays: a feature's number and its document's."""

    feature: np.ndarray
    doc: np.ndarray
    names: np.ndarray
    n_docs: int

    @classmethod
    def of(cls, found: list, least: int = 4) -> "Sample":
        """``found``: each document's distinct features.  Those of fewer than ``least`` documents are left out."""
        flat = np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32)
        doc = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])
        names, counts = np.unique(flat, return_counts=True)
        names = names[counts >= least]
        at = np.searchsorted(names, flat).astype(np.int32)
        at[at == len(names)] = 0
        known = names[at] == flat if len(names) else np.zeros(len(flat), bool)
        return cls(at[known], doc[known], names, len(found))


def fit(sample: Sample, rows: np.ndarray, before: np.ndarray, y: np.ndarray, most_features: int = MOST_FEATURES, penalty: float = 0.02, rounds: int = 25) -> Model:
    """Newton's method on the features that tell the classes apart most.  ``rows``: the documents to fit on, with ``before`` and ``y`` for each."""
    extra = before.shape[1]
    if not len(y):
        return Model(-30.0, {}, [0.0] * extra)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if y.min() == y.max():
        return Model(float(np.log(share / (1 - share))), {}, [0.0] * extra)
    place = np.full(sample.n_docs, -1, np.int32)
    place[rows] = np.arange(len(rows))
    row = place[sample.doc]
    feature, row = sample.feature[row >= 0], row[row >= 0]
    n, ones, m = len(y), float(y.sum()), len(sample.names)
    seen = np.bincount(feature, minlength=m).astype(float)
    hit = np.bincount(feature[y[row] > 0], minlength=m)
    expected = seen * ones / n
    strength = np.abs(hit - expected) / np.sqrt(expected * (1 - ones / n) * (1 - seen / n) + 0.5)
    best = np.lexsort((sample.names, -strength))[:most_features]
    best = best[strength[best] > 3]
    column = np.full(m, -1)
    column[best] = np.arange(len(best))
    x = np.zeros((n, 1 + extra + len(best)), np.float32)
    x[:, 0] = 1
    x[:, 1 : 1 + extra] = before
    used = column[feature] >= 0
    x[row[used], 1 + extra + column[feature[used]]] = 1
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty * n / 100 + 0.5)
    ridge[0] = 1e-3
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        slope = x.T @ (y - p) - ridge * w
        curve = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve.astype(float), slope)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return Model(float(w[0]), {int(k): float(v) for k, v in zip(sample.names[best], w[1 + extra :])}, [float(v) for v in w[1 : 1 + extra]])


def fit_chain(found: list, fold: np.ndarray, labels: np.ndarray, most_features: int = MOST_FEATURES) -> list[Model]:
    """``found``: each document's distinct features.  ``labels``: (documents, categories), NaN for none.  One model a category, in order."""
    sample, chain, before = Sample.of(found), [], np.zeros((len(found), 0))
    for k in range(labels.shape[1]):
        has = ~np.isnan(labels[:, k])

        def on(rows):
            at = np.flatnonzero(rows)
            return fit(sample, at, before[at], labels[at, k], most_features)

        out_of_fold = np.zeros(len(found))
        for f in range(FOLDS):
            if (fold == f).any():
                model = on(has & (fold != f))
                for i in np.flatnonzero(fold == f):
                    out_of_fold[i] = np.clip(model.log_odds(set(found[i].tolist()), before[i]), -10, 10)
        chain.append(on(has))
        before = np.column_stack([before, out_of_fold])
    return chain


def probabilities(chain: list[Model], found: set[int]) -> list[float]:
    before: list[float] = []
    for model in chain:
        before.append(float(np.clip(model.log_odds(found, before), -10, 10)))
    return [1 / (1 + float(np.exp(-x))) for x in before]


def _training_rows(batches):
    features = Features()
    for batch in batches:
        found = [np.fromiter(features(x), np.int32) for x in as_text(batch.column(1))]
        yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int32())), *batch.columns[2:]], names=["doc_id", "found", *batch.schema.names[2:]])


def _fit_rows(batches, n_categories):
    """The chain that rows (doc_id, found, y0, ...) give, a row for each category's model."""
    batches = list(batches)
    if not batches:
        return
    ys = [f"y{i}" for i in range(n_categories)]
    rows = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending"), *[(y, "ascending") for y in ys]])
    found = [x.values.to_numpy() for x in rows.column("found")]
    fold = np.array([xxhash.xxh32_intdigest(str(i)) % FOLDS for i in rows.column("doc_id").to_pylist()], np.int64)
    labels = np.column_stack([rows.column(y).to_numpy().astype(float) for y in ys])
    for k, m in enumerate(fit_chain(found, fold, labels)):
        columns = [pa.array([k], pa.int32()), pa.array([m.intercept]), pa.array([list(m.weights)], pa.list_(pa.int32())), pa.array([list(m.weights.values())], pa.list_(pa.float64())), pa.array([m.earlier], pa.list_(pa.float64()))]
        yield pa.record_batch(columns, names=["category", "intercept", "features", "weights", "earlier"])


def train_chain(docs: DataFrame, labels: DataFrame, categories: list, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED) -> list[Model]:
    """``categories``: columns of labels (1 yes, 0 no), by name, in the chain's order."""
    chosen = labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), *[c.cast("double").alias(f"y{i}") for i, c in enumerate(categories)])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), *chosen.columns).limit(most_labelled)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # the sample is bounded by most_labelled rows; of an id that many rows share, one text is taken
    own = texts.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    joined = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", *[f"y{i}" for i in range(len(categories))])
    schema = "doc_id long, found array<int>" + "".join(f", y{i} double" for i in range(len(categories)))
    rows = joined.select(F.col("doc_id").cast("long").alias("doc_id"), *joined.columns[1:]).mapInArrow(_training_rows, schema)
    # the sample goes to one task, which leaves the driver the models alone
    n = len(categories)
    models = rows.repartition(1).mapInArrow(lambda it: _fit_rows(it, n), "category int, intercept double, features array<int>, weights array<double>, earlier array<double>").collect()
    if not models:
        return fit_chain([], np.zeros(0, np.int64), np.zeros((0, n)))
    return [Model(m.intercept, dict(zip(m.features, m.weights)), list(m.earlier)) for m in sorted(models)]


def _score(batches, shared):
    features, chain = Features(), shared.value
    for batch in batches:
        scored = [probabilities(chain, features(x)) for x in as_text(batch.column(1))]
        yield pa.record_batch([batch.column(0), *(pa.array([s[k] for s in scored], pa.float64()) for k in range(len(chain)))], names=["doc_id", *(f"p{k}" for k in range(len(chain)))])


def score_toxicity(docs: DataFrame, chain: list[Model], names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and p_<category> for each category, one row a document."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = texts.mapInArrow(lambda it: _score(it, shared), "doc_id long" + "".join(f", p{k} double" for k in range(len(chain))))
    return out.toDF("doc_id", *[f"p_{x}" for x in names])


def _without(batches, shared, column, category, least):
    features, chain = Features(), shared.value
    for batch in batches:
        keep = [probabilities(chain, features(x))[category] < least for x in as_text(batch.column(column))]
        yield batch.filter(pa.array(keep, pa.bool_()))


def drop_toxic(docs: DataFrame, chain: list[Model], category: int, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents whose probability of the category is below ``least``, with all their columns and in place."""
    shared, at = docs.sparkSession.sparkContext.broadcast(chain), docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: _without(it, shared, at, category, least), T.StructType(docs.schema.fields))
