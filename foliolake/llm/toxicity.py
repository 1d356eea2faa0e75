"""Operator 7: toxicity by a classifier chain.

The chain predicts the label columns one after another (here low quality, then toxic): a logistic model for each
category reads the text's features and the probabilities of all earlier categories. While training, those earlier
probabilities are out-of-fold predictions, so that a later model sees them as it will when it scores new texts.

Features are selected words and word beginnings, present or not, and three shares. Invented or inflected words share
beginnings more than whole forms. Selection is by the likelihood ratio against each category, so that what remains is a
few hundred strings and a long text doesn't gather noise.

The models are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, chosen by a hash of the key). Strings are
counted and chosen on the executors, and the driver gets a 0/1 matrix of that many rows and ``MOST_FEATURES``
columns at most, no text. The models are broadcast. Scoring is one pass over the rows where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliolake.llm.common import drop, stored

#: Labelled rows to fit on at most; those whose keys hash lowest.
SAMPLE_ROWS = 6_000
MOST_FEATURES = 2_000
#: Rows that a feature must be in, and its least likelihood ratio.
SUPPORT, RATIO = 5, 20.0
#: Lengths of word beginnings.
BEGINNINGS = (3, 4, 5, 6, 7)
GATE = min(BEGINNINGS)
FOLDS = 5
RIDGE = 1e-4
STEPS = 200
#: Probability from which a document is toxic: toxic rows are rare among the labelled ones.
THRESHOLD = 0.3
SHARES = 3
PUNCTUATION = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
SIGNS = "#*$%&|<>!"


def _words(text: str) -> tuple[int, set[str]]:
    """How many words a text has, and its distinct ones without the signs around them."""
    every = text.lower().split()
    distinct = {x.strip(PUNCTUATION) for x in set(every)}
    distinct.discard("")
    return len(every), distinct


def _strings(word: str) -> list[str]:
    """A word's features: itself, and its beginnings marked by a sign that no word has."""
    return [word, *(word[:n] + "\n" for n in BEGINNINGS if len(word) > n)]


def _shares(text: str, n: int, distinct: int) -> list[float]:
    signs = sum(map(text.count, SIGNS)) / max(1, len(text))
    return [min(1.0, 10 * signs), 1 - distinct / max(1, n), float(n < 10)]


@dataclass
class Chain:
    """categories in order; features: string to row of ``held``; held: a weight for each feature and category; rest: for
    each category the weights of the shares, the earlier probabilities and the constant."""

    categories: list[str]
    features: dict[str, int]
    held: np.ndarray
    rest: list[np.ndarray]

    def probabilities(self, of_features: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """of_features: for each row and category the sum of the weights of the row's features."""
        out = np.zeros((len(shares), 0))
        for k, w in enumerate(self.rest):
            out = np.column_stack([out, _sigmoid(of_features[:, k] + _dense(shares, out) @ w)])
        return out


def _dense(shares: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return np.column_stack([shares, earlier, np.ones(len(shares))])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: np.ndarray, more: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Ridge logistic regression on the rows to use, by accelerated gradient steps; the last weight is the constant. x has
    one copy for all models: rows that aren't used have no weight."""
    d, n, use = x.shape[1], int(use.sum()), use.astype(float)
    w = np.zeros(d + more.shape[1])
    if not n or y[use > 0].min() == y[use > 0].max():
        w[-1] = 6 if n and y[use > 0][0] else -6
        return w

    def ahead(w: np.ndarray) -> np.ndarray:
        return x @ w[:d].astype(np.float32) + more @ w[d:]

    def back(g: np.ndarray) -> np.ndarray:
        g = g * use
        return np.concatenate([x.T @ g.astype(np.float32), more.T @ g])

    v = np.random.default_rng(0).normal(size=len(w))
    for _ in range(8):  # the largest eigenvalue of x'x, for the step
        v = back(ahead(v / np.linalg.norm(v)))
    step, seen, t = 1 / (0.25 * float(np.linalg.norm(v)) * 1.05 / n + RIDGE), w, 1.0
    for _ in range(STEPS):
        new, later = seen - step * (back(_sigmoid(ahead(seen)) - y) / n + RIDGE * seen), (1 + (1 + 4 * t * t) ** 0.5) / 2
        seen, w, t = new + (t - 1) / later * (new - w), new, later
    return w


def fit_chain(x: np.ndarray, shares: np.ndarray, labels: np.ndarray, categories: list[str], features: dict[str, int]) -> Chain:
    """A chain from a 0/1 matrix of features and a 0/1 matrix with one column a category. A category's earlier
    probabilities come from models that have not seen the row. Without rows every probability is near 0."""
    n, d = x.shape
    fold, every, earlier, weights = np.arange(n) % FOLDS, np.ones(n, bool), np.zeros((n, 0)), []
    for k in range(len(categories)):
        more, y, out = _dense(shares, earlier), labels[:, k], np.zeros(n)
        weights.append(_fit(x, more, y, every))
        for f in range(FOLDS if k + 1 < len(categories) else 0):
            w = _fit(x, more, y, fold != f)
            out[fold == f] = _sigmoid(x @ w[:d].astype(np.float32) + more @ w[d:])[fold == f]
        earlier = np.column_stack([earlier, out])
    return Chain(categories, features, np.column_stack([w[:d] for w in weights]), [w[d:] for w in weights])


def _ratio(positive: str, n: int, n_positive: int) -> Column:
    """Likelihood-ratio statistic of a feature in ``inside`` of n rows and in so many of the positive ones."""
    def term(a: Column, e: Column) -> Column:
        return F.when(a > 0, a * F.log(F.greatest(a, F.lit(1e-9)) / F.greatest(e, F.lit(1e-9)))).otherwise(0.0)

    inside, p = F.col("inside").cast("double"), F.col(positive).cast("double")
    cells = [(p, n_positive), (inside - p, n - n_positive)]
    return F.lit(2.0) * sum((term(a, inside * m / n) + term(m - a, (n - inside) * m / n) for a, m in cells), F.lit(0.0))


def select_features(sample: DataFrame, n_targets: int) -> list[str]:
    """The strings that tell a category best, ``MOST_FEATURES`` at most: each batch counts its rows with a string by label,
    Spark adds the counts up."""
    positives = [f"_p{k}" for k in range(n_targets)]

    def count(it):
        for batch in it:
            seen: dict[str, list[int]] = {}
            for t, *y in zip(*(batch.column(c).to_pylist() for c in ["_text", *(f"_y{k}" for k in range(n_targets))]), strict=True):
                for s in {s for w in _words(t)[1] for s in _strings(w)}:
                    got = seen.setdefault(s, [0] * (n_targets + 1))
                    got[0] += 1
                    for k in range(n_targets):
                        got[k + 1] += y[k]
            counts = np.array(list(seen.values()), np.int64).reshape(len(seen), n_targets + 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array(counts[:, k]) for k in range(n_targets + 1))], ["feature", "inside", *positives])

    rows = sample.agg(F.count(F.lit(1)), *(F.sum(f"_y{k}") for k in range(n_targets))).first()
    counts = sample.mapInArrow(count, f"feature string, inside long, {', '.join(f'{p} long' for p in positives)}")
    summed = counts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ["inside", *positives])).where(F.col("inside") >= SUPPORT)
    best = F.greatest(F.lit(0.0), *(_ratio(p, rows[0], rows[k + 1] or 0) for k, p in enumerate(positives)))
    return [r[0] for r in summed.select("feature", best.alias("score")).where(F.col("score") >= RATIO).orderBy(F.desc("score"), "feature").limit(MOST_FEATURES).collect()]


def sampled(docs: DataFrame, labels: DataFrame, targets: dict[str, tuple[str, int]], id_col: str, text_col: str, sample_rows: int) -> DataFrame:
    """The labelled rows to fit on: _id, _text, and _y0, _y1, ... (0 or 1) for each target."""
    known = labels.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in [id_col, *(c for c, _ in targets.values())])))
    slim = known.select(F.col(f"`{id_col}`").alias("_id"), *((F.col(f"`{c}`") == v).cast("int").alias(f"_y{k}") for k, (c, v) in enumerate(targets.values())))
    slim = slim.groupBy("_id").agg(*(F.max(f"_y{k}").alias(f"_y{k}") for k in range(len(targets))))
    some = slim.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).where("_text IS NOT NULL")
    return texts.join(F.broadcast(some), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), *(F.max(f"_y{k}").alias(f"_y{k}") for k in range(len(targets))))


def train(docs: DataFrame, labels: DataFrame, targets: dict[str, tuple[str, int]], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Fits a chain. targets: category to (label column, value that counts as positive), in the chain's order.

    It is fitted on ``sample_rows`` labelled rows at most, those whose keys hash lowest. Labels with a null key or value
    are left out; a document with several labels has a category if one of them says so; of several texts of a labelled
    id the least is used, and null texts are not. Texts stay on the executors: they count strings by label and then send
    the chosen ones that a text has, as numbers. Without labelled rows every probability is near 0.
    """
    sample = stored(sampled(docs, labels, targets, id_col, text_col, sample_rows), "toxicity-sample")
    features = {s: j for j, s in enumerate(select_features(sample, len(targets)))}
    held, ys = sample.sparkSession.sparkContext.broadcast(features), [f"_y{k}" for k in range(len(targets))]

    def read(it):
        find = held.value.get
        for batch in it:
            found, shares = [], []
            for t in batch.column("_text").to_pylist():
                n_words, distinct = _words(t)
                found.append(sorted({c for w in distinct for s in _strings(w) if (c := find(s)) is not None}))
                shares.append(_shares(t, n_words, len(distinct)))
            made = [pa.array(found, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["_id", *ys]), *made], ["_id", *ys, "columns", "shares"])

    schema = T.StructType([sample.schema["_id"], *(sample.schema[c] for c in ys), T.StructField("columns", T.ArrayType(T.IntegerType())), T.StructField("shares", T.ArrayType(T.DoubleType()))])
    got = sample.mapInArrow(read, schema).orderBy("_id").toArrow().combine_chunks()
    drop(sample)
    n, columns = got.num_rows, got.column("columns").combine_chunks()
    x = np.zeros((n, len(features)), np.float32)
    x[np.repeat(np.arange(n), pa.compute.list_value_length(columns).to_numpy(zero_copy_only=False)), columns.flatten().to_numpy(zero_copy_only=False)] = 1
    shares = got.column("shares").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, SHARES)
    y = np.column_stack([got.column(c).to_numpy().astype(float) for c in ys]).reshape(n, len(targets))
    return fit_chain(x, shares, y, list(targets), features)


def score(df: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``df`` with a double column ``p_<category>`` for each category of the chain, 0 to 1.

    A null text counts as empty. Rows are scored alone; other columns stay as they are, but one that has a probability's
    name is replaced. An empty table gives an empty table.
    """
    held = df.sparkSession.sparkContext.broadcast(chain)
    made = [f"p_{c}" for c in chain.categories]
    kept = [c for c in df.columns if c not in made]
    given = df.select(*(F.col(f"`{c}`") for c in kept))
    schema = T.StructType([*given.schema.fields, *(T.StructField(c, T.DoubleType()) for c in made)])

    def run(it):
        chain = held.value
        find = chain.features.get
        starts = {f.rstrip("\n")[:GATE] for f in chain.features}  # most words begin like no feature, and are done with that

        for batch in it:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                of_features = np.zeros((part.num_rows, len(made)))
                shares = np.zeros((part.num_rows, SHARES))
                for i, t in enumerate(part.column(text_col).to_pylist()):
                    n_words, distinct = _words(t or "")
                    shares[i] = _shares(t or "", n_words, len(distinct))
                    has = {find(s) for w in distinct if w[:GATE] in starts for s in _strings(w)} - {None}
                    of_features[i] = chain.held[sorted(has)].sum(axis=0)
                p = chain.probabilities(of_features, shares)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(p[:, k]) for k in range(len(made)))], [*kept, *made])

    return given.mapInArrow(run, schema)


#: The categories that the table ``labels`` has.
TARGETS = {"low_quality": ("quality", 0), "toxic": ("toxic", 1)}
