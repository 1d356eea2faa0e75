"""Operator 2: language identification by string kernels.

The kernel of two texts is the number of letter n-grams (n = 1, 2, 3 blended) that both contain, divided by the geometric
mean of how many each contains: presence counts, not frequency. It is computed on the n-grams of a set of landmark
texts, so that a text's kernel values against all landmarks are one product of its presence row with the landmarks'
presence matrix. Nystroem's method turns them into features whose inner products approximate the kernel, and one-versus-
rest kernel ridge regression is linear in these. Batches of texts are scored by matrix products alone.

The models are fitted on a bounded sample of labelled rows (``SAMPLE_PER_LANGUAGE`` of each language and ``SAMPLE_ROWS`` in
all at most, those whose keys hash lowest) and broadcast; ``LANDMARKS``, ``ALPHABET`` and ``MOST_GRAMS`` bound their size.
Executors turn the sample's whole texts into sets of n-grams, which the alphabet bounds; the driver gets these alone.
Scoring is one pass over the rows where they lie, over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.llm.common import drop, stored

#: Labelled rows to fit on, of a language and in all; one of each language where there are more languages than rows.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 300, 6_000
LANDMARKS = 96
#: Distinct letters that are told apart (the most frequent in the sample); others are one class.
ALPHABET = 120
MOST_GRAMS = 12_000
RIDGE = 1e-2
UNDETERMINED = "und"
_POINTS = 0x110000


def letter_classes(letters: str) -> np.ndarray:
    """For each code point its class: 0 for what isn't a letter, 1 for a letter not in ``letters``, else 2 and up; upper
    and lower case share a class."""
    import sys

    out = np.zeros(_POINTS, np.uint8)
    every = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, _POINTS)
    out[every] = 1
    for i, c in enumerate(letters):
        for x in {c, c.upper(), c.lower()}:
            if len(x) == 1:
                out[ord(x)] = i + 2
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Grams:
    """Marks which n-grams over the letter classes a text contains."""

    def __init__(self, letters: str):
        self.classes, self.base = letter_classes(letters), len(letters) + 2
        b = self.base
        self.seen = np.zeros(b + b * b + b * b * b, bool)

    def codes(self, text: str) -> list[np.ndarray] | None:
        """Codes of the text's 1-, 2- and 3-grams; None if it has no letter."""
        c = self.classes[_points(text)].astype(np.int32)
        if not c.any():
            return None
        c = c[(c > 0) | (np.concatenate([[1], c[:-1]]) > 0)]  # a run of other characters is one boundary
        b, two = self.base, c[:-1] * self.base + c[1:]
        return [c, b + two, b + b * b + two[:-1] * b + c[2:]]

    def present(self, text: str, of: np.ndarray) -> np.ndarray | None:
        """For each code in ``of``, whether the text contains it."""
        codes = self.codes(text)
        if codes is None:
            return None
        for x in codes:
            self.seen[x] = True
        out = self.seen[of]
        for x in codes:
            self.seen[x] = False
        return out


@dataclass
class Kernel:
    """languages; letters; grams: codes of the landmarks' n-grams; landmarks: their presence matrix, transposed and scaled;
    weights: from kernel values to one-versus-rest scores, the last row the constants."""

    languages: list[str]
    letters: str
    grams: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, present: np.ndarray) -> np.ndarray:
        """Scores of texts from their presence rows."""
        x = present.astype(np.float32)
        k = (x @ self.landmarks) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return k @ self.weights[:-1] + self.weights[-1]


def fit(letters: str, texts: list[np.ndarray], langs: list[str]) -> Kernel:
    """A model from the sorted codes of labelled texts' n-grams; without any, one that knows no language."""
    names = sorted(set(langs))
    rows = [(c, names.index(x)) for c, x in zip(texts, langs, strict=True)]
    if not rows:
        return Kernel([], letters, np.zeros(0, int), np.zeros((0, 0), np.float32), np.zeros((1, 0), np.float32))
    # Landmarks: as many of each language, the texts with the most n-grams first.
    each = -(-LANDMARKS // max(1, len(names)))
    own: list[list[np.ndarray]] = [[] for _ in names]
    for c, k in rows:
        own[k].append(c)
    marks = [c for o in own for c in sorted(o, key=len, reverse=True)[: 2 * each : 2]]
    codes, n = np.unique(np.concatenate(marks), return_counts=True)
    codes = np.sort(codes[np.argsort(-n, kind="stable")][:MOST_GRAMS])

    def matrix(of: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(of), len(codes)), np.float32)
        for i, c in enumerate(of):
            place = np.searchsorted(codes, c)
            place[place == len(codes)] = 0
            out[i, place[codes[place] == c]] = 1
        return out

    m = matrix(marks)
    m /= np.sqrt(np.maximum(m.sum(1, keepdims=True), 1))
    value, vector = np.linalg.eigh((m @ m.T).astype(float))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])  # Nystroem: kernel values times this are the features
    parts = (matrix([c for c, _ in rows[k : k + 256]]) for k in range(0, len(rows), 256))
    x = np.concatenate([(p @ m.T) / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1)) for p in parts]) @ root
    y = np.array([k for _, k in rows])
    target, mean = np.eye(len(names))[y], x.mean(0)
    weigh = np.sqrt(len(y) / (len(names) * np.bincount(y, minlength=len(names))[y]))[:, None]  # languages count alike
    z, t0 = (x - mean) * weigh, (target - target.mean(0)) * weigh
    a = np.linalg.solve(z.T @ z + RIDGE * len(y) * np.eye(z.shape[1]) / z.shape[1], z.T @ t0)
    w = np.vstack([root @ a, target.mean(0) - mean @ a])
    return Kernel(names, letters, codes, np.ascontiguousarray(m.T), w.astype(np.float32))


def held_out(id_col: str = "doc_id") -> Column:
    """The contract's split: rows never learnt from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, sample_rows: int) -> DataFrame | None:
    """The rows to learn from, mark, text and lang, with a share by hash taken first; None without any."""
    i, lang, text = F.col(f"`{id_col}`"), F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    known = df.where(lang.isNotNull() & i.isNotNull() & text.isNotNull() & ~held_out(id_col))
    counts = {r["l"]: r["n"] for r in known.groupBy(lang.cast("string").alias("l")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = max(1, min(per_language, sample_rows // len(counts)))
    mark = F.pmod(F.xxhash64(i), F.lit(1_000_000))
    share = F.create_map(*(x for l, n in sorted(counts.items()) for x in (F.lit(l), F.lit(int(min(1.0, 2 * each / n) * 1_000_000) + 1))))  # noqa: E741
    some = known.where(mark < share[lang.cast("string")]).select(mark.alias("mark"), text.alias("text"), lang.cast("string").alias("lang"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "text"))
    return some.withColumn("n", first).where(F.col("n") <= each).drop("n")


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Kernel:
    """Fits the kernel on a sample of the rows that have a language, a text and a key and aren't held out. Rows with a
    null in one of these are not learnt from. The languages are counted over all rows first, from narrow columns."""
    some = sampled(df, id_col, text_col, lang_col, per_language, sample_rows)
    if some is None:
        return fit("", [], [])
    some = stored(some, "language-sample")

    def letters_of(it):
        for batch in it:
            seen = [c for t in batch.column("text").to_pylist() for c in set(t.lower()) if c.isalpha() and len(c) == 1]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], ["letter"])

    found = some.mapInArrow(letters_of, "letter string").groupBy("letter").agg(F.count("*").alias("n"))
    letters = "".join(sorted(r["letter"] for r in found.orderBy(F.desc("n"), "letter").limit(ALPHABET).collect()))

    def grams_of(it):
        grams = Grams(letters)
        for batch in it:
            codes = [grams.codes(t) for t in batch.column("text").to_pylist()]
            made = pa.array([None if c is None else np.unique(np.concatenate(c)).tolist() for c in codes], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("mark"), batch.column("lang"), made], ["mark", "lang", "codes"])

    rows = some.mapInArrow(grams_of, "mark bigint, lang string, codes array<int>").where("codes IS NOT NULL").orderBy("mark", "lang", "codes").toArrow()
    drop(some)
    return fit(letters, [x.values.to_numpy() for x in rows.column("codes")], rows.column("lang").to_pylist())


def predict(df: DataFrame, model: Kernel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``df`` with the predicted language and its score, 0 to 1, from the text alone.

    The language is that of the highest score, which is then cut to 0 to 1. A null text, or one without letters, is ``und``
    with score 0; so is every text where the model knows no language. Ties go to the first language in the alphabet. Other columns stay as they are, but those with the two names are
    replaced. An empty table gives an empty table.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in (lang_out, score_out)]
    given = df.select(*(F.col(f"`{c}`") for c in kept))
    from pyspark.sql import types as T

    schema = T.StructType([*given.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(it):
        model, grams = held.value, None
        for batch in it:
            grams = grams or Grams(model.letters)
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [grams.present(t, model.grams) if t else None for t in part.column(text_col).to_pylist()]
                lang, score = [UNDETERMINED] * len(found), np.zeros(len(found))
                rows = [i for i, x in enumerate(found) if x is not None]
                if rows and model.languages:
                    s = model.scores(np.stack([found[i] for i in rows]))
                    for i, b, x in zip(rows, s.argmax(1).tolist(), np.clip(s.max(1), 0, 1).tolist(), strict=True):
                        lang[i], score[i] = model.languages[b], x
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score)], [*kept, lang_out, score_out])

    return given.mapInArrow(run, schema)
