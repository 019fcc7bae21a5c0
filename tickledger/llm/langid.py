"""Language identification: the family first, then one-versus-one linear SVMs within it.

Features are counts of hashed byte n-grams of the whole text (letters in lower case, everything else one
blank), square-rooted and scaled to length one. Families are learned: languages whose mean
features are alike are merged step by step until about the square root of their number is left. A linear
SVM for each pair of families, then one for each pair of languages of the chosen family, vote;
votes that tie are settled by the summed margins.

Training takes a bounded sample: for each language about `per_language` labelled texts, drawn by hash.
Features of the sample are made on the executors, one task trains on them, and the driver gets the weights only.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickledger.llm.base import rebatched

UNKNOWN = "und"
DIMENSIONS = 4096
GRAMS = (1, 2, 3, 4)
BATCH_ROWS = 128
LETTER = regex.compile(r"\p{L}")
OTHERS = re.compile(r"[\W\d_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Sampled rows per language and of all languages, SVM penalty and rounds, and how margins become scores."""

    per_language: int = 500
    most_rows: int = 8000
    penalty: float = 10.0
    rounds: int = 200
    steepness: float = 4.0


@dataclass
class Model:
    """Families of languages and, for each pair of them, weights whose sign tells the first from the second."""

    families: list[list[str]] = field(default_factory=list)
    between: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    within: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    steepness: float = 4.0

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language and score of one feature vector; the score is the product of both levels' shares."""
        return self.judge(x)[:2]

    def judge(self, x: np.ndarray) -> tuple[str, float, float]:
        """Language, score and the least margin by which the winners of both levels beat another.

        The score has a floor that depends on the number of languages, the margin has not: it is near zero for texts
        that are like none of them. With one language there is nothing to beat, and the margin is infinite.
        """
        if not self.families:
            return UNKNOWN, 0.0, 0.0
        family, first = self._vote(x, list(range(len(self.families))), self.between)
        language, second = self._vote(x, self.families[family], self.within)
        margin = min(self._margin(x, family, self.between), self._margin(x, language, self.within))
        return language, float(first * second), margin

    def _margin(self, x: np.ndarray, best, machines: dict) -> float:
        won = [(1 if a == best else -1) * float(x @ weights[:-1] + weights[-1]) for (a, b), weights in machines.items() if best in (a, b)]
        return min(won, default=float("inf"))

    def _vote(self, x: np.ndarray, names: list, machines: dict):
        if len(names) == 1:
            return names[0], 1.0
        votes, margins = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for (a, b), weights in machines.items():
            if a in votes and b in votes:
                margin = float(x @ weights[:-1] + weights[-1])
                votes[a if margin >= 0 else b] += 1
                margins[a] += margin
                margins[b] -= margin
        best = max(names, key=lambda n: (votes[n], margins[n]))
        shares = np.array([margins[n] for n in names]) * self.steepness / (len(names) - 1)
        shares = np.exp(shares - shares.max())
        return best, shares[names.index(best)] / shares.sum()


def features(text: str) -> np.ndarray:
    """The scaled n-gram vector of a text."""
    data = np.frombuffer(b" " + OTHERS.sub(" ", text.lower()).strip(" ").encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint64) + np.uint64(1)
    counts = np.zeros(DIMENSIONS)
    code = np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(data) < n:
            break
        code = code[: len(data) - n + 1] * np.uint64(257) + data[n - 1 :]
        if n in GRAMS:
            cells = ((code + np.uint64(n)) * _STEP) >> np.uint64(52)
            counts += np.bincount(cells.astype(np.int64), minlength=DIMENSIONS)
    scaled = np.sqrt(counts)
    return scaled / np.linalg.norm(scaled)


def sample_of(labelled: DataFrame, text: str, label: str, settings: Settings) -> DataFrame:
    """`text, label` of about `per_language` labelled texts with a letter of each language.

    A language gives the texts in a share of the hash range that follows from its number of different texts; copies
    count once, and the text with the smallest hash is always in.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where("label is not null")
    usable = rows.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    different = usable.select("label", F.xxhash64("text").alias("hash")).distinct()
    counts = different.groupBy("label").agg(F.count("*").alias("count"), F.min(F.pmod("hash", F.lit(1 << 30))).alias("least")).collect()
    each = min(settings.per_language, settings.most_rows / max(1, len(counts)))
    # one row per language; without the hint the planner, which does not know that, would move all texts first
    shares = F.broadcast(rows.sparkSession.createDataFrame([(r["label"], max(int((1 << 30) * min(1.0, each / r["count"])), r["least"] + 1)) for r in counts], "label string, upto long"))
    drawn = usable.join(shares, "label")
    return drawn.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("upto")).select("text", "label").distinct()


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", settings: Settings = Settings()) -> Model:
    """Train on `labelled`; without usable rows the model knows no language.

    The sample holds `most_rows` texts at most, so one task trains on it. Vectors are made where the texts are and
    move as their cells that are not 0; only the machines' weights reach the driver.
    """

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, BATCH_ROWS):
            made = [features(x).astype("<f4") for x in batch.column("text").to_pylist()]
            cells = [np.flatnonzero(v).astype("<u2") for v in made]
            columns = [pa.array([c.tobytes() for c in cells], pa.binary()), pa.array([v[c].tobytes() for v, c in zip(made, cells, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *columns], names=["label", "cells", "x"])

    def trained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in ("label", "cells", "x")], strict=True)]
        if rows:
            x = np.zeros((len(rows), DIMENSIONS), np.float32)
            for into, (_, cells, values) in zip(x, rows, strict=True):
                into[np.frombuffer(cells, "<u2")] = np.frombuffer(values, "<f4")
            labels = np.array([row[0] for row in rows], dtype=object)
            order = np.lexsort((*x.T[:8], labels.astype(str)))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(x, labels, order, settings))], pa.binary())], names=["model"])

    drawn = sample_of(labelled, text, label, settings).mapInArrow(vectors, "label string, cells binary, x binary")
    models = drawn.repartition(1).mapInArrow(trained, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else Model()


def train(x: np.ndarray, labels: np.ndarray, order: np.ndarray, settings: Settings) -> Model:
    """Both levels of machines from the rows of `x`, taken in `order` so that sums do not depend on how rows came."""
    languages = sorted(set(labels))
    means = np.array([x[order[labels[order] == n]].mean(axis=0) for n in languages])
    model = Model(families=families_of(means, languages), steepness=settings.steepness)
    family = {n: i for i, names in enumerate(model.families) for n in names}
    of = np.array([family[n] for n in labels])
    for a in range(len(model.families)):
        for b in range(a + 1, len(model.families)):
            model.between[a, b] = svm(x, order[of[order] == a], order[of[order] == b], settings)
    for names in model.families:
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                model.within[a, b] = svm(x, order[labels[order] == a], order[labels[order] == b], settings)
    return model


def families_of(means: np.ndarray, languages: list[str]) -> list[list[str]]:
    """Average-linkage clusters of the languages' mean features, about as many as the root of their number."""
    similar = means @ means.T / np.outer(norms := np.linalg.norm(means, axis=1), norms)
    groups = [[i] for i in range(len(languages))]
    while len(groups) > max(1, round(len(languages) ** 0.5)):
        _, i, j = max((similar[np.ix_(groups[i], groups[j])].mean(), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[-i] += groups.pop(-j)
    return sorted(sorted(languages[i] for i in g) for g in groups)


def svm(x: np.ndarray, first: np.ndarray, second: np.ndarray, settings: Settings) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss between two sets of rows, by accelerated gradients.

    Classes are weighted alike. Features have length one, so a margin's gradient is bounded by the row's length with bias.
    """
    own = x[np.concatenate([first, second])]
    y = np.concatenate([np.ones(len(first), np.float32), -np.ones(len(second), np.float32)])
    weight = (np.where(y > 0, 0.5 / len(first), 0.5 / len(second)) * settings.penalty).astype(np.float32)
    step = np.float32(1 / (1 + 2 * settings.penalty * 2))
    at = ahead = np.zeros(own.shape[1] + 1, np.float32)
    for k in range(settings.rounds):
        pull = 2 * weight * np.maximum(0, 1 - y * (own @ ahead[:-1] + ahead[-1])) * y
        gradient = ahead - np.append(pull @ own, pull.sum())
        before, at = at, ahead - step * gradient
        ahead = at + np.float32(k / (k + 3)) * (at - before)
    return at.astype(float)


def _place(schema: StructType, text: str) -> list[int] | None:
    """Where a row has its text, by positions of fields within fields; none if it is not found by exactly that name."""
    place: list[int] = []
    for name in text.split("."):
        if not isinstance(schema, StructType) or schema.names.count(name) != 1:
            return None
        place.append(schema.names.index(name))
        schema = schema.fields[place[-1]].dataType
    return place


def predict(docs: DataFrame, model: Model, text: str = "text", language: str = "lang_pred", score: str = "score", margin: str | None = None) -> DataFrame:
    """All columns of `docs`, the predicted language and a score from 0 to 1, from the whole text alone.

    With `margin`, a column of that name has the least margin of the winner, 0 where the language is `und`.

    Null texts and texts without a letter are `und` with score 0, and so is all where the model knows no language.
    Rows that repeat get equal results. Columns already named like a result are replaced. No shuffle.
    `text` may be a field of a struct (`doc.text`). It passes to Python within its row, not once more beside it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = docs.select(*[docs[c] for c in docs.columns if c not in (language, score, margin)])
    place = _place(row.schema, text)
    carried = docs.select(F.struct(*[docs[c] for c in row.columns]).alias("row"), *[docs[text].alias("value")] * (place is None))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, BATCH_ROWS):
            texts = batch.column(len(batch.columns) - 1)
            for at in place or []:
                texts = texts.field(at)
            found = [(UNKNOWN, 0.0, 0.0) if not x or not LETTER.search(x) else shared.value.judge(features(x)) for x in texts.to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), *[pa.array([f[k] for f in found], pa.float64()) for k in (1, 2)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", "language", "score", "margin"])

    row_type = carried.schema["row"].dataType.simpleString()
    made = carried.mapInArrow(run, f"row {row_type}, language string, score double, margin double")
    return made.select("row.*", F.col("language").alias(language), F.col("score").alias(score), *[F.col("margin").alias(m) for m in (margin,) if m])


def held_out(key: Column) -> Column:
    """Rows that training must not see: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))
