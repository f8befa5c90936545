"""Quality by ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import col, fresh
from .simhash import word_lists

#: Grades: toxic, poor, good.
GRADES = 3
DIMENSIONS = 1 << 32
#: The model is fitted on at most this many rated documents, those with the least hash of their id.
FIT_ROWS = 8192
ROUNDS = 240
PENALTY = 0.5
#: Rows weigh by this power of their grade's rarity: 0 all rows alike, 1 all grades alike.
BALANCE = 0.3
#: Above this many distinct words, each counts for less, by the power given.
FULL_WORDS, DAMPING = 64, 0.4
#: Longer words also count by so many bytes of their beginning, which stand for their stem.
STEM_BYTES = 4
KEEP_FROM = 0.5
_EDGES = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
# Each byte of a word as its class: upper case, lower case or beyond ASCII, digit, sign. Runs of letters and digits count once.
_CLASS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else 35 for b in range(256))
_REPEATED = re.compile(rb"([Aa9])\1+")


@dataclass(frozen=True)
class Model:
    """Shared weights of the hashed features that the fit has seen, and ordered thresholds; without these, an unfitted model."""

    index: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    dimensions: int = DIMENSIONS

    def linear(self, index: np.ndarray, value: np.ndarray) -> float:
        at = np.minimum(np.searchsorted(self.index, index), len(self.index) - 1)
        return float((self.weights[at] * value)[self.index[at] == index].sum())


def features(data: bytes, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text: indices, ascending, and values.

    One for each distinct lower-case word and each distinct word beginning, of less value in long texts so that words do not
    outvote all else; for each shape of word and for immediate repeats, the root of its share of the words; and one for the
    length, in octaves.
    """
    words: set[bytes] = set()
    shapes: Counter[bytes] = Counter()
    repeats = total = 0
    last = b""
    for part in word_lists(data):
        counts = Counter(part)
        repeats += sum(a == b for a, b in zip([last, *part], part, strict=False))
        last = part[-1] if part else last
        total += len(part)
        words.update(w.lower().strip(_EDGES) for w in counts)
        for word, n in counts.items():
            shapes[_REPEATED.sub(rb"\1", word.translate(_CLASS))[:12]] += n
    words.discard(b"")
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    stems = {w[:STEM_BYTES] for w in words if len(w) > STEM_BYTES}
    names = [b"w " + w for w in words] + [b"p " + p for p in stems] + [b"s " + s for s in shapes]
    names += [b"r", b"n %d" % total.bit_length()]
    share = np.sqrt(np.array([*shapes.values(), repeats], np.float32) / total) * 4
    each = [np.full(n, min(1.0, (FULL_WORDS / max(n, 1)) ** DAMPING), np.float32) for n in (len(words), len(stems))]
    values = np.concatenate([*each, share, np.full(1, 4, np.float32)])
    index = np.fromiter(map(xxhash.xxh32_intdigest, names), np.int64, len(names)) % dimensions
    unique, where = np.unique(index, return_inverse=True)
    return unique, np.bincount(where, values).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int = GRADES, dimensions: int = DIMENSIONS,
        rounds: int = ROUNDS, penalty: float = PENALTY) -> Model:
    """Weights w and thresholds t with P(grade <= k) = sigmoid(t_k - w x), by penalised likelihood (Adam, all rows a step)."""
    if not rows or len(set(grades.tolist())) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0), dimensions)
    sizes = np.array([len(i) for i, _ in rows])
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), sizes)
    used, index = np.unique(index, return_inverse=True)
    share = np.cumsum(np.bincount(grades, minlength=levels) + 1)[:-1] / (len(grades) + levels)
    start = np.log(share / (1 - share))
    # Thresholds are the first one and the logarithms of the steps, so they stay ordered.
    theta = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    n = len(used)
    weight = np.bincount(grades, minlength=levels).clip(1)[grades] ** -BALANCE
    weight *= len(grades) / weight.sum()
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        cuts = np.concatenate([[-np.inf], theta[n] + np.concatenate([[0], np.cumsum(np.exp(theta[n + 1 :]))]), [np.inf]])
        score = np.bincount(row, value * theta[index], len(rows))
        above, below = _sigmoid(cuts[grades + 1] - score), _sigmoid(cuts[grades] - score)
        chance = np.maximum(above - below, 1e-9)
        up, down = above * (1 - above) / chance * weight, below * (1 - below) / chance * weight
        gradient = np.zeros_like(theta)
        pull = up - down  # d loss / d score
        gradient[:n] = np.bincount(index, value * pull[row], n) + penalty * theta[:n]
        at_cut = np.bincount(grades, -up, levels)[: levels - 1] + np.bincount(grades, down, levels)[1:]
        gradient[n] = at_cut.sum()
        gradient[n + 1 :] = np.exp(theta[n + 1 :]) * at_cut[::-1].cumsum()[::-1][1:]
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta = theta - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return Model(used, theta[:n].astype(np.float32), theta[n] + np.concatenate([[0], np.cumsum(np.exp(theta[n + 1 :]))]), dimensions)


def score(model: Model, data: bytes) -> tuple[float, float]:
    """(expected grade, probability of the highest grade)."""
    if not len(model.thresholds):
        return float("nan"), float("nan")
    exceed = 1 - _sigmoid(model.thresholds - model.linear(*features(data, model.dimensions)))
    return float(exceed.sum()), float(exceed[-1])


def graded(ratings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, grade) of a table of ratings: 0 toxic, 1 poor, 2 good; rows that say neither are left out.

    A document rated more than once has its lowest grade.
    """
    quality = F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    grade = F.when(F.col("toxic") == 1, 0).otherwise(quality)
    return ratings.select(col(id_col).alias("doc_id"), grade.alias("grade")).filter(
        "doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """The model of at most ``fit_rows`` graded documents. Features are made where the documents are.

    Fewer than two grades, or no graded documents, give an unfitted model. Of rows that share an id, the one whose
    text has the least digest is taken, so the model does not depend on the order of rows.
    """
    chosen = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(v.as_py() or b"") for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), batch.column(3), pa.array([i.tolist() for i, _ in made], pa.list_(pa.int64())),
                 pa.array([v.tolist() for _, v in made], pa.list_(pa.float32()))],
                ["doc_id", "grade", "digest", "index", "value"],
            )

    text = F.coalesce(col(text_col).cast("binary"), F.lit(b""))
    texts = docs.select(col(id_col).alias("doc_id"), text.alias("text"), F.md5(text).alias("digest"))
    joined = texts.join(F.broadcast(chosen), "doc_id").select("text", "doc_id", F.col("grade").cast("int").alias("grade"), "digest")
    kind = joined.schema["doc_id"].dataType.simpleString()
    table = joined.mapInArrow(run, f"doc_id {kind}, grade int, digest string, index array<long>, value array<float>")
    # At most one document per chosen id, so that repeated rows do not lift the bound.
    first = table.groupBy("doc_id").agg(F.min_by(F.struct("grade", "index", "value"), "digest").alias("row"))
    rows = first.select("doc_id", "row.*").toArrow().sort_by("doc_id").combine_chunks()
    if not rows.num_rows:
        return fit([], np.zeros(0, np.int64))
    index, value = (rows[name].chunk(0) for name in ("index", "value"))
    cuts = index.offsets.to_numpy().tolist()
    flat = index.values.to_numpy(), value.values.to_numpy()
    lists = [tuple(f[a:b] for f in flat) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return fit(lists, rows["grade"].to_numpy().astype(np.int64))


def with_quality(docs: DataFrame, model: Model, text_col: str = "text", keep_from: float = KEEP_FROM) -> tuple[DataFrame, list[str]]:
    """``docs`` with expected grade, tail probability and verdict, and the names of these three columns.

    The tail probability is that of the highest grade; a document is kept from ``keep_from`` on. Missing text counts as
    empty. An unfitted model keeps every document, with missing scores. Whole texts are scored, in the rows they are in.
    """
    text = fresh(docs.columns, "text_bytes")
    names = [fresh(docs.columns, n) for n in ("expected_grade", "tail_probability", "kept")]
    place = len(docs.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(model, v.as_py() or b"") for v in batch.column(place)]
            grade, tail = (pa.array([s[k] for s in scores], pa.float64(), from_pandas=True) for k in (0, 1))
            keep = pa.array([not s[1] < keep_from for s in scores], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], grade, tail, keep], [*batch.schema.names[:place], *names])

    kinds = (DoubleType(), DoubleType(), BooleanType())
    schema = StructType([*docs.schema, *[StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    return docs.withColumn(text, col(text_col).cast("binary")).mapInArrow(run, schema), names


def quality(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) for every row of ``docs``; empty tables give empty results."""
    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    model = train(narrow, graded(ratings))
    scored, names = with_quality(narrow, model)
    return scored.select("doc_id", *names)


def keep_good(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents the model keeps, with all their columns."""
    scored, names = with_quality(docs, train(docs, graded(ratings), id_col, text_col), text_col)
    return scored.filter(col(names[2])).select(*[col(c) for c in docs.columns])
