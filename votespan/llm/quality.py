"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(threshold_j - w.x): one weight vector over hashed text features shared
by all grades, and ordered thresholds.  It gives an expected grade and the probability of each
tail, P(grade >= j), to select by.

Features of a text: which words it holds (lower-cased ASCII, hashed), the share of each ASCII
mark, of capitals and digits, and the shares of words that repeat their neighbour or occur
before.  The weights are fitted by FTRL with an L1 penalty, so words that tell nothing weigh
nothing.  The fit reads a bounded sample (``sample``) of the documents joined with their
ratings; scoring reads every text whole.

Cases: null and empty texts have no words and are scored by their (zero) features; ratings
without grade or without a document are left out; rated documents that repeat an id are used
each by itself, those that repeat the text too are read once and count as often as they occur in
the sample; no ratings at all give a model that finds every grade equally likely; columns of
the documents other than id and text pass through unread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from votespan.llm.common import BASES, begin, byte_values, ranges_hash, slices, stash, text_bytes, text_of_rows, worker_cache

SLICE = 2 << 20
BITS = 18
#: Dense features: 33 ASCII marks, capitals, digits, repeated neighbours, words seen before, length.
MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
DENSE = len(MARKS) + 5


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased byte, whether it belongs to words, class of the byte among the dense features)."""
    kept = worker_cache()
    if "quality" not in kept:
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        inner = np.zeros(256, bool)
        inner[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
        kind = np.full(256, DENSE, np.int64)
        kind[MARKS] = np.arange(len(MARKS))
        kind[65:91] = len(MARKS)
        kind[48:58] = len(MARKS) + 1
        kept["quality"] = lower, inner, kind
    return kept["quality"]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word feature, its index, dense features of each text)."""
    lower, inner, kind = _tables()
    n = len(offsets) - 1
    ink = inner[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[edges] = ink[edges]
    last[edges - 1] = ink[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = text_of_rows(offsets, starts) if len(starts) else np.zeros(0, np.int64)
    words = ranges_hash(byte_values()[lower[data]], starts, ends, BASES[0])
    index = (words >> np.uint64(64 - BITS)).astype(np.int64)
    pairs = np.unique((doc << BITS) | index)
    n_words = np.maximum(np.bincount(doc, minlength=n), 1)
    distinct = np.bincount(pairs >> BITS, minlength=n)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    dense = np.zeros((n, DENSE))
    size = np.maximum(np.diff(offsets), 1)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    at = kind[data]
    seen = at < DENSE
    shares = np.bincount(owner[seen] * DENSE + at[seen], minlength=n * DENSE)[: n * DENSE].reshape(n, DENSE) / size[:, None]
    dense[:, :-3] = np.log1p(1000 * shares[:, :-3]) / 4
    dense[:, -3] = 4 * np.bincount(doc[same], minlength=n) / n_words
    dense[:, -2] = 2 * (1 - distinct / n_words)
    dense[:, -1] = np.log1p(n_words) / 8
    return pairs >> BITS, pairs & ((1 << BITS) - 1), dense


@dataclass
class OrdinalModel:
    """Shared weights (hashed words, then dense features) and ascending thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 .. number of thresholds."""
        return tails_of(self.thresholds, scores)


def tails_of(thresholds: np.ndarray, scores: np.ndarray) -> np.ndarray:
    return _sigmoid(scores[:, None] - thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def scores_of(weights: np.ndarray, doc: np.ndarray, index: np.ndarray, dense: np.ndarray) -> np.ndarray:
    words = np.bincount(doc, weights=weights[index], minlength=len(dense))[: len(dense)]
    return words + dense @ weights[1 << BITS :]


def fit_rows(
    rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, epochs: int = 8, batch: int = 64,
    rate: float = 1.0, l1: float = 1.0, l2: float = 0.001, seed: int = 5,
) -> OrdinalModel:
    """FTRL over (word indices, dense features) rows; thresholds start at the grades' shares."""
    size = (1 << BITS) + DENSE
    total, square = np.zeros(size), np.zeros(size)
    counts = np.bincount(grades, minlength=n_grades) + 1.0
    below = np.cumsum(counts)[:-1] / counts.sum()
    thresholds = np.log(below / (1 - below))
    # First threshold, then logs of the gaps, so that they stay in order.
    free = np.concatenate([thresholds[:1], np.log(np.maximum(np.diff(thresholds), 1e-3))])
    free_square = np.zeros(len(free))
    order, draw = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        draw.shuffle(order)
        for a in range(0, len(order), batch):
            chosen = order[a : a + batch]
            n = np.array([len(rows[i][0]) for i in chosen])
            index = np.concatenate([rows[i][0] for i in chosen])
            doc = np.repeat(np.arange(len(chosen)), n)
            dense = np.stack([rows[i][1] for i in chosen])
            at = np.concatenate([np.unique(index), np.arange(1 << BITS, size)])
            weights = np.zeros(size)
            weights[at] = _ftrl(total[at], square[at], rate, l1, l2)
            s = scores_of(weights, doc, index, dense)
            thresholds = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
            y = grades[chosen]
            upper = _sigmoid(np.append(thresholds, np.inf)[y] - s)
            lower = _sigmoid(np.concatenate([[-np.inf], thresholds])[y] - s)
            # Of -log(P(<= y) - P(<= y - 1)), by the score and by both thresholds.
            slope = 1 - upper - lower
            gap = np.maximum(upper - lower, 1e-9)
            g = np.bincount(index, weights=slope[doc], minlength=size)[:size]
            g[1 << BITS :] += dense.T @ slope
            g = g[at] / len(chosen) ** 0.5
            step = (np.sqrt(square[at] + g * g) - np.sqrt(square[at])) / rate
            total[at] += g - step * weights[at]
            square[at] += g * g
            by = np.zeros(n_grades + 1)
            np.add.at(by, y + 1, -upper * (1 - upper) / gap)
            np.add.at(by, y, lower * (1 - lower) / gap)
            by = by[1:-1]
            moves = np.cumsum(by[::-1])[::-1] * np.concatenate([[1.0], np.exp(free[1:])]) / len(chosen) ** 0.5
            free_square += moves * moves
            free -= rate * moves / (np.sqrt(free_square) + 1e-6)
    return OrdinalModel(_ftrl(total, square, rate, l1, l2), np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def _ftrl(total, square, rate, l1, l2):
    return np.where(np.abs(total) <= l1, 0.0, -(total - np.sign(total) * l1) / ((1 + np.sqrt(square)) / rate + l2))


def _feature_rows(batches):
    """(id, grade, t, copies, text) to the same with features; what a task has read before is left out."""
    seen = set()
    for batch in slices(batches, "text", SLICE):
        new = []
        for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
            if key not in seen:
                seen.add(key)
                new.append(i)
        if not new:
            continue
        batch = batch.take(pa.array(new))
        data, offsets = text_bytes(batch.column(4))
        doc, index, dense = features(data, offsets)
        ends = np.searchsorted(doc, np.arange(len(dense) + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(index.astype(np.int32)))
        flat = pa.array(dense.ravel())
        shares = pa.ListArray.from_arrays(pa.array((np.arange(len(dense) + 1) * DENSE).astype(np.int32)), flat)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in range(4)), lists, shares], names=["id", "grade", "t", "copies", "words", "dense"])


def _fit(n_grades: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("grade", "ascending"), ("t", "ascending")])
        rows = [(np.array(w.values, np.int64), np.array(d.values)) for w, d in zip(
            (x for c in table.column("words").chunks for x in c), (x for c in table.column("dense").chunks for x in c))]
        each = np.repeat(np.arange(len(rows)), table.column("copies").to_numpy())
        model = fit_rows([rows[i] for i in each], table.column("grade").to_numpy()[each], n_grades)
        return pa.table({
            "weights": pa.array([model.weights.astype("<f4").tobytes()], pa.binary()),
            "thresholds": pa.array([model.thresholds.astype("<f8").tobytes()], pa.binary())})

    return run


def sampled(
    docs: DataFrame, ratings: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000,
) -> DataFrame:
    """(id, grade, t, copies, text): of the rows of ``docs`` joined with ``ratings`` about ``sample`` at most.

    Rows that agree in id, grade and text (``t`` is its hash) are counted before they are joined
    and drawn together: ``copies`` of them are in the sample.  They may still come several times.
    """
    rated = ratings.select(F.col(id_col).cast("long").alias("id"), grade.cast("int").alias("grade")).where(
        "id is not null and grade is not null").groupBy("id", "grade").agg(F.count("*").alias("r"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    joined = stash(
        texts.groupBy("id", "t").agg(F.count("*").alias("d")).join(rated, "id").select(
            "id", "grade", "t", (F.col("d") * F.col("r")).alias("n")), "rated-texts")
    total = joined.agg(F.sum("n")).first()[0] or 0
    share = min(1.0, sample / max(1, total))
    draw = F.pmod(F.xxhash64("id", "t", "grade", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = joined.withColumn("copies", F.floor(F.col("n") * F.lit(share) + draw)).where("copies > 0").drop("n")
    # Not more keys than about ``sample``: texts that are not chosen are not shuffled.
    return texts.join(F.broadcast(chosen), ["id", "t"]).select("id", "grade", "t", "copies", "text")


def fit(
    docs: DataFrame, ratings: DataFrame, grade: Column, n_grades: int, id_col: str = "doc_id", text_col: str = "text",
    sample: int = 20_000,
) -> OrdinalModel:
    """``grade``: 0 .. n_grades - 1, an expression over ``ratings``; at most about ``sample`` rows are used."""
    rows = sampled(docs, ratings, grade, id_col, text_col, sample).mapInArrow(
        _feature_rows, "id long, grade int, t long, copies long, words array<int>, dense array<double>").dropDuplicates(["id", "grade", "t"])
    found = rows.groupBy(F.lit(0).alias("all")).applyInArrow(_fit(n_grades), "weights binary, thresholds binary").collect()
    if not found:
        even = np.arange(1, n_grades) / n_grades
        return OrdinalModel(np.zeros((1 << BITS) + DENSE), np.log(even / (1 - even)))
    return OrdinalModel(np.frombuffer(found[0]["weights"], "<f4").astype(float), np.frombuffer(found[0]["thresholds"], "<f8"))


def _score(shared):
    def run(texts: pa.Array) -> pa.Array:
        begin()
        weights, thresholds = shared.value
        data, offsets = text_bytes(texts)
        out = []
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE, "right")) - 1)
            doc, index, dense = features(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])
            out.append(scores_of(weights, doc, index, dense))
            start = stop
        tails = tails_of(thresholds, np.concatenate(out) if out else np.zeros(0))
        bounds = pa.array((np.arange(len(tails) + 1) * tails.shape[1]).astype(np.int32))
        return pa.ListArray.from_arrays(bounds, pa.array(tails.ravel()))

    return run


def rate(docs: DataFrame, model: OrdinalModel, text_col: str = "text", into: str = "tails") -> DataFrame:
    """Adds ``into``: P(grade >= 1), P(grade >= 2), ...; they sum to the expected grade.

    A column of that name is refused rather than lost.
    """
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already")
    # Arrays alone: a broadcast of the class would ask executors for this package.
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    run = _score(shared)

    @F.arrow_udf("array<double>")
    def tails(texts: pa.Array) -> pa.Array:
        return run(texts)

    return docs.withColumn(into, tails(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def expected_grade(tails: str) -> Column:
    return F.aggregate(tails, F.lit(0.0), lambda a, x: a + x)


def graded(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Ratings of the given tables as grades: 2 for good and harmless, one less for each flaw."""
    return F.col(quality) + 1 - F.col(toxic)


def good(tails: str, least: float = 0.7) -> Column:
    """Texts whose best grade is likely enough."""
    return F.element_at(tails, -1) >= least
