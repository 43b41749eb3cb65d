"""Whitening of vectors by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never formed.  It is only applied: a product with a few directions is one
pass over the rows, which centres them, multiplies, and adds up one row a task and entry.  The
directions live on the driver, as many numbers as dimensions times the size of the search space.

Each round takes Ritz vectors from the search space, locks the leading ones whose residual has
reached rounding, and widens the space for the others by solutions of their correction
equations (I-QQ')(V-eI)(I-QQ')t = -r, where Q holds the locked vectors and the Ritz vector.
MINRES solves them a few steps far, all of them side by side, so a step is one pass.

Entries are integers.  They are centred by whole numbers first: with sum S = m n + r, an entry
x gives (x - m) - r / n, which loses nothing to the size of x.

Cases: a row whose vector is null, or holds a null, a non-finite entry or one of 2^62 or more
in size is dropped, and so is one that is not as long as most vectors (ties: the longer ones);
null ids stay, repeated rows count each time; components whose eigenvalue is nothing but
rounding are left out, so equal rows, one row, vectors without entries and an empty table give
no rows.  A deviation beyond a long is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from votespan.llm.common import stash

#: Rows in one packed block.
BLOCK = 4096
LIMIT = 2**62


@dataclass
class Whitening:
    n: int
    whole: np.ndarray  # floor of each mean
    rest: np.ndarray  # what is left of the sums, below n
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    largest: int  # of the differences from the whole means


def scaled(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of each entry; null if the vector has an entry without a value."""
    fits = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * scale) < float(LIMIT))
    return F.when(F.coalesce(F.forall(vector, fits), F.lit(False)), F.transform(
        vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(shift).cast("long")))


def _matrix(batch: pa.RecordBatch, name: str, size: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _pack(size: int):
    """Blocks of rows, with exact sums of their entries in two halves."""

    def run(batches):
        for batch in batches:
            every = _matrix(batch, "x", size)
            for at in range(0, len(every), BLOCK):
                x = every[at : at + BLOCK]
                low = x & 0xFFFFFFFF
                small = np.abs(x).max() < 2**31
                yield pa.RecordBatch.from_pylist([{
                    "n": len(x), "high": ((x - low) >> 32).sum(axis=0).tolist(), "low": low.sum(axis=0).tolist(),
                    "least": x.min(axis=0).tolist(), "most": x.max(axis=0).tolist(),
                    "x": x.astype("<i4" if small else "<i8").tobytes()}], pa.schema([
                        ("n", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("high", "low", "least", "most")), ("x", pa.binary())]))

    return run


def _centred(block: bytes, n: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    width = len(block) // (n * len(whole))
    return (np.frombuffer(block, f"<i{width}").astype(np.int64).reshape(n, -1) - whole) - rest


def _blocks_of(batches):
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index("n")).to_pylist()
        for n, x in zip(sizes, batch.column(batch.schema.get_field_index("x"))):
            yield n, x.as_py()


class Covariance:
    """What a pass over the packed rows computes, summed over all tasks."""

    def __init__(self, blocks: DataFrame, n: int, whole: np.ndarray, rest: np.ndarray):
        self.blocks, self.n, self.size = blocks, n, len(whole)
        self.centre = whole, rest / n
        self.passes = 0

    def _summed(self, of, shape: tuple[int, ...], given: np.ndarray | None = None) -> np.ndarray:
        """The sum over all rows of ``of(centred rows, given)`` divided by their number."""
        sent = self.blocks.sparkSession.sparkContext.broadcast((*self.centre, given))

        def run(batches):
            whole, rest, given = sent.value
            total = None
            for n, x in _blocks_of(batches):
                one = np.ravel(of(_centred(x, n, whole, rest), given))
                total = one if total is None else total + one
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

        rows = self.blocks.select("n", "x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        sent.destroy()
        self.passes += 1
        out = np.zeros(int(np.prod(shape)))
        for r in rows:
            out[r["i"]] = r["v"]
        return out.reshape(shape) / self.n

    def trace(self) -> float:
        return float(self._summed(lambda c, _: [np.square(c).sum()], (1,))[0])

    def apply(self, directions: np.ndarray) -> np.ndarray:
        return self._summed(lambda c, q: c.T @ (c @ q), directions.shape, directions)

    def identity_error(self, scaled_vectors: np.ndarray) -> float:
        """How far the covariance of the whitened rows is from the identity."""
        k = scaled_vectors.shape[1]
        mean = self._summed(lambda c, q: (c @ q).sum(axis=0), (k,), scaled_vectors)

        def spread(c, given):
            w = c @ given[:-1] - given[-1]
            return w.T @ w

        found = self._summed(spread, (k, k), np.vstack([scaled_vectors, mean]))
        return float(np.abs(found - np.eye(k)).max())


def _without(vectors: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """Columns with their parts in the spaces taken out, twice against rounding."""
    for _ in range(2):
        for q in spaces:
            vectors = vectors - q @ (q.T @ vectors)
    return vectors


def minres(apply, right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, a column each; ``apply`` takes all columns at once."""
    solution = np.zeros_like(right)
    beta = np.linalg.norm(right, axis=0)
    tiny = np.finfo(float).tiny
    start, rest = beta.copy(), beta.copy()
    before, now = np.zeros_like(right), right / np.maximum(beta, tiny)
    w_before, w = np.zeros_like(right), np.zeros_like(right)
    old_beta = np.zeros_like(beta)
    d_bar, eps, cos, sin = (np.zeros_like(beta) for _ in range(4))
    cos -= 1
    live = beta > 0
    for _ in range(steps):
        # Lanczos: the next direction, orthogonal to the two before it.
        v = apply(now) - old_beta * before
        alpha = (now * v).sum(axis=0)
        v = v - alpha * now
        beta = np.linalg.norm(v, axis=0)
        # A plane rotation takes the new column of the tridiagonal matrix to triangular form.
        delta, g_bar, old_eps = cos * d_bar + sin * alpha, sin * d_bar - cos * alpha, eps
        eps, d_bar = sin * beta, -cos * beta
        gamma = np.hypot(g_bar, beta)
        live = live & (gamma > tiny)
        safe = np.where(live, gamma, 1.0)
        cos, sin = g_bar / safe, beta / safe
        phi = cos * rest
        w_before, w = w, (now - old_eps * w_before - delta * w) / safe
        solution += np.where(live, phi, 0.0) * w
        rest = sin * rest
        before, now, old_beta = now, v / np.where(beta > tiny, beta, 1.0), beta
        live = live & (beta > 1e-14 * start)
        if not (live & (rest > enough * start)).any():
            break
    return solution


def leading_eigenpairs(
    apply, size: int, wanted: int, floor: float = 0.0, steps: int = 8, rounds: int = 200, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``wanted`` largest eigenvalues above ``floor`` of a positive semidefinite matrix.

    ``apply`` multiplies it with the columns of a matrix.  Residuals end at rounding: the
    number of dimensions times the machine precision of the largest eigenvalue.
    """
    draws = np.random.default_rng(seed)
    wanted = min(wanted, size)
    locked, values = np.zeros((size, 0)), []
    room = max(8 * wanted, 4)
    space = np.linalg.qr(draws.standard_normal((size, wanted)))[0]
    image = apply(space)
    largest = 0.0
    for turn in range(rounds):
        inner = space.T @ image
        theta, turned = np.linalg.eigh((inner + inner.T) / 2)
        theta, turned = theta[::-1], turned[:, ::-1]
        space, image = space @ turned, image @ turned
        largest = max(largest, theta[0])
        precise = max(size, 16) * np.finfo(float).eps * largest
        open_ = wanted - len(values)
        while True:
            rest = _without(image[:, :open_] - space[:, :open_] * theta[:open_], locked)
            norms = np.linalg.norm(rest, axis=0)
            if norms[0] <= precise or norms[0] > 1e4 * precise:
                break
            # Near the end the images, turned round after round, are taken afresh.
            fresh = apply(space[:, :open_])
            change = np.linalg.norm(fresh - image[:, :open_])
            image[:, :open_] = fresh
            if change <= precise:
                break
        done = 0
        while done < len(norms) and norms[done] <= precise:
            done += 1
        values += theta[:done].tolist()
        locked = np.hstack([locked, space[:, :done]])
        space, image, theta, rest, norms = space[:, done:], image[:, done:], theta[done:], rest[:, done:], norms[done:]
        if len(values) == wanted or values and values[-1] <= max(floor, precise):
            break
        open_ = wanted - len(values)
        if space.shape[1] > room:
            space, image, theta = (x[..., : 2 * open_] for x in (space, image, theta))
        ritz, shift = space[:, : rest.shape[1]], theta[: rest.shape[1]]

        def projected(t, ritz=ritz):
            t = t - locked @ (locked.T @ t)
            return t - ritz * (ritz * t).sum(axis=0)

        if rest.shape[1]:
            more = minres(lambda t: projected(apply(p := projected(t)) - shift * p), projected(-rest), steps, 0.5 ** (turn + 2))
        else:
            more = np.zeros((size, 0))
        # Where the space has fewer columns than are wanted, chance fills it up.
        missing = min(open_ - rest.shape[1], size - locked.shape[1] - space.shape[1])
        more = np.hstack([more, draws.standard_normal((size, max(0, missing)))])
        more = more / np.maximum(np.linalg.norm(more, axis=0), np.finfo(float).tiny)
        more = _new_directions(more, locked, space, draws)
        if more.shape[1] == 0 and space.shape[1] == 0:
            break
        if more.shape[1]:
            space, image = np.hstack([space, more]), np.hstack([image, apply(more)])
        elif turn + 1 == rounds or norms.size and norms[0] > 1e4 * precise:
            image = apply(space)
    else:
        raise RuntimeError(f"{len(values)} of {wanted} eigenvectors after {rounds} rounds")
    values = np.array(values)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > max(floor, max(size, 16) * np.finfo(float).eps * largest)]
    return values[order], locked[:, order]


def _new_directions(more: np.ndarray, locked: np.ndarray, space: np.ndarray, draws) -> np.ndarray:
    """An orthonormal basis of what ``more`` adds to the spaces."""
    found = np.zeros((len(more), 0))
    for column in more.T:
        one = _without(column[:, None], locked, space, found)
        size = np.linalg.norm(one)
        if size <= 1e-10 and locked.shape[1] + space.shape[1] + found.shape[1] < len(more):
            # The equation gave nothing new.
            one = _without(draws.standard_normal((len(more), 1)), locked, space, found)
            size = np.linalg.norm(one)
        if size > 1e-10:
            found = np.hstack([found, _without(one / size, locked, space, found)])
            found[:, -1] /= np.linalg.norm(found[:, -1])
    return found


def fit_whitening(df: DataFrame, vector: str, components: int) -> Whitening | None:
    """From the arrays of longs in ``vector``; null ones are left out.  None if there is nothing to whiten."""
    present = df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("x"))
    common = present.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None or common["size"] == 0:
        return None
    size = common["size"]
    fields = ", ".join(f"{c} array<long>" for c in ("high", "low", "least", "most"))
    blocks = stash(present.where(F.size("x") == size).mapInArrow(_pack(size), f"n int, {fields}, x binary"), "vectors")
    # Kept in memory over the passes; a lost part is read from the shared folder again.
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        exact = lambda c: F.sum(F.col(f"e.{c}").cast("decimal(38,0)"))
        per_entry = blocks.select("n", F.posexplode(F.arrays_zip("high", "low", "least", "most")).alias("i", "e")).groupBy("i").agg(
            F.sum(F.col("n").cast("long")).alias("n"), exact("high").alias("high"), exact("low").alias("low"),
            F.min("e.least").alias("least"), F.max("e.most").alias("most")).orderBy("i").collect()
        n = per_entry[0]["n"]
        sums = [int(r["high"]) * 2**32 + int(r["low"]) for r in per_entry]
        whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
        largest = max(max(abs(r["least"] - int(m)), abs(r["most"] - int(m))) for r, m in zip(per_entry, whole))
        covariance = Covariance(blocks, n, whole, rest)
        trace = covariance.trace()
        if trace == 0:
            return None
        values, vectors = leading_eigenpairs(covariance.apply, size, components)
        error = covariance.identity_error(vectors / np.sqrt(values))
        return Whitening(n, whole, rest, vectors, values, trace, error, largest)
    finally:
        blocks.unpersist()


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over the entries of (n x - S)^2, exactly."""
    if x.shape[1] * ((model.largest + 1) * model.n) ** 2 < 2**63:
        return np.square(model.n * (x - model.whole) - model.rest).sum(axis=1).tolist()
    exact = np.square(model.n * (x - model.whole).astype(object) - model.rest.astype(object)).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str, vector: str, model: Whitening | None) -> DataFrame:
    """One row for each row with a vector and each component."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {WHITENED}"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    sent = df.sparkSession.sparkContext.broadcast(model.__dict__)
    size, k = model.vectors.shape

    def run(batches):
        import types

        model = types.SimpleNamespace(**sent.value)
        scaled_vectors = model.vectors / np.sqrt(model.values)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part, "x", size)
                w = ((x - model.whole) - model.rest / model.n) @ scaled_vectors
                rows = np.repeat(np.arange(len(x)), k)
                each = lambda values: pa.array(np.tile(values, len(x)))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(rows)), each(np.arange(1, k + 1, dtype=np.int32)),
                    pa.array(np.full(len(rows), model.n, np.int64)), pa.array(_deviations(x, model), pa.int64()).take(pa.array(rows)),
                    pa.array(w.ravel()), each(model.values / model.trace), pa.array(np.full(len(rows), model.identity_error))],
                    names=[id_col, *(f.split()[0] for f in WHITENED.split(", "))])

    rows = df.where(F.size(vector) == size).select(id_col, F.col(vector).alias("x"))
    return rows.mapInArrow(run, schema)
