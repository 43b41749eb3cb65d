"""Packing documents into sequences by a configuration linear program.

Only the histogram of piece lengths (as many rows as a sequence has tokens) reaches the
driver.  A configuration is a multiset of lengths that fits a sequence.  Multiplicative
weights price the lengths, a knapsack by dynamic programming finds the configurations worth
most, lengths lose weight as they are covered, and the average over many small rounds solves
the program.  It is rounded down, the rest is packed by best fit, and best fit alone is taken
where it does better.  The result is a table of rank
ranges (length, first rank, sequence, offset) whose size depends on the sequence length only;
every piece finds its place by its rank among the pieces of its length.

Cases: null and empty texts hold the end id alone; texts longer than a sequence are cut into
full pieces after a first one that may be shorter; rows that repeat an id, or id and text,
are packed each by itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from votespan.llm.common import keyed, longs, slices, stash
from votespan.llm.tokens import encoder, read_vocabulary

SLICE = 2 << 20
PIECE = "k1 long, k2 long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def _pieces(vocabulary, end_id: int, most: int, keep_ids: bool):
    def run(batches):
        code = encoder(vocabulary.value)
        part = TaskContext.get().partitionId()
        seen = np.zeros(most + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text", SLICE, ("encoders",)):
            out = [[] for _ in range(9)]
            for k1, k2, raw in zip(*(batch.column(i).to_pylist() for i in (0, 1)), code.encode(batch.column(2))):
                ids = np.frombuffer(raw, code.width).astype("<u4").tobytes() + end
                n = len(ids) // 4
                cut = [0, *range(n % most or most, n + 1, most)]
                for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                    piece = ids[4 * a : 4 * b]
                    row = (k1, k2, i, a, b - a, zlib.crc32(piece), part, int(seen[b - a]), piece)
                    seen[b - a] += 1
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["k1", "k2", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
            n = 9 if keep_ids else 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[:n], kinds)], names=names[:n])

    return run


def token_pieces(
    docs: DataFrame, vocabulary_path: str, end_id: int, most: int, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """(k1, k2, piece, start, length, ids_crc32, part, rank[, ids]): ``rank`` counts a length in its ``part``."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    return stash(keyed(docs, id_col, text_col).mapInArrow(
        _pieces(vocabulary, end_id, most, keep_ids), PIECE + (", ids binary" if keep_ids else "")), "pieces")


class Knapsack:
    """The configurations worth most at given prices, for every room up to ``room``."""

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, room: int):
        self.lengths, self.room = lengths, room
        worth = np.zeros(room + 1)
        last = np.full(room + 1, -1)
        upto = np.searchsorted(lengths, np.arange(room + 1), "right")
        for c in range(int(lengths[0]), room + 1):
            k = upto[c]
            gains = worth[c - lengths[:k]] + prices[:k]
            best = int(gains.argmax())
            if gains[best] > worth[c - 1]:
                worth[c], last[c] = gains[best], best
            else:
                worth[c] = worth[c - 1]
        self.worth, self.last = worth, last
        #: Where the worth of a room was reached.
        self.reached = np.maximum.accumulate(np.where(last >= 0, np.arange(room + 1), 0))

    def through(self, which: np.ndarray) -> list[tuple[int, ...]]:
        """For each length (by index) the best configuration that holds it."""
        found = [[i] for i in which.tolist()]
        rows, space = np.arange(len(which)), self.room - self.lengths[which]
        while len(rows):
            at = self.reached[space]
            rows, at = rows[at > 0], at[at > 0]
            item = self.last[at]
            for row, i in zip(rows.tolist(), item.tolist()):
                found[row].append(i)
            space = at - self.lengths[item]
        return [tuple(sorted(f)) for f in found]


def solve_configurations(
    histogram: dict[int, int], room: int, rounds: int = 300, rate: float = 0.1, slack: float = 0.02, seed: int = 1,
) -> tuple[list[tuple[int, dict[int, int]]], int]:
    """([(how often, {length: times})], bound): covers the histogram exactly, no packing has fewer than ``bound`` sequences.

    A round takes, in random order, the configurations worth nearly the most (within ``slack``,
    less as rounds go on), each as often as the demand left in that round allows, so a length is
    covered at most once a round.  Prices fall by exp(-rate) for what was covered, and the
    average over the rounds is the solution.  Prices divided by what the knapsack is worth at
    them are a solution of the dual program, so they bound every packing from below.  Every
    25th round the average is rounded; rounds end when a plan reaches the bound.
    """
    bound = least_sequences(histogram, room)
    best = best_fit(histogram, room)
    full = histogram.get(room, 0)
    lengths = np.array(sorted(n for n, c in histogram.items() if c and n < room), np.int64)
    demand = np.array([histogram[n] for n in lengths.tolist()], float)
    draws = np.random.default_rng(seed)
    prices = lengths / room * (1 + 0.1 * lengths / room)
    covered, taken = np.zeros(len(lengths)), {}

    def size(plan):
        return sum(times for times, _ in plan)

    for t in range(1, rounds + 1 if len(lengths) else 0):
        if size(best) <= bound:
            break
        sack = Knapsack(lengths, prices, room)
        most = sack.worth[room]
        prices = prices / most
        bound = max(bound, full + int(np.ceil(float(demand @ prices) * (1 - 1e-12))))
        worth = prices + sack.worth[room - lengths] / most
        configurations = sack.through(np.flatnonzero(worth >= 1 - slack / (1 + t / 20)))
        left = demand.copy()
        for j in draws.permutation(len(configurations)).tolist():
            held = Counter(configurations[j])
            times = min(left[i] / m for i, m in held.items())
            if times > 0:
                for i, m in held.items():
                    left[i] -= times * m
                taken[configurations[j]] = taken.get(configurations[j], 0.0) + times
        share = 1 - left / demand
        covered += share
        # The last third moves prices less and less, for the sake of the bound.
        late = 3 * t - 2 * rounds
        prices = prices * np.exp(-rate * share * (1.0 if late <= 0 else 0.3 / (1 + late / 60)))
        if t % 25 == 0:
            for per_round in {1 / max(covered.min(), 1e-9), 1 / covered.mean(), 1.3 / covered.mean()}:
                best = min(best, _rounded(histogram, room, lengths, taken, per_round), key=size)
    return best, bound


def _rounded(histogram, room: int, lengths: np.ndarray, taken: dict[tuple[int, ...], float], per_round: float) -> list[tuple[int, dict[int, int]]]:
    """What was taken on average, rounded down, as far as there are pieces; the rest by best fit."""
    left, plan = dict(histogram), []
    for held, times in sorted(taken.items(), key=lambda x: -x[1]):
        config = Counter(lengths[list(held)].tolist())
        whole = min(int(times * per_round), *(left[n] // m for n, m in config.items()))
        if whole > 0:
            plan.append((whole, dict(config)))
            for n, m in config.items():
                left[n] -= whole * m
    return plan + best_fit(left, room)


def best_fit(histogram: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """The plan of best-fit decreasing: the longest piece first, into the fullest sequence that takes it.

    Sequences with the same pieces go together, so the work grows with the number of different
    lengths and not with the number of pieces.
    """
    groups: dict[int, list[tuple[int, dict[int, int]]]] = {}  # room left: (sequences, pieces in each)

    def put(space: int, times: int, config: dict[int, int]) -> None:
        if times:
            groups.setdefault(space, []).append((times, config))

    for n in sorted((n for n, c in histogram.items() if c), reverse=True):
        left = histogram[n]
        for space in sorted(s for s in groups if s >= n):
            # The fullest sequence stays the fullest, so it is filled before the next one.
            fits, waiting = space // n, groups.pop(space)
            for times, config in waiting:
                whole = min(times, left // fits)
                put(space - n * fits, whole, {**config, n: fits})
                left -= whole * fits
                rest = left if whole < times else 0
                put(space - n * rest, int(rest > 0), {**config, n: rest})
                left -= rest
                put(space, times - whole - (rest > 0), config)
            if not left:
                break
        fits = room // n
        put(room - n * fits, left // fits, {n: fits})
        put(room - n * (left % fits), int(left % fits > 0), {n: left % fits})
    return [group for space in sorted(groups) for group in groups[space]]


def least_sequences(histogram: dict[int, int], room: int) -> int:
    """No packing has fewer: by size, and by pieces over half, a third, ... of the room, of which few go together."""
    total = sum(n * c for n, c in histogram.items())
    bound = -(-total // room)
    for k in range(1, 9):
        # At most k pieces longer than room / (k + 1) fit one sequence.
        bound = max(bound, -(-sum(c for n, c in histogram.items() if n * (k + 1) > room) // k))
    # Pieces over half the room, with what cannot lie beside them.
    for small in sorted({n for n, c in histogram.items() if c and 2 * n <= room}):
        large = sum(c for n, c in histogram.items() if n > room - small)
        middle = sum(c for n, c in histogram.items() if 2 * n > room and n <= room - small)
        space = sum((room - n) * c for n, c in histogram.items() if 2 * n > room and n <= room - small)
        inner = sum(n * c for n, c in histogram.items() if small <= n and 2 * n <= room)
        bound = max(bound, large + middle + max(0, -(-(inner - space) // room)))
    return bound


def slot_table(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: ranks from there on count sequences up."""
    rows, used, sequence = [], {}, 0
    for times, config in plan:
        offset = 0
        for n in sorted(config, reverse=True):
            for _ in range(config[n]):
                rows.append((n, used.get(n, 0), sequence, offset))
                used[n] = used.get(n, 0) + times
                offset += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _place(table: np.ndarray):
    keys = (table[:, 0] << 44) + table[:, 1]

    def run(batches):
        for batch in batches:
            key = (longs(batch, "length") << 44) + longs(batch, "place")
            at = np.searchsorted(keys, key, "right") - 1
            sequence = table[at, 2] + key - keys[at]
            names = [c for c in batch.schema.names if c != "place"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(table[at, 3])],
                names=[*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, room: int) -> DataFrame:
    """``pieces`` of ``token_pieces`` with ``sequence_id`` and ``offset`` for ``part`` and ``rank``."""
    counts = stash(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slot_table(solve_configurations(histogram, room)[0])
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rest = [c for c in pieces.columns if c not in ("part", "rank")]
    # As many rows as parts and lengths: not a table to broadcast.
    placed = pieces.join(bases.hint("merge"), ["part", "length"]).select(*rest, (F.col("rank") + F.col("base")).alias("place"))
    fields = [f"{c} {pieces.schema[c].dataType.simpleString()}" for c in rest]
    return placed.mapInArrow(_place(table), ", ".join([*fields, "sequence_id long", "offset long"]))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): pieces with ids laid out in their sequences."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.transform(parts, lambda p: p["ids"]).alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
