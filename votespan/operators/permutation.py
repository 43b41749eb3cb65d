"""A shuffle that is computed instead of sorted.

Positions 0 .. n-1 are written as two digits to the bases a and b, a little more than the root
of n each, and stirred by alternating rounds: a hash of one digit is added to the other.  Each
round can be undone, so together they are a permutation, one for every seed, of a * b numbers.
A result of n or more is stirred again until it is below n (cycle walking), which keeps it a
permutation of 0 .. n-1.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from votespan.functions.arrays import bind

ROUNDS, PRIME = 6, 2147483647
#: Walks end within a steps; chance ends longer ones far earlier.
WALK = 64


def _mixed(x: Column, seed: int, turn: int) -> Column:
    """A hash of a digit, in arithmetic that stays within a long."""
    y = ((x + (seed * 7919 + turn * 104729 + 12345) % PRIME) * 48271) % PRIME
    return (y * y + y * (turn + 3)) % PRIME


def _stirred(x: Column, a: Column, b: Column, seed: int, back: bool) -> Column:
    def turned(digits: Column, turn: int) -> Column:
        high, low = digits["h"], digits["l"]
        if turn % 2:
            moved = _mixed(high, seed, turn) % b
            return F.struct(high.alias("h"), F.pmod(low - moved if back else low + moved, b).alias("l"))
        moved = _mixed(low, seed, turn) % a
        return F.struct(F.pmod(high - moved if back else high + moved, a).alias("h"), low.alias("l"))

    def run(digits: Column, turns: list[int]) -> Column:
        if not turns:
            return digits["h"] * b + digits["l"]
        return bind(turned(digits, turns[0]), lambda d: run(d, turns[1:]))

    start = F.struct(F.floor(x / b).cast("long").alias("h"), (x % b).alias("l"))
    return run(start, list(range(ROUNDS))[:: -1 if back else 1])


def _walked(position: Column, n, seed: int, back: bool) -> Column:
    n = (n if isinstance(n, Column) else F.lit(n)).cast("long")

    def go(sides: Column) -> Column:
        n, a, b = sides["n"], sides["a"], sides["b"]
        step = lambda x: _stirred(x, a, b, seed, back)
        again = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), x, lambda p, _: F.when(p < n, p).otherwise(step(p)))
        found = bind(step(sides["x"]), lambda p: F.when(p < n, p).otherwise(again(p)))
        return bind(found, lambda p: F.when(p < n, p).otherwise(F.raise_error(F.lit("the walk did not end"))))

    root = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    sides = F.struct(position.cast("long").alias("x"), n.alias("n"), root.alias("a"), F.ceil(n / root).cast("long").alias("b"))
    return F.when((position >= 0) & (position < n), bind(sides, go))


def shuffled(position: Column, n: Column | int, seed: int = 0) -> Column:
    """The place of row ``position`` of ``n`` in the shuffle ``seed``; null outside 0 .. n-1 (n up to 2^62)."""
    return _walked(position, n, seed, False)


def unshuffled(place: Column, n: Column | int, seed: int = 0) -> Column:
    """The row that stands at ``place`` of the shuffle: the other way round."""
    return _walked(place, n, seed, True)
