"""Random draws as pure functions of their key, so a retried task repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A Mersenne prime and two multipliers of linear congruential generators.
MODULUS, MULTIPLIER, SCRAMBLE = 2147483647, 1103515245, 48271
# Increments for the hop and for the batch that draws.
HOP_STEP, BATCH_STEP = 12345, 7919


def portable_draw(walk_id, hop, seed=0, batch=0) -> Column:
    """A number in [0, MODULUS) by BIGINT arithmetic alone: any SQL engine gets the same."""
    as_col = lambda x: F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)
    mixed = (as_col(walk_id).cast("long") % MODULUS) * MULTIPLIER + as_col(hop).cast("long") * HOP_STEP
    mixed = mixed + as_col(seed).cast("long") + as_col(batch).cast("long") * BATCH_STEP
    return (mixed % MODULUS) * SCRAMBLE % MODULUS


def portable_draw_sql(walk_id: str, hop: str, seed: str = "0", batch: str = "0") -> str:
    """The same as SQL text."""
    mixed = f"(({walk_id}) % {MODULUS}) * {MULTIPLIER} + ({hop}) * {HOP_STEP} + ({seed}) + ({batch}) * {BATCH_STEP}"
    return f"((({mixed}) % {MODULUS}) * {SCRAMBLE} % {MODULUS})"


def hashed_draw(walk_id, hop, seed=0, batch=0) -> Column:
    """A number in [0, 2**31) of better quality, only reproducible in Spark."""
    as_col = lambda x: F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)
    return F.shiftrightunsigned(F.xxhash64(as_col(seed), as_col(walk_id), as_col(hop), as_col(batch)), 33)


_WORD = (1 << 64) - 1


def _rotated(x: int, by: int) -> int:
    return ((x << by) | (x >> (64 - by))) & _WORD


def splitmix64(x: int, signed: bool = False) -> int:
    """The splitmix64 output function of a state. signed: right shifts keep the sign, a deviation from the public definition."""
    def shifted(z: int, by: int) -> int:
        return (z - (1 << 64) if signed and z >> 63 else z) >> by

    # Multipliers and shifts of splitmix64.
    z = x & _WORD
    z = ((z ^ shifted(z, 30)) * 0xBF58476D1CE4E5B9) & _WORD
    z = ((z ^ shifted(z, 27)) * 0x94D049BB133111EB) & _WORD
    return (z ^ shifted(z, 31)) & _WORD


class Xoroshiro128Plus:
    """The public xoroshiro128+ generator; rotations and shift a, b, c as its versions have them."""

    def __init__(self, s0: int, s1: int, a: int = 55, b: int = 14, c: int = 36):
        self.s0, self.s1, self.a, self.b, self.c = s0, s1, a, b, c

    def draw(self) -> int:
        result = (self.s0 + self.s1) & _WORD
        mixed = self.s0 ^ self.s1
        self.s0 = _rotated(self.s0, self.a) ^ mixed ^ ((mixed << self.b) & _WORD)
        self.s1 = _rotated(mixed, self.c)
        return result


class ParityStream(Xoroshiro128Plus):
    """xoroshiro128+ (rotations 55 and 36, shift 14) seeded by two splitmix64 outputs whose shifts keep the sign."""

    #: Fixed value: increment of splitmix64's state.
    INCREMENT = 0x9E3779B97F4A7C15

    def __init__(self, seed: int):
        super().__init__(*(splitmix64(seed + turn * self.INCREMENT, signed=True) for turn in (1, 2)))


def parity_draws(spark: SparkSession, repetitions: int, length: int) -> DataFrame:
    """(rep, k, draw DECIMAL(20,0)): the k-th draw of the stream seeded by the repetition.

    repetitions * length rows, independent of the graph, so it may be broadcast.
    """
    from decimal import Decimal

    rows = []
    for rep in range(repetitions):
        stream = ParityStream(rep)
        rows += [(rep, k, Decimal(stream.draw())) for k in range(length)]
    return spark.createDataFrame(rows, "rep long, k int, draw decimal(20,0)")
