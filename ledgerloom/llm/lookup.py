"""Tables of 64-bit keys to broadcast: values by key, and a bitmap that sifts rows before a join."""

from __future__ import annotations

import numpy as np
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sieve has 16 bits a key or more, up to 2 to the power of MOST_BITS (64 MB) in all; the least is 2 to the power of LEAST_BITS.
LEAST_BITS, MOST_BITS = 20, 29


class Lookup:
    """Values by 64-bit key, in a hash table that is built where it is first used."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray) -> None:
        self.keys, self.values, self.slots = keys, values, None

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _build(self) -> None:
        bits = max(4, (2 * len(self.keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(self.keys)), self._home(self.keys)
        while len(left):
            free = slots[at] < 0
            slots[at[free]] = left[free]
            rest = slots[at] != left
            left, at = left[rest], (at[rest] + 1) & self.mask
        self.slots = slots

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for keys that aren't there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        if self.slots is None:
            self._build()
        at = self._home(keys)
        found = self.slots[at]
        left = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            now = self.slots[at]
            found[left] = now
            more = (now >= 0) & (self.keys[now] != keys[left])
            left, at = left[more], at[more]
        return found


def sieve(keys: DataFrame, column: str = "key") -> Broadcast:
    """A bitmap, made by Spark, with the bit set that the leading bits of each key name.

    The keys are hashes. A sieve only keeps rows out of a shuffle: whoever uses it
    gets the same result if every row passes, as most do once there are more
    keys than bits (from about 5e8 keys on). Unpersist it when its rows are written.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))
    places = keys.select(F.expr(f"shiftrightunsigned({column}, {64 - bits})").alias("place"))
    words = places.groupBy(F.expr("shiftright(place, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))").alias("bits"))
    table = words.toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set."""
    bits = len(bitmap).bit_length() + 5
    place = keys >> np.uint64(64 - bits)
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
