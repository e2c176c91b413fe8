"""Key hashes and key routing: Column expressions where 64-bit masks allow it, else Arrow-batched numpy."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The seed of stream keys, and the bits of a key.
KEY_SEED, KEY_BITS = 2038074761, 48
MASK32 = np.uint64(0xFFFFFFFF)


def _mask(bits: int) -> Column:
    return F.lit((1 << bits) - 1)


def hash_64(key: Column, bits: int = KEY_BITS) -> Column:
    """Wang's invertible integer hash on [0, 2^bits), bits up to 48, as one Column expression."""
    if bits > 48:
        raise ValueError("at most 48 bits, so that no step leaves 64")
    m = _mask(bits)
    cut = lambda c: c.bitwiseAND(m)
    # Spark evaluates a filter's expression as often as it is written out: each step doubles it, so the
    # multiplications that fit into 64 bits are single steps, and only the key itself is tested for null
    mixed = lambda c, shift: c.bitwiseXOR(F.shiftrightunsigned(c, shift))
    key = key.cast("long")
    k = F.coalesce(key, F.lit(0).cast("long"))
    k = cut(cut(F.bitwise_not(k)) + cut(F.shiftleft(k, 21)))
    k = cut(mixed(k, 24) * F.lit(1 + (1 << 3) + (1 << 8)))
    k = cut(mixed(k, 14) * F.lit(1 + (1 << 2) + (1 << 4)))
    k = mixed(k, 28)
    return F.when(key.isNotNull(), cut(k + cut(F.shiftleft(k, 31))))


def unshift(x: np.ndarray, shift: int, bits: int) -> np.ndarray:
    """The y with y ^ (y >> shift) == x."""
    y = x.copy()
    for _ in range(bits // shift):
        y = x ^ y >> np.uint64(shift)
    return y


def hash_64_inverse(x: np.ndarray, bits: int = KEY_BITS) -> np.ndarray:
    """The key of a ``hash_64`` value: every step is undone, multiplications by modular inverses."""
    m = np.uint64((1 << bits) - 1)
    inverse = lambda f: np.uint64(pow(f, -1, 1 << bits))
    k = x.astype(np.uint64) * inverse(1 + (1 << 31)) & m
    k = unshift(k, 28, bits) * inverse(21) & m
    k = unshift(k, 14, bits) * inverse(265) & m
    k = unshift(k, 24, bits)
    return (k + np.uint64(1)) * inverse((1 << 21) - 1) & m


def murmur64a(keys: np.ndarray, seed: int = KEY_SEED) -> np.ndarray:
    """MurmurHash64A of each key's eight little-endian bytes."""
    mul, r = np.uint64(0xC6A4A7935BD1E995), np.uint64(47)
    k = keys.astype(np.uint64) * mul
    k = (k ^ k >> r) * mul
    h = np.uint64(seed ^ 8 * int(mul) & (1 << 64) - 1) ^ k
    h = h * mul
    h = (h ^ h >> r) * mul
    return h ^ h >> r


def murmur64b(keys: np.ndarray, seed: int = KEY_SEED) -> np.ndarray:
    """MurmurHash64B of each key's eight little-endian bytes: the variant in 32-bit steps."""
    mul = np.uint64(0x5BD1E995)
    times = lambda x: x * mul & MASK32

    def stir(h: np.ndarray, k: np.ndarray) -> np.ndarray:
        k = times(k)
        return times(h) ^ times(k ^ k >> np.uint64(24))

    k = keys.astype(np.uint64)
    a = stir(np.full(len(k), (seed & 0xFFFFFFFF) ^ 8, np.uint64), k & MASK32)
    b = stir(np.full(len(k), seed >> 32, np.uint64), k >> np.uint64(32))
    a = times(a ^ b >> np.uint64(18))
    b = times(b ^ a >> np.uint64(22))
    a = times(a ^ b >> np.uint64(17))
    b = times(b ^ a >> np.uint64(19))
    return a << np.uint64(32) | b


def evahash(keys: np.ndarray, seed: int) -> np.ndarray:
    """Jenkins' 32-bit hash of each key's eight little-endian bytes."""
    k = keys.astype(np.uint64)
    a = (np.uint64(0x9E3779B9) + (k & MASK32)) & MASK32
    b = (np.uint64(0x9E3779B9) + (k >> np.uint64(32))) & MASK32
    c = np.full(len(k), (seed + 8) & 0xFFFFFFFF, np.uint64)
    state = [a, b, c]
    # nine rounds: which word takes part, and the shift (negative to the left)
    for turn, shift in enumerate((13, -8, 13, 12, -16, 5, 3, -10, 15)):
        i = turn % 3
        x, y, z = state[i], state[(i + 1) % 3], state[(i + 2) % 3]
        x = x - y - z & MASK32
        state[i] = x ^ (z >> np.uint64(shift) if shift > 0 else z << np.uint64(-shift) & MASK32)
    return state[2]


def hashlittle(keys: np.ndarray, seed: int = 12345) -> np.ndarray:
    """Jenkins' later 32-bit hash (of his third lookup function) of each key's eight little-endian bytes."""
    k = keys.astype(np.uint64)
    start = np.uint64(0xDEADBEEF + 8 + seed & 0xFFFFFFFF)
    a, b, c = start + (k & MASK32) & MASK32, start + (k >> np.uint64(32)) & MASK32, np.full(len(k), start)
    state = [c, a, b]
    # seven rounds: the next word takes the one before and that, turned to the left
    for turn, shift in enumerate((14, 11, 25, 16, 4, 14, 24)):
        i = turn % 3
        other = state[i - 1]
        turned = (other << np.uint64(shift) | other >> np.uint64(32 - shift)) & MASK32
        state[i] = (state[i] ^ other) - turned & MASK32
    return state[0]


def numpy_udf(fn, **options):
    """A pandas UDF long -> long (bit pattern) of a numpy function on unsigned keys."""

    @F.pandas_udf("long")
    def run(keys: pd.Series) -> pd.Series:
        x = keys.fillna(0).to_numpy(dtype=np.int64).view(np.uint64)
        return pd.Series(fn(x, **options).astype(np.uint64).view(np.int64)).where(keys.notna().to_numpy())

    return run


def unsigned(key: Column) -> Column:
    """A LONG bit pattern as the unsigned number it stands for, DECIMAL(20,0)."""
    d = key.cast("decimal(20,0)")
    return F.when(key < 0, d + F.lit(Decimal(1 << 64))).otherwise(d).cast("decimal(20,0)")


def from_unsigned(number: Column) -> Column:
    """The LONG bit pattern of an unsigned number, given as text or decimal."""
    d = number.cast("decimal(20,0)")
    return F.when(d >= F.lit(Decimal(1 << 63)), d - F.lit(Decimal(1 << 64))).otherwise(d).cast("long")


def fold(key: Column, bits: int = KEY_BITS) -> Column:
    """The key modulo 2^bits."""
    return key.bitwiseAND(_mask(bits))


def cone(key: Column, cones: int, bits: int = KEY_BITS) -> Column:
    """Which of ``cones`` (a power of two) hash ranges a key belongs to: its leading bits."""
    if cones & (cones - 1):
        raise ValueError("the number of cones must be a power of two")
    return F.shiftrightunsigned(key, bits - cones.bit_length() + 1).bitwiseAND(F.lit(cones - 1))


def key_in_cone(key: Column, cones: int, bits: int = KEY_BITS) -> Column:
    """The rest of the key: its bits below the cone's."""
    return fold(key, bits - cones.bit_length() + 1)


def partition_of(key: Column, parts: int) -> Column:
    """The worker of a key under the modulo rule."""
    return F.pmod(key, F.lit(parts))


def hashed_partition_of(key: Column, parts: int, seed: int = 12345) -> Column:
    """The worker of a key under the hash rule."""
    return F.pmod(numpy_udf(hashlittle, seed=seed)(key), F.lit(parts))
