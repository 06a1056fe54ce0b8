"""A blocked Bloom filter as rows: all bits of a key lie in one 64-bit block, so one look-up decides.

Blocks are rows of a fixed number, which is why they can be broadcast. A filter
that is too small for its keys lets more pass, and never holds a key back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 5
#: Most blocks that ``blocks_for`` gives: rows of a broadcast, 8 bytes of bits each.
MOST_BLOCKS = 1 << 18


def blocks_for(n_keys: int) -> int:
    """A power of two with some ten bits a key, up to the bound."""
    return min(MOST_BLOCKS, 1 << max(6, (n_keys // 6).bit_length()))


def _block(key_hash: Column, blocks: int) -> Column:
    return F.pmod(key_hash, F.lit(blocks)).cast("int")


def _mask(key_hash: Column) -> Column:
    """``BITS`` bits of a block, from six bits of the hash each."""
    out = F.lit(0).cast("long")
    for k in range(BITS):
        bit = F.shiftrightunsigned(key_hash, 20 + 6 * k).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """``(block, bits)`` of the keys' ``hash`` column; at most ``blocks`` rows."""
    return keys.groupBy(_block(F.col("hash"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("hash"))).alias("bits"))


def possible(rows: DataFrame, bits: DataFrame, blocks: int, name: str = "possible") -> DataFrame:
    """``rows`` with whether their ``hash`` may be among the filter's keys."""
    mask = _mask(F.col("hash"))
    joined = rows.withColumn("block", _block(F.col("hash"), blocks)).join(F.broadcast(bits), "block", "left")
    return joined.withColumn(name, F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False))).drop("block", "bits")
