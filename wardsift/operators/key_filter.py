"""A Bloom filter of keys, built by aggregation and probed by a join with its blocks.

One hash per key picks one bit of ``bits``; bits are kept in blocks of 32,768 (4 KB), one row each, made by Spark's bitmap aggregate.
The filter has at most ``bits / 8`` bytes whatever the number of keys, so it may be broadcast.  It lets every key through that it was
built from, and others by chance: seldom while keys are fewer than a tenth of the bits, more often beyond, so what passes is
still to be joined with the keys themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: 16 MB of bits.
FILTER_BITS = 1 << 27


def _bit(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def key_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """(``_block``, ``_bits``): the blocks that hold a key; null counts as a key."""
    placed = keys.select(_bit(key, bits).alias("_bit"))
    return placed.groupBy(F.bitmap_bucket_number("_bit").alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))


def may_contain(df: DataFrame, key: str, filtered: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``df`` whose key the filter lets through."""
    bit = _bit(key, bits)
    # At most bits / 32768 rows of 4 KB.
    placed = df.withColumn("_block", F.bitmap_bucket_number(bit)).join(F.broadcast(filtered), "_block")
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return placed.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_block", "_bits")
