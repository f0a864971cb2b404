"""A Bloom filter of fixed size, built by an aggregation and sent to the tasks as a broadcast."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 27


def bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each 64-bit hash."""
    low = hashes.view(np.uint64)
    return (low % np.uint64(FILTER_BITS)).astype(np.int64), (
        (low >> np.uint64(36)) % np.uint64(FILTER_BITS)).astype(np.int64)


def build(hashes: DataFrame) -> np.ndarray:
    """The filter over a table of one column of hashes: ``FILTER_BITS`` bits, whatever its size.

    A large table fills the filter, which then lets more pass; it never holds back a member.
    """
    def set_bits(batches):
        for batch in batches:
            found = np.concatenate(bits(batch.column(0).to_numpy()))
            yield pa.record_batch([pa.array(found // 32), pa.array(
                np.left_shift(1, found % 32).astype(np.int64))], ["word", "bit"])

    rows = hashes.mapInArrow(set_bits, "word long, bit long").groupBy("word").agg(
        F.bit_or("bit").alias("bits")).toArrow()  # FILTER_BITS / 32 rows at most
    words = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return words


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be members."""
    a, b = bits(hashes)
    return ((words[a // 32] >> (a % 32).astype(np.uint32))
            & (words[b // 32] >> (b % 32).astype(np.uint32)) & np.uint32(1)) > 0
