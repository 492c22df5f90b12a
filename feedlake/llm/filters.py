"""Maps of fixed size that tell which rows surely take no part in a join, so that their texts need not be dealt out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a map: 2 MB, whatever the data.
FILTER_BITS = 1 << 24


def digest_filter(digests: DataFrame, digest: str) -> np.ndarray:
    """Bits that digests in the column set in a map of ``FILTER_BITS``: of fixed size whatever the data, so it may be broadcast.

    A digest whose bit is not set is surely not in the column. The fuller the map, the more others pass; they only cost time.
    """
    bit = F.pmod(F.col(digest), F.lit(FILTER_BITS))
    value = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(32)).cast("int"))
    found = digests.select(F.floor(bit / 32).cast("int").alias("word"), value.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out


def passes(bits: np.ndarray, digests: np.ndarray) -> np.ndarray:
    bit = digests % FILTER_BITS
    return (bits[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 > 0


def filter_row(digests: DataFrame, digest: str, name: str) -> DataFrame:
    """The map as one row with the array ``name``, of the same fixed size: for a join that asks it with ``may_hold``."""
    words = digest_filter(digests, digest).view(np.int32)
    array = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))
    return F.broadcast(digests.sparkSession.createDataFrame(pa.table({name: array})))


def may_hold(words: Column, digest: Column) -> Column:
    """``passes`` as an expression."""
    bit = F.pmod(digest, F.lit(FILTER_BITS))
    return F.getbit(F.get(words, F.floor(bit / 32).cast("int")), F.pmod(bit, F.lit(32)).cast("int")) == 1
