"""Bit vectors stored as binary: counts and words through Arrow, in whole batches."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """A (rows, width) byte matrix; vectors of another width count as empty."""
    empty = bytes(width)
    return np.frombuffer(b"".join(v if v is not None and len(v) == width else empty for v in column), np.uint8).reshape(-1, width)


def set_bits(column: str | Column) -> Column:
    """The number of set bits of a binary value; null stays null."""

    def count(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else int(np.bitwise_count(np.frombuffer(x, np.uint8)).sum()) for x in v], dtype="Int32")

    return F.pandas_udf(count, "int")(column)


def bit_positions(column: str | Column) -> Column:
    """The positions of the set bits, highest bit of each byte first; null stays null."""

    def find(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))).astype(np.int32))

    return F.pandas_udf(find, "array<int>")(column)
