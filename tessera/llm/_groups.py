"""Ranges of document ids of bounded size, so that texts are shuffled once and stay in the order of their ids.

Sizes are counted, not guessed from the spread of the ids: ids may lie anywhere. An id whose rows exceed a range by
themselves is cut into parts by a hash, likewise the rows without an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrow import checkpointed, share_code

#: Bits of a range's number that name its part.
PART_BITS = 20
#: What a row counts beside its text.
ROW_BYTES = 64


@dataclass
class Ranges:
    """``lows``: the first id of each range; ``parts``: into how many parts it is cut; ``loose``: parts of the rows without an id."""

    lows: np.ndarray
    parts: np.ndarray
    loose: int
    rows: int
    bytes: int

    def of(self, ids: np.ndarray, missing: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Range numbers: ascending with the ids, then with the salt (as an unsigned number); rows without an id are below all."""
        place = np.maximum(np.searchsorted(self.lows, ids, "right") - 1, 0)
        parts = np.append(self.parts, self.loose)[np.where(missing, len(self.lows), place)]
        share = (salt.view(np.uint64) >> np.uint64(32)) * parts.astype(np.uint64) >> np.uint64(32)
        return (np.where(missing, -1, place) << PART_BITS) + share.astype(np.int64)


def order_of(ranges: np.ndarray) -> np.ndarray:
    """The place of each range's ids in ascending order, equal for the parts of one id; rows without an id come last."""
    place = ranges >> PART_BITS
    return np.where(place < 0, 1 << 42, place)


def id_ranges(df: DataFrame, key: str, text: str, most_bytes: int, most_ranges: int = 1 << PART_BITS) -> Ranges:
    """Ranges of about ``most_bytes`` each, or of more if there were more than ``most_ranges`` of them.

    Sizes are summed by id first, so one id may have any number of rows; what comes to the driver is a row for a range.
    """
    share_code(df.sparkSession)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    sized = checkpointed(df.groupBy(F.col(key).alias("id")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")))
    total, rows, loose = sized.agg(F.sum("bytes"), F.sum("n"), F.sum(F.when(F.col("id").isNull(), F.col("bytes")))).first()
    bound = max(most_bytes, -(-(total or 0) // most_ranges))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, cell, alone = 0, -1, True
        for batch in batches:
            ids, sizes = (batch.column(k).to_numpy() for k in range(2))
            if not len(ids):
                continue
            heavy = sizes >= bound
            cells = (run + np.cumsum(np.where(heavy, 0, sizes))) // bound
            begins = heavy | (cells != np.append(cell, cells[:-1])) | np.append(alone, heavy[:-1])
            run, cell, alone = run + int(sizes[~heavy].sum()), cells[-1], heavy[-1]
            parts = np.where(heavy, -(-sizes // bound), 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[begins]), pa.array(parts[begins])], names=["low", "parts"])

    known = sized.filter("id is not null").select("id", "bytes").repartitionByRange("id").sortWithinPartitions("id")
    found = known.mapInArrow(cut, "low long, parts long").toArrow().sort_by("low")
    most_parts = 1 << PART_BITS
    parts = np.minimum(found.column("parts").to_numpy(), most_parts)
    return Ranges(found.column("low").to_numpy(), parts, min(most_parts, max(1, -(-(loose or 0) // bound))), rows or 0, total or 0)


def with_range(df: DataFrame, key: str, salt: Column, ranges: Ranges) -> DataFrame:
    """``df`` with the number of each row's range. Only ids and salts go to Python."""
    shared = df.sparkSession.sparkContext.broadcast(ranges)  # a row for a range, see id_ranges

    @F.pandas_udf("long")
    def number(ids: pd.Series, missing: pd.Series, salts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.of(ids.to_numpy(np.int64), missing.to_numpy(bool), salts.to_numpy(np.int64)))

    return df.withColumn("range", number(F.coalesce(F.col(key), F.lit(0)), F.col(key).isNull(), salt))
