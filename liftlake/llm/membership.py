"""Prefilter of documents by a fixed-size bitmap of wanted ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bits of the bitmap (2 MB).  With more ids it lets more documents pass and
#: saves less; a join on the ids always follows, so results do not depend on it.
BITS = 1 << 24


def id_filter(docs: DataFrame, ids: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of ``docs`` (with a long doc_id) that may be among ``ids``: no
    wanted row is lost, few others pass.  Saves shuffling texts that the join
    that follows would only throw away.  With ``inside`` false: the other rows,
    none of which is wanted; the two parts together are all rows."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    bitmap = (ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")))
    width = 32768 // 8
    table = np.zeros((BITS // 32768 + 2) * width, np.uint8)
    for row in bitmap.collect():
        table[row.bucket * width:(row.bucket + 1) * width] = np.frombuffer(row.bits, np.uint8)
    # position p has bucket p // 32768 + 1 and bit p % 32768 of it (p >= 1), as
    # the SQL functions have it; the lookup below is by the same two functions
    shared = docs.sparkSession.sparkContext.broadcast(table)
    marked = docs.withColumns({"_bucket": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)})

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            bucket = batch.column(names.index("_bucket")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bit = batch.column(names.index("_bit")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = (shared.value[bucket * width + bit // 8] >> (bit % 8).astype(np.uint8)) & 1
            yield batch.select(names[:-2]).filter(pa.array(hit.astype(bool) == inside))
    return marked.mapInArrow(run, docs.schema)
