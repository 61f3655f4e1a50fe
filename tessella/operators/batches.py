"""Token batches for training: ids, masks and labels of equal length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IGNORED = -100


def padded(rows: DataFrame, ids: str, length: int | None = None, most: int = 1024, pad_id: int = 0, batch: int = 8) -> DataFrame:
    """``rows`` with ``input_ids``, ``attention_mask`` and ``labels`` for column ``ids`` (arrays of integers).

    With ``length`` every row gets that many ids: longer ones are cut there,
    shorter ones padded.  Without it rows are cut to ``most`` and padded to the
    longest of their ``batch``, which is so many rows that follow each other in
    a partition.  Labels are the ids where the mask is 1, else -100.  A null
    array is an empty one; an empty batch has length 0.
    """
    if (length is not None and length < 0) or most < 0 or batch < 1:
        raise ValueError("lengths are not negative, and a batch has a row")
    limit = most if length is None else length
    others = [c for c in rows.columns if c not in ("input_ids", "attention_mask", "labels")]
    cut = F.slice(F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")), 1, limit) if limit else F.array().cast("array<int>")
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "input_ids array<int>", "attention_mask array<int>", "labels array<int>"])

    def made(part: pa.Table) -> pa.RecordBatch:
        arrays = part.column("_ids").combine_chunks()
        sizes = np.diff(arrays.offsets.to_numpy())
        wide = length if length is not None else int(sizes.max(initial=0))
        mask = np.arange(wide) < sizes[:, None]
        tokens = np.full(mask.shape, pad_id, dtype=np.int32)
        tokens[mask] = arrays.flatten().to_numpy(zero_copy_only=False)
        starts = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * wide)
        out = [pa.ListArray.from_arrays(starts, pa.array(x.reshape(-1).astype(np.int32))) for x in (tokens, mask, np.where(mask, tokens, IGNORED))]
        return pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in others), *out], [*others, "input_ids", "attention_mask", "labels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for one in batches:
            more = pa.Table.from_batches([one])
            held = more if held is None else pa.concat_tables([held, more])
            step = batch if length is None else max(1, held.num_rows)
            whole = held.num_rows // step * step
            for start in range(0, whole, step):
                yield made(held.slice(start, step).combine_chunks())
            held = held.slice(whole)
        if held is not None and held.num_rows:
            yield made(held.combine_chunks())

    return rows.select(*others, cut.alias("_ids")).mapInArrow(run, schema)
