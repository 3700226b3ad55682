"""Frequency of every distinct value, by a range-partitioned external sort and run-length scanning.

Pairs (term, record) are range-partitioned and sorted by (field, term, record, row); Spark's sort spills to
disk.  A partition is scanned once in Arrow batches: runs of equal terms give occurrences, runs of equal
(term, record) give distinct records.  The row id in the sort key lets even a single (term, record) pair
spread over several partitions, so no key is too hot; a run cut by a partition edge is stitched afterwards
from the first and last record of the pieces.

Defined results: NULL and blank terms are left out; a NULL record counts as an occurrence but not as a
record; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.session import partitions_for

_PARTS = "part int, field_name string, field_value string, n bigint, docs bigint, first_rec string, last_rec string"
_NAMES = [x.split()[0] for x in _PARTS.split(", ")]


def _changed(a: pa.Array) -> np.ndarray:
    """True where a value differs from the one before it (the first one does)."""
    out = np.ones(len(a), dtype=bool)
    if len(a) > 1:
        out[1:] = pc.not_equal(a[1:], a[:-1]).to_numpy(zero_copy_only=False)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    held: list | None = None  # the open run: field, term, n, docs, first, last

    def rows_of(runs: list[list]) -> pa.RecordBatch:
        cols = list(zip(*[[part, *r] for r in runs], strict=True))
        types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=_NAMES)

    for b in batches:
        if not b.num_rows:
            continue
        field, term, rec = b.column(0), b.column(1), b.column(2)
        new_term = _changed(field) | _changed(term)
        new_rec = (new_term | _changed(rec)) & pc.not_equal(rec, "").to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new_term)
        ends = np.append(at[1:], b.num_rows)
        docs = np.add.reduceat(new_rec.astype(np.int64), at)
        idx, last = pa.array(at), pa.array(ends - 1)
        runs = [
            list(r)
            for r in zip(
                field.take(idx).to_pylist(), term.take(idx).to_pylist(), (ends - at).tolist(), docs.tolist(),
                rec.take(idx).to_pylist(), rec.take(last).to_pylist(), strict=True,
            )
            if r[1]
        ]
        if not runs:
            continue
        if held and held[:2] == runs[0][:2]:
            same = held[5] == runs[0][4] != ""
            runs[0] = [*held[:2], held[2] + runs[0][2], held[3] + runs[0][3] - same, held[4], runs[0][5]]
        elif held:
            runs.insert(0, held)
        held = runs.pop()
        if runs:
            yield rows_of(runs)
    if held:
        yield rows_of([held])


def term_frequencies(pairs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(field_name, field_value, occurrences, records) from rows of (field_name, field_value, record, row_id)."""
    n = partitions or partitions_for(pairs)
    keyed = pairs.select(
        "field_name", F.coalesce("field_value", F.lit("")).alias("field_value"), F.coalesce(F.concat(F.lit("r"), F.col("record")), F.lit("")).alias("rec"), "row_id"
    )
    order = ["field_name", "field_value", "rec", "row_id"]
    runs = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("row_id").mapInArrow(_scan, _PARTS)
    # stitch: a record that ends one piece of a term and opens the next was counted twice
    edge = F.lag("last_rec").over(W.partitionBy("field_name", "field_value").orderBy("part"))
    twice = F.when((F.col("first_rec") == edge) & (edge != ""), 1).otherwise(0)
    cut = runs.withColumn("docs", F.col("docs") - twice)
    return cut.groupBy("field_name", "field_value").agg(F.sum("n").alias("occurrences"), F.sum("docs").alias("records"))


def mark_terms(freq: DataFrame, total_records: Column | int, rare: int = 1, common_share: float = 0.1) -> DataFrame:
    """Adds ``mark``: 'rare' at most ``rare`` records, 'common' more than ``common_share`` of all, else NULL."""
    total = F.lit(total_records) if isinstance(total_records, int) else total_records
    mark = F.when((F.col("records") >= 1) & (F.col("records") <= rare), "rare").when(
        F.col("records") > total * F.lit(common_share).cast("decimal(6,4)"), "common"
    )
    return freq.withColumn("mark", mark)
