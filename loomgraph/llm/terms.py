"""Frequency of every distinct term (problem 3) by an external sort and a run-length scan.

(term, record) pairs are range-partitioned on (field, term, record), so a hot term spreads over as many partitions as it needs, and all
places of a term in one record meet. Each partition is sorted on all columns (spilling to disk as needed) and scanned once; a term's run
that crosses a partition's end leaves one partial count on either side, and these few rows are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.canonical import with_canonical

RARE_PAGES = 2
COMMON_SHARE = 0.1
COLUMNS = ["field", "term", "record", "row_id", "pos"]


def _new(col: pa.Array, last) -> np.ndarray:
    """True where a value differs from the one before; `last` precedes the first."""
    out = np.ones(len(col), dtype=bool)
    if len(col) > 1:
        out[1:] = pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
    out[0] = last is None or col[0].as_py() != last
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted rows: per (field, term) how many distinct places and records. The last run of a batch stays open."""
    last: list = [None] * len(COLUMNS)
    held: list | None = None  # field, term, places, records
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i) for i in range(len(COLUMNS))]
        fresh = [_new(c, x) for c, x in zip(cols, last)]
        term = fresh[0] | fresh[1]
        record = term | fresh[2]
        place = record | fresh[3] | fresh[4]
        starts = np.flatnonzero(term)
        if not len(starts) or starts[0]:
            starts = np.concatenate([[0], starts])
        places, records = np.add.reduceat(place.astype(np.int64), starts), np.add.reduceat(record.astype(np.int64), starts)
        fields, terms = (c.take(pa.array(starts)).to_pylist() for c in cols[:2])
        if held and not term[0]:
            places[0] += held[2]
            records[0] += held[3]
        elif held:
            yield _batch([held])
        if len(starts) > 1:
            yield _batch(list(zip(fields[:-1], terms[:-1], places[:-1].tolist(), records[:-1].tolist())))
        held = [fields[-1], terms[-1], int(places[-1]), int(records[-1])]
        last = [c[-1].as_py() for c in cols]
    if held:
        yield _batch([held])


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [("field", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_records", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def page_terms(pages: DataFrame) -> DataFrame:
    """(field, term, record, row_id, pos) of every non-blank tag and type; a row delivered twice has the same places both times."""
    tags = pages.select("slug", "ord", F.posexplode("tags").alias("pos", "raw")).withColumn("field", F.lit("tags"))
    types = pages.select("slug", "ord", F.lit(0).alias("pos"), F.col("type").alias("raw"), F.lit("type").alias("field"))
    rows = with_canonical(tags.unionByName(types), "term", F.col("raw"))
    rows = rows.where(F.col("term").isNotNull() & F.col("slug").isNotNull())
    return rows.select("field", "term", F.col("slug").alias("record"), F.coalesce("ord", F.lit(-1)).alias("row_id"), "pos")


def term_frequencies(pairs: DataFrame) -> DataFrame:
    """(field, term, n, n_records): distinct places and distinct records of every term; no pairs, no rows.

    pairs has COLUMNS, none of them null. Repeated rows are one place.
    """
    placed = pairs.select(*COLUMNS).repartitionByRange(*COLUMNS[:3]).sortWithinPartitions(*COLUMNS)
    partial = placed.mapInArrow(_scan, "field string, term string, n bigint, n_records bigint")
    return partial.groupBy("field", "term").agg(F.sum("n").alias("n"), F.sum("n_records").alias("n_records"))


def marked(freq: DataFrame, records: int) -> DataFrame:
    """Adds `mark`: `rare` (RARE_PAGES records or fewer), `common` (more than COMMON_SHARE of all records), else null."""
    share = Fraction(str(COMMON_SHARE))
    common = F.col("n_records") * share.denominator > records * share.numerator
    return freq.withColumn("mark", F.when(F.col("n_records") <= RARE_PAGES, "rare").when(common, "common"))
