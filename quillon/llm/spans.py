"""Spans of text found by Python scanners: the Arrow plumbing and the digests the queries return."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
#: Rows of a batch: bounds what one call to a scanner holds in memory, also where texts are long.
ROWS, BYTES = 8000, 32_000_000


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of at most ROWS rows and about BYTES bytes of text, with their texts; a null text is empty. Only a slice's texts are made at once; a
    longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate([*sizes, BYTES + 1]):
            if i > start and (i - start >= ROWS or size + n > BYTES):
                some = batch.slice(start, i - start)
                yield some, ["" if t is None else t for t in some.column(1).to_pylist()]
                start, size = i, 0
            size += n


def span_rows(docs: DataFrame, make_scanner: Callable[[], Callable[[list[str]], list[list[tuple[str, int, int]]]]]) -> DataFrame:
    """(doc_id, spans) for each row of (doc_id, text); ``make_scanner`` runs once a task and gives the scanner of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = make_scanner()
        for batch, texts in pieces(batches):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in scan(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans {SPAN_TYPE}")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
