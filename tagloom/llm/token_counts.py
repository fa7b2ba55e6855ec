"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A huge text is encoded in overlapping chunks with offsets. Two neighbours are
spliced at a place in their overlap where both have a token boundary, which no
token of the vocabulary can span, and from which their tokens agree up to the
next such place. Where an overlap holds no such place it is widened, up to the
rest of the text in one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.tables import bounded_batches
from tagloom.llm.textblocks import utf8
from tagloom.llm.tokens import UnitCounts, unit_counts, vocabulary


def _splice(text: str, left: np.ndarray, right: np.ndarray, lo: int, hi: int, units: UnitCounts) -> int | None:
    """The last but one stable common boundary in text[lo:hi], if from it to the
    last the two encodings agree. left, right: token starts in the whole text."""
    a, b = left[(left > lo) & (left < hi)], right[(right > lo) & (right < hi)]
    common = [c for c in np.intersect1d(a, b).tolist() if units.stable(text[c - 1], text[c])]
    if len(common) < 2:
        return None
    at, end = common[-2], common[-1]
    return at if np.array_equal(a[(a >= at) & (a < end)], b[(b >= at) & (b < end)]) else None


def count_spliced(text: str, units: UnitCounts, chunk: int, overlap: int) -> int:
    """The number of tokens of the text, from chunks of `chunk` characters."""
    total, start, cut, wide = 0, 0, 0, overlap
    tokens = units.boundaries(text[:chunk])
    while start + chunk < len(text):  # a text of many bytes may have fewer characters than a chunk
        stop = start + chunk
        begin = max(cut, stop - wide)
        following = units.boundaries(text[begin : begin + chunk]) + begin if begin > cut else None
        at = _splice(text, tokens, following, begin, stop, units) if following is not None else None
        if at is None:
            if begin > cut:
                wide *= 2
                continue
            # No place to splice in the whole chunk: what is left is one chunk. The mark
            # of the space at the cut is the one that the library puts before a text.
            return total + len(units.boundaries(text[cut + (cut > 0) :]))
        total += int(((tokens >= cut) & (tokens < at)).sum())
        tokens, start, cut, wide = following, begin, at, overlap
    return total + int((tokens >= cut).sum())


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = 32_768, overlap: int = 512, path: str | None = None) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row's whole text.

    Counts are those of the library for the whole text, without begin or end
    tokens. A null text is empty and has none. Every row gets its own result;
    other columns are ignored.
    """
    path = path or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = unit_counts(path)
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            sizes = np.diff(off)
            huge = np.flatnonzero(sizes > chunk) if units.splits else np.zeros(0, np.int64)
            # Huge texts are left out of the words' run and spliced from chunks instead.
            kept = np.ones(len(raw), bool)
            for k in huge:
                kept[off[k] : off[k + 1]] = False
            short = np.concatenate(([0], np.cumsum(np.where(sizes > chunk, 0, sizes)))) if len(huge) else off
            counts = units.counts(raw[kept] if len(huge) else raw, short)
            for k in huge:
                counts[k] = count_spliced(raw[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace"), units, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(counts), pa.array(counts > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
