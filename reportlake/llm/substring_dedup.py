"""Exact substring removal with difference-cover anchors.

Two equal runs of words, at whatever positions, share an anchor: a position
modulo the period that the cover holds on both sides.  For a period ``v`` and a
cover ``D`` in which every difference modulo ``v`` occurs, equal windows at
``i`` and ``j`` have some ``k < v`` with ``(i + k) mod v`` and ``(j + k) mod v``
both in ``D``; so hashes of ``window - v + 1`` words at the cover's positions
alone, 5 of 21, betray every repeated window.  Only the surroundings of anchors
that occur twice are then compared at full length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.kernels import OTHER_BASE, U, Words, mix, text_blocks, word_prefix
from reportlake.llm.repeats import Entries, places, repeated
from reportlake.llm.shared import bucket_count, documents_of, materialize, named_id

#: A perfect difference cover: every difference modulo 21 occurs. Fixed values.
PERIOD = 21
COVER = (3, 6, 7, 12, 14)

RESULT = "doc long, n_words long, n_removed long, kept_sha256 string"
TEXTS = "doc long, n_words long, n_removed long, kept string"


def anchor_entries(window: int):
    """Hashes of ``window - PERIOD + 1`` words at the cover's positions."""
    length = window - PERIOD + 1
    covered = np.zeros(PERIOD, dtype=bool)
    covered[list(COVER)] = True

    def entries(batch: pa.RecordBatch) -> Iterator[Entries]:
        tag = batch.column("tag").to_numpy()
        for i, _, buf, offs in text_blocks(batch):
            w = Words(buf, offs)
            at = np.arange(len(w.doc)) - w.first[w.doc]
            here = np.flatnonzero(covered[at % PERIOD] & (at + length <= w.count[w.doc]) & (w.count[w.doc] >= window))
            if not len(here):
                continue
            h = mix(word_prefix(w.hashes(buf)).raw(here, here + length))
            of = w.doc[here]
            yield {"k": h, "d": tag[i + of], "t": np.zeros(len(here), np.int64), "p": at[here], "x": np.zeros(len(here), np.int32)}

    return entries


def window_entries(window: int):
    """Hashes of the full windows around each document's repeated anchors."""

    def entries(batch: pa.RecordBatch) -> Iterator[Entries]:
        tag = batch.column("tag").to_numpy()
        anchors = batch.column("anchors")
        for i, j, buf, offs in text_blocks(batch):
            w = Words(buf, offs)
            near = np.zeros(len(w.doc) + PERIOD + 1, dtype=np.int32)
            for row in range(i, j):
                p = np.unique(np.frombuffer(anchors[row].as_buffer(), dtype=np.int32)).astype(np.int64)
                last = w.first[row - i] + w.count[row - i] - window
                lo = w.first[row - i] + np.maximum(p - (PERIOD - 1), 0)
                hi = np.minimum(w.first[row - i] + p, last)
                ok = lo <= hi
                np.add.at(near, lo[ok], 1)
                np.add.at(near, hi[ok] + 1, -1)
            here = np.flatnonzero(np.cumsum(near)[: len(w.doc)] > 0)
            if not len(here):
                continue
            words = w.hashes(buf)
            h = mix(word_prefix(words).raw(here, here + window))
            # 30 bits more from a second polynomial: windows are not compared word by word.
            more = (mix(word_prefix(words, OTHER_BASE).raw(here, here + window)) >> U(34)).astype(np.int32) << 1
            of = w.doc[here]
            yield {"k": h, "d": tag[i + of], "t": np.zeros(len(here), np.int64), "p": here - w.first[of], "x": more}

    return entries


def _keep(window: int, digest: bool):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, starts = batch.column("doc"), batch.column("starts")
            for i, j, buf, offs in text_blocks(batch):
                w = Words(buf, offs)
                data = buf.tobytes()
                gone = np.zeros(len(w.doc) + 1, dtype=np.int32)
                for row in range(i, j):
                    if starts[row].is_valid:
                        s = w.first[row - i] + np.unique(np.frombuffer(starts[row].as_buffer(), dtype=np.int32)).astype(np.int64)
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[w.first[1:]] - total[w.first[:-1]]
                kept = []
                for n in range(j - i):
                    at = np.flatnonzero(~gone[w.first[n] : w.first[n + 1]]) + w.first[n]
                    text = b" ".join([data[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(i, j - i), pa.array(w.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc", "n_words", "n_removed", "kept_sha256" if digest else "kept"],
                )

    return run


def repeated_windows(docs: DataFrame, window: int = 35) -> DataFrame:
    """``(tag, starts binary)``: word positions, packed, where a window that occurs twice starts.

    No order is asked of the documents, so the tag alone travels with a position.

    ``docs`` is ``documents_of`` of a table.  Windows are counted over the whole
    input, within a document too.
    """
    if window < PERIOD + 4:
        raise ValueError(f"a window has at least {PERIOD + 4} words")
    anchors = materialize(repeated(docs, anchor_entries(window), bucket_count(docs, 8)), "anchors")
    regions = docs.join(places(anchors).select(F.col("doc").alias("tag"), F.col("p").alias("anchors")), "tag")
    windows = materialize(repeated(regions, window_entries(window), bucket_count(docs, 8)), "windows")
    return places(windows).select(F.col("doc").alias("tag"), F.col("p").alias("starts"))


def remove_repeats(
    documents: DataFrame, window: int = 35, *, id_col: str = "doc_id", text_col: str = "text", texts: bool = False
) -> DataFrame:
    """Remove each word that a repeated window of ``window`` words covers.

    Words are maximal runs without ASCII white space, compared unchanged; a
    window repeats if its word sequence starts anywhere else, in the same
    document too, so every copy of a passage goes.  Returns ``doc_id, n_words,
    n_removed, kept_sha256``, or with ``texts`` the kept words themselves, joined
    by one space.

    Null or empty texts have no words.  A null id stays null.  Repeated rows are
    documents like any other: they repeat each other.  Rows that share an id but
    not a text are kept apart.  Extra columns are ignored.
    """
    docs = documents_of(documents, id_col, text_col)
    joined = docs.join(repeated_windows(docs, window), "tag", "left")
    out = joined.mapInArrow(_keep(window, not texts), TEXTS if texts else RESULT)
    return out.select(named_id().alias("doc_id"), *out.columns[1:])
