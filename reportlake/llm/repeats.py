"""Exchange of fingerprints between documents, packed by bucket.

Operators that look for repeated passages turn each text into many
``(fingerprint, document, position)`` entries.  A row for each would cost more
in Spark's row format than the fingerprints themselves, so a block of texts
sends one row per bucket with its entries as packed arrays.  Before that, a
block combines: of a fingerprint that it holds many times it sends what the
others need to know, once.  A passage that a third of all documents share thus
reaches its bucket as often as there are blocks, not documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from reportlake.llm.kernels import U, groups_of, mix

#: Packed columns of an entry. x holds what an operator needs beside the position.
FIELDS = {"k": np.uint64, "d": np.int64, "t": np.int64, "p": np.int32, "x": np.int32}
PACKED = "bucket int, known boolean, n int, " + ", ".join(f"{f} binary" for f in FIELDS)
FOUND = "kind int, part int, d binary, t binary, p binary, x binary"
PLACES = "doc long, tag long, p binary, x binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("n", pa.int32()), *[(f, pa.binary()) for f in FIELDS]])
_FOUND = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *[(f, pa.binary()) for f in "dtpx"]])
_PLACES = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("p", pa.binary()), ("x", pa.binary())])

Entries = dict[str, np.ndarray]


def take(e: Entries, rows: np.ndarray) -> Entries:
    return {f: v[rows] for f, v in e.items()}


def _cut(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The slices of ``values`` between ``cuts`` as a binary column."""
    values = np.ascontiguousarray(values)
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def pack(e: Entries, known: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket. Known entries need no partner: they spread by document, without fingerprint."""
    if not len(e["k"]):
        return
    e = {f: e[f].astype(kind, copy=False) for f, kind in FIELDS.items()}
    spread = mix(e["d"].astype(U) + U(77)) if known else e["k"]
    bucket = ((spread >> U(17)) % U(buckets)).astype(np.int32)
    order = np.lexsort((e["p"], e["d"], bucket))
    bucket, e = bucket[order], take(e, order)
    starts, _ = groups_of(bucket)
    cuts = np.append(starts, len(bucket))
    columns = [pa.array(bucket[starts], pa.int32()), pa.array(np.full(len(starts), known)), pa.array(np.diff(cuts).astype(np.int32))]
    columns.append(_cut(e["k"][:0], np.zeros_like(cuts)) if known else _cut(e["k"], cuts))
    yield pa.RecordBatch.from_arrays(columns + [squeezed(e[f], cuts) for f in "dtpx"], schema=_PACKED)


def squeezed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The slices of ``values`` between ``cuts``, compressed."""
    return pa.array([pa.compress(values[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())


def unsqueezed(table: pa.Table, field: str) -> np.ndarray:
    kind, n = FIELDS[field], table.column("n").to_pylist()
    width = np.dtype(kind).itemsize
    parts = [np.frombuffer(pa.decompress(v.as_buffer(), decompressed_size=m * width, codec="zstd"), dtype=kind) for v, m in zip(table.column(field), n, strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def unpacked(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """All values of a packed column, one after the other."""
    parts = []
    for a in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(a):
            continue
        _, offsets, data = a.buffers()
        width = np.int64 if pa.types.is_large_binary(a.type) else np.int32
        offs = np.frombuffer(offsets, dtype=width)[a.offset : a.offset + len(a) + 1]
        if offs[-1] > offs[0]:
            parts.append(np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]])
    return np.concatenate(parts).view(kind) if parts else np.zeros(0, dtype=kind)


def unpack(table: pa.Table) -> Entries:
    """The entries of a bucket; known ones have no fingerprint."""
    return {"k": unpacked(table.column("k"), np.uint64)} | {f: unsqueezed(table, f) for f in "dtpx"}


def found(e: Entries, kind: int, buckets: int) -> pa.RecordBatch:
    """Positions, one row for each part of the documents; there are fewer parts than buckets."""
    parts = max(4, buckets // 4)
    part = (mix(e["d"].astype(U) + U(5)) % U(parts)).astype(np.int32)
    order = np.lexsort((e["p"], e["t"], e["d"], part))
    part, e = part[order], take(e, order)
    starts, _ = groups_of(part)
    cuts = np.append(starts, len(order))
    columns = [pa.array(np.full(len(starts), kind, dtype=np.int32)), pa.array(part[starts])]
    return pa.RecordBatch.from_arrays(columns + [_cut(e[f].astype(FIELDS[f], copy=False), cuts) for f in "dtpx"], schema=_FOUND)


def no_found() -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], type=f.type) for f in _FOUND], schema=_FOUND)


def _by_document(table: pa.Table) -> pa.Table:
    e = {f: unpacked(table.column(f), FIELDS[f]) for f in "dtpx"}
    if not len(e["d"]):
        return _PLACES.empty_table()
    e = take(e, np.lexsort((e["p"], e["t"], e["d"])))
    new = np.ones(len(e["d"]), dtype=bool)
    new[1:] = (e["d"][1:] != e["d"][:-1]) | (e["t"][1:] != e["t"][:-1])
    starts = np.flatnonzero(new)
    cuts = np.append(starts, len(new))
    columns = [pa.array(e["d"][starts], pa.int64()), pa.array(e["t"][starts], pa.int64())]
    return pa.Table.from_arrays(columns + [_cut(e["p"], cuts), _cut(e["x"], cuts)], schema=_PLACES)


def places(rows: DataFrame) -> DataFrame:
    """``FOUND`` rows brought together: one row per document, its positions in order."""
    return rows.select("part", "d", "t", "p", "x").groupBy("part").applyInArrow(_by_document, PLACES)


def runs_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``groups_of`` for rows sorted by several keys."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def combine_any(e: Entries) -> tuple[Entries, Entries]:
    """For fingerprints that count when they occur twice anywhere.

    ``x`` holds further bits of the fingerprint, the lowest left free.  Returns
    what to send and what is known.  Of a fingerprint that occurs several times
    in the block all occurrences are known, and one is sent with that bit set so
    that other blocks learn of it.
    """
    e = take(e, np.lexsort((e["x"], e["k"])))
    starts, group = runs_of(e["k"], e["x"])
    many = np.diff(np.append(starts, len(group))) > 1
    e["x"] = e["x"] | many[group].astype(np.int32)
    return take(e, starts), take(e, np.flatnonzero(e["x"] & 1))


def settle_any(e: Entries) -> Entries:
    """Entries, of one bucket, whose fingerprint other blocks hold too."""
    e = take(e, np.lexsort((e["x"], e["k"])))
    starts, group = runs_of(e["k"], e["x"] >> 1)
    many = np.diff(np.append(starts, len(group))) > 1
    e = take(e, np.flatnonzero(many[group] & (e["x"] & 1 == 0)))
    return e | {"x": np.zeros_like(e["x"])}


def repeated(
    rows: DataFrame, entries: Callable[[pa.RecordBatch], Iterator[Entries]], buckets: int
) -> DataFrame:
    """``FOUND`` rows of the positions whose fingerprint occurs at least twice in ``rows``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e in entries(batch):
                out, known = combine_any(e)
                yield from pack(out, False, buckets)
                yield from pack(known | {"x": np.zeros_like(known["x"])}, True, buckets)

    def settle(table: pa.Table) -> pa.Table:
        known = table.column("known")
        e = settle_any(unpack(table.filter(pc.invert(known))))
        k = unpack(table.filter(known))
        both = {f: np.concatenate([e[f], k[f]]) for f in "dtpx"}
        return pa.Table.from_batches([found(both, 0, buckets) if len(both["d"]) else no_found()])

    return rows.mapInArrow(send, PACKED).groupBy("bucket").applyInArrow(settle, FOUND)
