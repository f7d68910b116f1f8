"""Suffix-array dedup with a logarithmic family of levels.

Suffixes are compared to the depth that matters, the 50 bytes of a match, byte by
byte.  In each slice of the suffix space documents arrive in batches by ascending
id.  A batch gets its suffix array, in text order, and is merge-scanned against
every level there is, which hold smaller documents only (or the first one's own);
then it becomes a level, and levels of equal size merge, so each suffix is merged
a logarithmic number of times.

Not every suffix has to travel.  Of 35 consecutive suffixes the one whose first
16 bytes hash lowest is sampled; which one that is depends on those 50 bytes
alone, so equal windows sample the same suffix.  The first round exchanges the
sampled suffixes: a fingerprint of their 16 bytes, and one of all the text that
they stand for.  Where both are a smaller document's, all its windows are.  A match
of 50 bytes around the 16 holds 17 more before or behind them, so where fingerprints
of those agree too, the edge of a match may lie within.  The second round brings the
text of such edges together, by the 16 bytes that they share, and the suffix
arrays decide.  Where very many different edges share their 16 bytes, each suffix
travels with its 50 bytes alone, so no slice grows with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.kernels import BLOCK_BYTES, Prefix, U, groups_of, mix, ranges, sliding_min, text_blocks, text_of
from reportlake.llm.repeats import FIELDS, FOUND, Entries, _cut, found, no_found, places, runs_of, squeezed, take, unpacked, unsqueezed
from reportlake.llm.shared import bucket_count, documents_of, materialize, named_id

#: First bytes by which a sampled suffix is chosen and grouped.
GRAM = 16
#: Suffixes of a batch within a slice.
BATCH_SUFFIXES = 1 << 17
#: Different edges with the same first bytes up to which they meet in one slice; beyond it suffix by suffix.
SLICED = 1024
_HOT = 1 << 20

COVERED, EDGE = 0, 1
RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
TEXTS = "doc long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"
_INDEX_BITS = 26
_LONG_TEXT = 24 << 20


class Levels:
    """Suffix arrays, each in text order with the smallest document of every suffix, in geometric sizes."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def smallest(self, suffixes: np.ndarray) -> np.ndarray:
        """Merge-scan: the smallest document that holds each of the sorted ``suffixes``."""
        best = np.full(len(suffixes), np.iinfo(np.int64).max)
        for held, docs in self.levels:
            at = np.searchsorted(held, suffixes)
            at[at == len(held)] = 0
            hit = held[at] == suffixes
            best[hit] = np.minimum(best[hit], docs[at[hit]])
        return best

    def add(self, suffixes: np.ndarray, docs: np.ndarray) -> None:
        """A new level of sorted distinct suffixes; equal-sized levels merge until sizes differ."""
        self.levels.append((suffixes, docs))
        while len(self.levels) > 1 and _size_class(self.levels[-2][0]) <= _size_class(self.levels[-1][0]):
            (a, da), (b, db) = self.levels[-2:]
            suffixes, docs = np.concatenate([a, b]), np.concatenate([da, db])
            order = np.argsort(suffixes, kind="stable")  # two runs: merged in one pass
            starts, _ = groups_of(suffixes[order])
            self.levels[-2:] = [(suffixes[order][starts], np.minimum.reduceat(docs[order], starts))]


def _size_class(suffixes: np.ndarray) -> int:
    return int(max(len(suffixes), 1)).bit_length()


def smaller_holders(suffixes: np.ndarray, docs: np.ndarray, batch: int = BATCH_SUFFIXES) -> np.ndarray:
    """For each suffix the smallest document that holds it, through the family.

    Documents come by ascending id in batches of about ``batch`` suffixes, each
    with its suffix array.  A document may continue in the next batch; what the
    levels hold of it then is no smaller document's.
    """
    best = np.empty(len(suffixes), dtype=np.int64)
    by_doc = np.argsort(docs, kind="stable")
    family = Levels()
    for done in range(0, len(suffixes), batch):
        rows = by_doc[done : done + batch]
        rows = rows[np.argsort(suffixes[rows], kind="stable")]  # documents stay in order among equal suffixes
        starts, group = groups_of(suffixes[rows])
        distinct, first = suffixes[rows][starts], docs[rows][starts]
        held = np.minimum(family.smallest(distinct), first)
        best[rows] = held[group]
        family.add(distinct, first)
    return best


def _segments(offs: np.ndarray, i: int, j: int) -> Iterator[tuple[int, int, int, int]]:
    """Pieces of texts ``i`` to ``j`` that fit the sampling index: rows and byte range.

    A text beyond ``_LONG_TEXT`` comes alone in pieces that overlap by 49 bytes, so each
    of its windows lies in one piece.
    """
    if j - i > 1 or offs[j] - offs[i] <= _LONG_TEXT:
        yield i, j, 0, int(offs[j] - offs[i])
        return
    size, at = int(offs[j] - offs[i]), 0
    while at == 0 or at + 49 < size:
        yield i, j, at, min(size, at + _LONG_TEXT)
        at += _LONG_TEXT - 49


def sampled(buf: np.ndarray, offs: np.ndarray, match: int) -> Entries:
    """The sampled suffixes of a block.

    ``g`` and ``k`` are fingerprints of the first bytes and of all text that the
    suffix stands for, ``l`` and ``r`` of the first bytes with as many before or
    behind them as a window holds at least on one side, 0 where no window does;
    ``row`` is the document's, ``p`` the first window's start in it, ``x`` how
    many more windows follow.
    """
    n, wide = len(buf), match - GRAM + 1
    empty = np.zeros(0, dtype=np.int64)
    if n < match:
        return {f: empty.astype(U if f in "gklr" else np.int64) for f in ("g", "k", "l", "r", "row", "p", "x")}
    prefix = Prefix(buf)
    grams = mix(prefix.every(GRAM))
    low = U((1 << _INDEX_BITS) - 1)
    grams &= ~low
    grams |= np.arange(len(grams), dtype=U)
    owner = (sliding_min(grams, wide) & low).astype(np.int64)
    row_of = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    valid = row_of[: len(owner)] == row_of[match - 1 :]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last_of = valid.copy()
    last_of[:-1] &= ~valid[1:] | (owner[1:] != owner[:-1])
    last = np.flatnonzero(last_of)
    at = owner[first]
    row = row_of[first]
    half = (match - GRAM + 1) // 2
    left, right = at - half >= first, last + match >= at + GRAM + half
    return {
        "g": mix(prefix.raw(at, at + GRAM)),
        "l": np.where(left, mix(prefix.raw(np.where(left, at - half, at), at + GRAM)), U(0)),
        "r": np.where(right, mix(prefix.raw(at, np.where(right, at + GRAM + half, at))), U(0)),
        "k": mix(prefix.raw(first, last + match) + mix((last - first).astype(U) + U(1))),
        "row": row,
        "p": first - offs[row],
        "x": last - first,
    }


def _send_samples(match: int, buckets: int):
    """First round: sampled suffixes, one block's own matches settled before they leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            tag = batch.column("tag").to_numpy()
            buf, offs = text_of(batch.column("text"))
            for i, j, _, _ in text_blocks(batch):
                for i, j, lo, hi in _segments(offs, i, j):
                    cut = np.clip(offs[i : j + 1] - offs[i], lo, hi) - lo
                    s = sampled(buf[offs[i] + lo : offs[i] + hi], cut, match)
                    e = {f: s[f] for f in "kglr"} | {"d": doc[i + s["row"]], "t": tag[i + s["row"]], "p": s["p"] + lo, "x": s["x"]}
                    e = take(e, np.lexsort((e["d"], e["k"], e["g"])))
                    starts, group = runs_of(e["g"], e["k"])
                    known = e["d"] > e["d"][starts][group]
                    yield from _packed(take(e, np.flatnonzero(known)), True, buckets)
                    yield from _packed(take(e, np.flatnonzero(~known)), False, buckets)

    return run


#: Fingerprints of a sample as they travel; within a bucket half of the bits tell first bytes apart.
PRINTS = {"k": np.uint64, "g": np.uint32, "l": np.uint32, "r": np.uint32}
SAMPLES = "bucket int, known boolean, n int, k binary, g binary, l binary, r binary, d binary, t binary, p binary, x binary"
_SAMPLES = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("n", pa.int32()), *[(f, pa.binary()) for f in "kglrdtpx"]])


def _packed(e: Entries, known: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket of first bytes. Known entries need no partner: they spread by document, without fingerprints."""
    if not len(e["g"]):
        return
    spread = mix(e["d"].astype(U) + U(77)) if known else e["g"]
    bucket = ((spread >> U(17)) % U(buckets)).astype(np.int32)
    order = np.lexsort((e["p"], e["t"], e["d"], bucket))
    bucket, e = bucket[order], take(e, order)
    starts, _ = groups_of(bucket)
    cuts = np.append(starts, len(bucket))
    columns = [pa.array(bucket[starts], pa.int32()), pa.array(np.full(len(starts), known)), pa.array(np.diff(cuts).astype(np.int32))]
    for f, kind in PRINTS.items():
        # Bits that did not choose the bucket.
        values = e[f] if kind is np.uint64 else (e[f] & U(0xFFFFFFFF) if f != "g" else mix(e[f]) >> U(32)).astype(kind)
        columns.append(_cut(values[:0], np.zeros_like(cuts)) if known else _cut(values, cuts))
    columns += [squeezed(e[f].astype(FIELDS[f], copy=False), cuts) for f in "dtpx"]
    yield pa.RecordBatch.from_arrays(columns, schema=_SAMPLES)


def _unpacked_samples(table: pa.Table) -> Entries:
    return {f: unpacked(table.column(f), kind) for f, kind in PRINTS.items()} | {f: unsqueezed(table, f) for f in "dtpx"}


def _settle_samples(table: pa.Table, buckets: int) -> pa.Table:
    """Covered where a smaller document has the same text; an edge where one has enough of it alike."""
    known = table.column("known")
    own, e = _unpacked_samples(table.filter(known)), _unpacked_samples(table.filter(pc.invert(known)))
    out = [found(take({f: own[f] for f in "dtpx"}, np.arange(len(own["d"]))), COVERED, buckets)] if len(own["d"]) else []
    if len(e["g"]):
        e = take(e, np.lexsort((e["d"], e["k"], e["g"])))
        starts, group = runs_of(e["g"], e["k"])
        covered = e["d"] > e["d"][starts][group]
        if covered.any():
            out.append(found(take(e, np.flatnonzero(covered)), COVERED, buckets))
        edge = ~covered & (_alike(e, "l") | _alike(e, "r"))
        if edge.any():
            starts, group = groups_of(e["g"])
            many = np.add.reduceat(edge.astype(np.int64), starts) > SLICED
            e["x"] = e["x"] + np.where(many[group], _HOT, 0).astype(np.int32)
            out.append(found(take(e, np.flatnonzero(edge)), EDGE, buckets))
    return pa.Table.from_batches(out or [no_found()])


def _alike(e: Entries, side: str) -> np.ndarray:
    """Entries whose first bytes and those on one side are in different texts of different documents."""
    order = np.lexsort((e["k"], e[side], e["g"]))
    starts, group = runs_of(e["g"][order], e[side][order])
    k, d = e["k"][order], e["d"][order]
    mixed = (k[starts] != np.maximum.reduceat(k, starts)) & (np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)) & (e[side][order][starts] != 0)
    out = np.zeros(len(order), dtype=bool)
    out[order] = mixed[group]
    return out


_EDGES = pa.schema([("bucket", pa.int32()), *[(f, pa.binary()) for f in "dtpx"], ("text", pa.binary())])
EDGES = "bucket int, d binary, t binary, p binary, x binary, text binary"


def _send_suffixes(match: int, buckets: int):
    """Second round: the text of every edge; that of hot ones suffix by suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            firsts, more = batch.column("firsts"), batch.column("more")
            for i, j, buf, offs in text_blocks(batch):
                own = slice(i, j)
                n = np.array([len(v.as_buffer()) // 4 for v in firsts[own]], dtype=np.int64)
                p, x = unpacked(firsts[own], np.int32).astype(np.int64), unpacked(more[own], np.int32).astype(np.int64)
                of = np.repeat(np.arange(j - i), n)
                hot = x >= _HOT
                x = np.where(hot, x - _HOT, x)
                # A hot edge becomes its suffixes.
                parts = np.where(hot, x + 1, 1)
                p = np.repeat(p, parts) + ranges(np.zeros_like(parts), parts)
                of, x, hot = np.repeat(of, parts), np.repeat(np.where(hot, 0, x), parts), np.repeat(hot, parts)
                at = p + offs[of]
                prefix = Prefix(buf)
                key = mix(prefix.raw(at, at + match))
                whole = np.flatnonzero(~hot)
                if len(whole):  # the sampled suffix of these: the lowest of the first bytes that all their windows hold
                    key[whole] = _owners(prefix, at[whole], x[whole], match)
                yield from _edge_rows(buf, key, {"d": doc[i + of], "t": tag[i + of], "p": p, "x": x}, at, match, buckets)

    return run


def _owners(prefix: Prefix, at: np.ndarray, x: np.ndarray, match: int) -> np.ndarray:
    """Fingerprints of the first bytes by which the runs of windows at ``at`` were sampled."""
    wide = match - GRAM + 1 - x
    cells = ranges(at + x, wide)
    gram = mix(prefix.raw(cells, cells + GRAM)) & ~U((1 << _INDEX_BITS) - 1)
    return np.minimum.reduceat(gram, np.cumsum(wide) - wide)


def _edge_rows(buf: np.ndarray, key: np.ndarray, e: Entries, at: np.ndarray, match: int, buckets: int) -> Iterator[pa.RecordBatch]:
    if not len(key):
        return
    bucket = ((mix(key) >> U(17)) % U(buckets)).astype(np.int32)
    order = np.lexsort((e["d"], bucket))
    starts, _ = groups_of(bucket[order])
    cuts = np.append(starts, len(order))
    size = (e["x"] + match)[order]
    text, ends = buf[ranges(at[order], size)], np.concatenate([[0], np.cumsum(size)])
    columns = [pa.array(bucket[order][starts], pa.int32())] + [_cut(e[f].astype(FIELDS[f], copy=False)[order], cuts) for f in "dtpx"]
    yield pa.RecordBatch.from_arrays([*columns, _cut(text, ends[cuts])], schema=_EDGES)


def _settle_suffixes(table: pa.Table, match: int, buckets: int) -> pa.Table:
    """Which suffixes of a slice's edges a smaller document holds, as runs."""
    e = {f: unpacked(table.column(f), FIELDS[f]) for f in "dtpx"}
    text = unpacked(table.column("text"), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255, and a key must not end in 0
    n = e["x"].astype(np.int64) + 1
    if not len(n):
        return pa.Table.from_batches([no_found()])
    size = n + match - 1
    at = ranges(np.cumsum(size) - size, n)
    of = np.repeat(np.arange(len(n)), n)
    suffixes = np.lib.stride_tricks.sliding_window_view(text, match)[at].view(f"S{match}").ravel()
    covered = smaller_holders(suffixes, e["d"][of]) < e["d"][of]
    new = covered.copy()
    new[1:] &= ~covered[:-1] | (of[1:] != of[:-1])
    last = covered.copy()
    last[:-1] &= ~covered[1:] | (of[1:] != of[:-1])
    first, last = np.flatnonzero(new), np.flatnonzero(last)
    if not len(first):
        return pa.Table.from_batches([no_found()])
    row = of[first]
    start = (np.cumsum(n) - n)[row]
    runs = {"d": e["d"][row], "t": e["t"][row], "p": e["p"][row] + (first - start), "x": last - first}
    return pa.Table.from_batches([found(runs, COVERED, buckets)])


def _keep(match: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc")
            firsts, more = batch.column("firsts"), batch.column("more")
            for i, j, buf, offs in text_blocks(batch):
                gone = np.zeros(len(buf) + 1, dtype=np.int32)
                for row in range(i, j):
                    if firsts[row].is_valid:
                        p = np.frombuffer(firsts[row].as_buffer(), dtype=np.int32).astype(np.int64) + offs[row - i]
                        x = np.frombuffer(more[row].as_buffer(), dtype=np.int32).astype(np.int64)
                        np.add.at(gone, p, 1)
                        np.add.at(gone, p + x + match, -1)
                gone = np.cumsum(gone)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                edges = offs[:-1][np.diff(offs) > 0]
                opens[edges] = gone[edges]
                spans = np.concatenate([[0], np.cumsum(opens)])
                kept = []
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    text = buf[a:b] if total[a] == total[b] else buf[a:b][~gone[a:b]]
                    kept.append(text.tobytes() if texts else hashlib.sha256(text).hexdigest())
                columns = [doc.slice(i, j - i), pa.array(np.diff(offs), pa.int64()), pa.array(total[offs[1:]] - total[offs[:-1]], pa.int64()), pa.array(spans[offs[1:]] - spans[offs[:-1]], pa.int64())]
                names = ["doc", "n_bytes", "n_removed", "n_spans"]
                if texts:
                    columns.append(pa.array([_runs(gone[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary() if texts else pa.string())], names=[*names, "kept" if texts else "kept_sha256"])

    return run


def _runs(gone: np.ndarray) -> list[dict[str, int]]:
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def covered_windows(docs: DataFrame, match: int = 50) -> DataFrame:
    """``(doc, tag, firsts, more)``: runs of window starts that a smaller document holds too."""
    buckets = bucket_count(docs, 8)
    first = materialize(docs.mapInArrow(_send_samples(match, buckets), SAMPLES).groupBy("bucket").applyInArrow(lambda t: _settle_samples(t, buckets), FOUND), "samples")
    names = ["doc", "tag", F.col("p").alias("firsts"), F.col("x").alias("more")]
    edges = materialize(places(first.where(F.col("kind") == EDGE)).select(*names), "edges")
    sent = docs.join(edges, ["doc", "tag"]).mapInArrow(_send_suffixes(match, buckets), EDGES)
    second = materialize(sent.groupBy("bucket").applyInArrow(lambda t: _settle_suffixes(t, match, buckets), FOUND), "suffixes")
    del sent
    return places(first.where(F.col("kind") == COVERED).unionByName(second)).select(*names)


def remove_earlier(
    documents: DataFrame, match: int = 50, *, id_col: str = "doc_id", text_col: str = "text", texts: bool = False
) -> DataFrame:
    """Remove each byte of a ``match``-byte string that also starts in a smaller document.

    Texts are UTF-8 bytes; matches never cross documents, may overlap, and are
    judged on the input.  Returns ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256``, or with ``texts`` the removed spans and the bytes kept (which
    may begin or end within a character).

    Null or empty texts have no bytes.  A null id counts as larger than every
    other and stays null.  Rows that share an id count as one document for the
    order: they remove nothing from each other, repeated rows included.  Extra
    columns are ignored.
    """
    if match < GRAM + 8:
        raise ValueError(f"a match has at least {GRAM + 8} bytes")
    docs = documents_of(documents, id_col, text_col)
    joined = docs.join(covered_windows(docs, match), ["doc", "tag"], "left")
    out = joined.mapInArrow(_keep(match, texts), TEXTS if texts else RESULT)
    return out.select(named_id().alias("doc_id"), *out.columns[1:])
