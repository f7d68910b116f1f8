"""Benchmark decontamination by latent semantic retrieval.

Texts become rows of 32-bit word hashes once.  TF-IDF rows of passages, over
hashed terms, have a low-rank basis that a randomised SVD finds in one pass
(Nystroem's form of it): each task multiplies its passages with a random matrix of
a few columns and back again, the products of all tasks are added up by rows of
terms, and only the small sums reach the driver.  In that basis, scaled to equal variance and without the leading
components that stand out, which tell languages apart, every window of every text
is compared with the benchmark items.  Windows are long enough to hold an item
whole, so one that can pass the last test holds as much of the item's term weight
as that asks for.  What is close enough and holds that much is settled by a longest
common subsequence, weighted by rarity, and by whether the item's answer occurs
word for word.

Benchmark items are a stated set of queries and are taken in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.kernels import U, Words, ranges, text_blocks
from reportlake.llm.repeats import _cut, unpacked
from reportlake.llm.shared import documents_of, materialize, named_id, passing, small_or_not, without

#: Hashed terms; rank of the basis; rows of a part of a matrix of terms.
TERMS, RANK, PART = 1 << 14, 48, 256
#: Words between windows. Windows are whole steps, one more than the item fills.
STEP = 12
#: Words of 64 bits in the signature of a window.
LANES = 8
#: Times the median singular value from which a leading component is left out.
LEADING = 2.5
#: Words of a passage that is a row of the TF-IDF matrix; words that a task works on at once.
PASSAGE, CHUNK = 48, 16_000
#: Cosine from which a window is a candidate, and share of an item's bits that its signature then holds.
COSINE, SIGNED = 0.2, 0.4
#: Weighted coverage from which a document counts as contaminated, without and with the answer.
COVERED, COVERED_WITH_ANSWER = 0.5, 0.4
#: What a term weighs that every text holds: a passage of such terms can be found too.
LEAST = 0.1
#: Benchmark items compared at once; words of windows compared exactly at once.
ITEMS, CELLS = 4096, 1 << 21

_ROWS = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("tag", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])
ROWS = "kind int, doc long, tag long, part int, data binary"
FOUND = "doc long, tag long, item_id long, cosine double, coverage double, answer boolean, start_word long, n_words long"


def token_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[Words, np.ndarray]:
    w = Words(buf, offs, "alnum")
    return w, (w.hashes(buf, lower=True) >> U(32)).astype(np.uint32)


def _parts(kind: int, matrix: np.ndarray) -> pa.RecordBatch:
    """A matrix of terms, cut into parts of ``PART`` rows."""
    n = TERMS // PART
    flat = np.ascontiguousarray(matrix).reshape(n, -1)
    cuts = np.arange(n + 1) * flat.shape[1]
    zero = pa.array(np.zeros(n, dtype=np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, dtype=np.int32)), zero, zero, pa.array(np.arange(n, dtype=np.int32)), _cut(flat.reshape(-1), cuts)],
        schema=_ROWS,
    )


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: the words of a text; kind 1: in how many texts each term occurs."""
    counts = np.zeros(TERMS, dtype=np.int64)
    for batch in batches:
        for i, j, buf, offs in text_blocks(batch):
            w, h = token_hashes(buf, offs)
            term = (h & (TERMS - 1)).astype(np.int64)
            for a in range(0, j - i, 128):  # marks for some texts at a time: cheaper than sorting their words
                b = min(j - i, a + 128)
                own = slice(w.first[a], w.first[b])
                held = np.zeros((b - a) * TERMS, dtype=np.uint8)
                held[(w.doc[own] - a) * TERMS + term[own]] = 1
                counts += held.reshape(b - a, TERMS).sum(axis=0, dtype=np.uint8)
            n = j - i
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(n, dtype=np.int32)),
                    batch.column("doc").slice(i, n),
                    batch.column("tag").slice(i, n),
                    pa.array(np.zeros(n, dtype=np.int32)),
                    _cut(h, w.first),
                ],
                schema=_ROWS,
            )
    if counts.any():
        yield _parts(1, counts)


def _added(rows: DataFrame, dtype: type) -> np.ndarray:
    """The sum of all tasks' matrices of terms, added part by part as rows stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                values = np.frombuffer(data.as_buffer(), dtype=dtype).astype(np.float64)
                sums[part] = sums[part] + values if part in sums else values
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "data"])

    spread = rows.select("part", "data").repartition(TERMS // PART, "part")
    found = {r.part: np.frombuffer(r.data) for r in spread.mapInArrow(run, "part int, data binary").collect()}
    return np.concatenate([found[p] for p in sorted(found)]).reshape(TERMS, -1) if found else np.zeros((TERMS, 1))


def _chunks(batches: Iterator[pa.RecordBatch]):
    """Batches of token rows in pieces of about ``CHUNK`` words: rows, words, first word of each."""
    for batch in batches:
        data = batch.column("data")
        sizes = np.array([len(x.as_buffer()) // 4 if x.is_valid else 0 for x in data], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        i = 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(first, first[i] + CHUNK, side="right")) - 1)
            yield batch, i, j, unpacked(data.slice(i, j - i), np.uint32), first[i : j + 1] - first[i]
            i = j


def _pieces(first: np.ndarray, size: int) -> np.ndarray:
    """Starts of pieces of ``size`` words, the last of a text shorter, and the end."""
    counts = np.diff(first)
    n = -(-counts // size)
    return np.append(np.repeat(first[:-1], n) + ranges(np.zeros_like(n), n) * size, first[-1])


def _multiplied(weight: np.ndarray, matrix: np.ndarray):
    """``A' A matrix`` for the passages ``A`` of a task, whose rows have length one."""
    weighed = (matrix * weight[:, None]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(matrix.shape[::-1], dtype=np.float64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def add() -> None:
            """The passages' products go back to the terms, a column at a time."""
            term = np.concatenate([t for t, _, _ in held]).astype(np.int64)
            before = np.cumsum([0] + [len(rows) for _, _, rows in held])
            of = np.concatenate([own + n for (_, own, _), n in zip(held, before, strict=False)])
            for k, column in enumerate(np.concatenate([rows for _, _, rows in held]).T.astype(np.float64, order="C")):
                total[k] += np.bincount(term, weights=column[of], minlength=TERMS)
            held.clear()

        for _, _, _, h, first in _chunks(batches):
            term = (h & (TERMS - 1)).astype(np.uint16)
            cut = _pieces(first, PASSAGE)
            of = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
            if not len(of):
                continue
            starts = cut[:-1]
            w = weight[term]
            square = np.maximum(np.add.reduceat(w * w, starts), np.float32(1e-30))
            held.append((term, of, np.add.reduceat(weighed[term], starts, axis=0) / square[:, None]))
            if len(held) == 4:
                add()
        if held:
            add()
        if total.any():
            yield _parts(2, (total.T * weight[:, None]).astype(np.float32))

    return run


def latent_basis(tokens: DataFrame, weight: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """Randomised SVD of the passages: terms by components, scaled to equal variance.

    With ``K = A' A`` and a random orthonormal ``W``, ``Y = K W`` gives
    ``K ~ Y (W' Y)^-1 Y'``, whose eigenvectors follow from a thin SVD.
    """
    start = np.linalg.qr(np.random.default_rng(seed).standard_normal((TERMS, rank)))[0].astype(np.float32)
    sketch = _added(tokens.mapInArrow(_multiplied(weight, start), ROWS), np.float32)
    if sketch.shape[1] != rank or not sketch.any():
        return np.zeros((TERMS, rank), dtype=np.float32)
    shift = 1e-6 * np.linalg.norm(sketch)
    sketch = sketch + shift * start
    inner = start.T.astype(np.float64) @ sketch
    root = np.linalg.cholesky((inner + inner.T) / 2)
    vectors, values, _ = np.linalg.svd(np.linalg.solve(root, sketch.T).T, full_matrices=False)
    good = values > values[0] * 1e-4
    leading = values > LEADING * np.median(values[good])
    if (good & ~leading).any():
        good &= ~leading
    return (vectors[:, good] / values[good]).astype(np.float32)


def _steps(words: int) -> int:
    """Steps of a window that holds so many words wherever they start; from eight on in sizes a quarter apart at most."""
    steps = -(-words // STEP) + 1
    unit = 1 << max(0, steps.bit_length() - 3)
    return -(-steps // unit) * unit


class Item:
    """A benchmark item as word hashes, with its answer: the last sentence, or else the last third."""

    def __init__(self, item_id: int, text: str, weight: np.ndarray):
        self.item_id = item_id
        buf = np.frombuffer(text.encode(), dtype=np.uint8)
        _, self.words = token_hashes(buf, np.array([0, len(buf)]))
        sentences = [s for s in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if s.strip()]
        last = np.frombuffer(sentences[-1].encode(), dtype=np.uint8) if len(sentences) > 1 else np.zeros(0, dtype=np.uint8)
        _, answer = token_hashes(last, np.array([0, len(last)]))
        self.answer = answer if len(answer) >= 3 else self.words[-max(3, len(self.words) // 3) :]
        own = self.words[weight[self.words & (TERMS - 1)] > 0]
        self.bits = np.bitwise_or.reduce(_bits(own), axis=1) if len(own) else np.zeros(LANES, dtype=U)
        # Words that no text holds weigh a little too, or an item of such words would weigh nothing.
        self.weight = np.maximum(weight[self.words & (TERMS - 1)], LEAST)
        self.steps = _steps(len(self.words))


def _bits(h: np.ndarray) -> np.ndarray:
    """A bit of ``64 * LANES`` for each word, by lane."""
    lane, bit = (h >> np.uint32(20)) % np.uint32(LANES), U(1) << ((h >> np.uint32(14)) & np.uint32(63)).astype(U)
    return np.stack([np.where(lane == k, bit, U(0)) for k in range(LANES)])


def _spanned(signature: np.ndarray, steps: int) -> np.ndarray:
    """The bits of every ``steps`` consecutive steps."""
    out, span = signature, 1
    while span < steps:
        more = min(span, steps - span)
        shifted = np.zeros_like(out)
        shifted[:, :-more] = out[:, more:]
        out, span = out | shifted, span + more
    return out


def common_subsequence(item: np.ndarray, weight: np.ndarray, text: np.ndarray) -> float:
    """The largest total weight of a common subsequence, as a share of the item's."""
    best = np.zeros(len(text) + 1)
    for word, w in zip(item, weight, strict=True):
        best[1:] = np.maximum(best[1:], best[:-1] + w * (text == word))
        best = np.maximum.accumulate(best)
    return float(best[-1] / weight.sum())


def _search(items: list[Item], weight: np.ndarray, basis: np.ndarray):
    projected = basis * weight[:, None].astype(np.float32)
    by_steps = {k: np.array([n for n, x in enumerate(items) if x.steps == k]) for k in sorted({x.steps for x in items})}
    vectors = np.stack([projected[x.words & (TERMS - 1)].sum(axis=0) for x in items])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    has = np.zeros((len(items), TERMS), dtype=bool)
    for n, x in enumerate(items):
        has[n, x.words & (TERMS - 1)] = True
    weighs = weight > 0
    bits = np.stack([x.bits for x in items], axis=1)
    some_bits = np.ceil(SIGNED * np.bitwise_count(bits).sum(axis=0))
    # What a window's words that the item has must weigh, counted with the item's own weights.
    worth = np.maximum(weight, LEAST)
    needed = np.array([COVERED_WITH_ANSWER * x.weight.sum() * (1 - 1e-6) for x in items])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, _, h, first in _chunks(batches):
            if not len(h):
                continue
            term = h & (TERMS - 1)
            cut = _pieces(first, STEP)
            kept = np.flatnonzero(weighs[term])
            block = np.searchsorted(cut, kept, side="right") - 1
            sums = np.zeros((len(cut) - 1, projected.shape[1]), dtype=np.float32)
            if len(kept):
                starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                sums[block[starts]] = np.add.reduceat(projected[term[kept]], starts, axis=0)
            run_sum = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0, dtype=np.float64)])
            row = np.searchsorted(first, cut[:-1], side="right") - 1
            last = np.searchsorted(row, row, side="right")
            # Which bits occur in a window; beyond a text's end the next one's are added, which only lets more pass.
            signature = np.bitwise_or.reduceat(_bits(h), cut[:-1], axis=1)
            found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
            for steps, own in by_steps.items():
                size = STEP * steps
                at = np.arange(len(row))
                to = np.minimum(at + steps, last)
                # Only the first of the windows that a text's end cuts short.
                whole = (to - at == steps) | (at == 0) | (np.concatenate([[-1], row[:-1]]) != row)
                at, to = at[whole], to[whole]
                z = (run_sum[to] - run_sum[at]).astype(np.float32)
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                cosine = z @ vectors[own].T
                a, b = np.nonzero(cosine >= COSINE)
                signed, met = _spanned(signature, steps), np.zeros(len(a), dtype=np.int64)
                for lane in range(LANES):
                    met += np.bitwise_count(signed[lane][at[a]] & bits[lane][own[b]])
                near = met >= some_bits[own[b]]
                a, b = a[near], b[near]
                at_once = max(1, CELLS // size)
                for s in range(0, len(a), at_once):
                    x, n = a[s : s + at_once], own[b[s : s + at_once]]
                    lo, hi = cut[at[x]], cut[to[x]]
                    cells = lo[:, None] + np.arange(size)
                    t = term[np.minimum(cells, len(term) - 1)]
                    held = np.where(has[n[:, None], t] & (cells < hi[:, None]), worth[t], np.float32(0))
                    good = np.flatnonzero(held.sum(axis=1) >= needed[n])
                    for g in good:
                        found.setdefault((int(row[at[x[g]]]), int(n[g])), []).append((float(cosine[x[g], b[s + g]]), int(lo[g]), int(hi[g])))
            out = []
            for (r, n), places in found.items():
                item, best = items[n], None
                for cos, lo, hi in sorted(places, reverse=True):
                    lo = max(int(first[r]), lo - len(item.words) // 2)
                    hi = min(int(first[r + 1]), hi + len(item.words) // 2)
                    text = h[lo:hi]
                    coverage = common_subsequence(item.words, item.weight, text)
                    answer = _contains(text, item.answer)
                    if best is None or (coverage, answer) > (best[1], best[2]):
                        best = (cos, coverage, answer, lo - int(first[r]), hi - lo)
                    if coverage > 0.95:
                        break
                if best[1] >= (COVERED_WITH_ANSWER if best[2] else COVERED):
                    out.append((batch.column("doc")[i + r].as_py(), batch.column("tag")[i + r].as_py(), item.item_id, *best))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc", "tag", "item_id", "cosine", "coverage", "answer", "start_word", "n_words"],
                )

    return run


def _contains(text: np.ndarray, part: np.ndarray) -> bool:
    if not len(part) or len(part) > len(text):
        return False
    for s in np.flatnonzero(text[: len(text) - len(part) + 1] == part[0]):
        if (text[s : s + len(part)] == part).all():
            return True
    return False


def contaminated(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keys: bool = False) -> DataFrame:
    """One row for each document and benchmark item that it holds.

    ``doc_id, item_id, cosine, coverage, answer, start_word, n_words``: the
    closest window, the weighted share of the item that is a subsequence of it,
    whether the item's answer occurs in it word for word, and where it is.
    Documents without such an item have no row.

    Words are runs of letters and digits, case ignored.  Null or empty texts and
    items match nothing; a null item id is reported as null; a null document id
    stays null; repeated rows give repeated reports; empty tables give an empty
    result; extra columns are ignored.  With ``keys``, ``doc`` and ``tag`` stand
    in for the id.
    """
    docs = documents_of(documents, id_col, text_col)
    spark = documents.sparkSession
    rows = materialize(docs.mapInArrow(_tokens, ROWS), "tokens")
    tokens = rows.where("kind = 0")
    n = tokens.count()
    df = _added(rows.where("kind = 1"), np.int64)[:, 0] if n else np.zeros(TERMS)
    # Without a cut-off: a leak that many texts hold makes its own terms common.
    weight = np.where(df > 0, np.log((1 + n) / (1 + df)) + LEAST, 0.0).astype(np.float32)
    basis = latent_basis(tokens, weight)
    listed = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    found, block = None, []
    for r in listed.toLocalIterator():
        item = Item(r.item_id, r.text, weight)
        if len(item.words):
            block.append(item)
        if len(block) == ITEMS:
            now = materialize(tokens.mapInArrow(_search(block, weight, basis), FOUND), "found")
            found, block = now if found is None else found.unionByName(now), []
    if block:
        now = materialize(tokens.mapInArrow(_search(block, weight, basis), FOUND), "found")
        found = now if found is None else found.unionByName(now)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    if keys:
        return found
    return found.select(named_id().alias("doc_id"), "item_id", "cosine", "coverage", "answer", "start_word", "n_words")


def decontaminated(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The rows of ``documents`` that hold no benchmark item, unchanged."""
    with passing(documents.sparkSession):
        leaks = contaminated(documents, benchmark, id_col=id_col, text_col=text_col, keys=True, **columns).select("doc", "tag").distinct()
        leaks = small_or_not(materialize(leaks, "leaks", lasting=True))
    return without(documents, leaks, id_col, text_col)
