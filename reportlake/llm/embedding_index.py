"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its nearest reference points, the pivots, in order.
Vectors that nearly coincide order the pivots nearly alike, so an inverted list
is kept for every pair of pivots that a vector has among its nearest: meeting in
one list means sharing two pivots at least.  Candidates of a list whose number
of shared pivots among a longer prefix of the order is high enough are verified
by their cosine in double precision.

Pivots are fitted on a bounded sample; every vector is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportlake.llm.graph import components
from reportlake.llm.kernels import ranges
from reportlake.llm.repeats import runs_of, unpacked
from reportlake.llm.shared import NO_ID, bucket_count, id_key, materialize, named_id

#: Vectors, by hash order, on which pivots are fitted, and so the most pivots; the fewest.
#: Between these there are twice the root of the number of vectors, so lists stay short as a table grows.
SAMPLE = 4096
PIVOTS = 128
#: Pivots of a vector whose pairs are listed; length of the order whose shared pivots are counted, and how many must be.
LISTED = 6
PREFIX = 12
SHARED = 4
#: Members of a list that one task compares; longer lists are compared block by block.
BLOCK = 512
#: Pairs that a task compares at once.
PAIRS = 1 << 15


#: More than any pivot's number.
_SPAN = 1 << 13


def _unit(v: np.ndarray) -> np.ndarray:
    unit = v / np.abs(v).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of a list, as doubles; some may have travelled as single floats."""
    single = pc.equal(pc.binary_length(column), 4 * dim).to_numpy()
    out = np.empty((len(single), dim))
    mask = pa.array(single)
    out[single] = unpacked(column.filter(mask), np.float32).reshape(-1, dim)
    out[~single] = unpacked(column.filter(pc.invert(mask)), np.float64).reshape(-1, dim)
    return out


def usable(vector: str = "embedding") -> str:
    """SQL: the vector can be compared at all."""
    return f"({vector} is not null and size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vector}, x -> x <> 0))"


def fit_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """For each dimension that occurs, unit pivots chosen far apart from a sample of ``sample`` vectors.

    ``vectors(embedding array<double>)``; the sample is the first by hash, the
    same at every run.
    """
    rows = vectors.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample).collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r.embedding), []).append(r.embedding)
    out = {}
    for dim, data in by_dim.items():
        x = np.array(data, dtype=np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        chosen, near = [0], x @ x[0]
        while len(chosen) < min(pivots, len(x)):
            chosen.append(int(np.argmin(near)))
            near = np.maximum(near, x @ x[chosen[-1]])
        out[dim] = x[chosen]
    return out


def _postings(pivots: dict[int, np.ndarray], listed: int, prefix: int):
    """One row per vector and pair of its nearest pivots."""

    def run(batches):
        for batch in batches:
            dims = np.array([len(v) for v in batch.column("embedding")], dtype=np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(rows))
                v = np.asarray(part.column("embedding").flatten(), dtype=np.float64).reshape(len(rows), dim)
                unit = _unit(v)
                base = pivots.get(int(dim))
                if base is None:  # a dimension that the sample lacks: one list for all
                    order = np.zeros((len(rows), 1), dtype=np.int64)
                else:
                    order = np.argsort(-(unit @ base.T), axis=1, kind="stable")[:, :prefix]
                head = np.sort(order[:, :listed], axis=1)
                a, b = np.triu_indices(head.shape[1], 1) if head.shape[1] > 1 else (np.array([0]), np.array([0]))
                keys = (head[:, a] * _SPAN + head[:, b]) + int(dim) * _SPAN * _SPAN
                n = keys.shape[1]
                at = np.repeat(np.arange(len(rows)), n)
                mask = order.astype(np.int16)
                exact = bool((v.astype(np.float32) == v).all())  # a block of single floats travels as such
                fixed = lambda x: pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * x.shape[1] * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("label").take(pa.array(at)),
                        pa.array(keys.reshape(-1), pa.int64()),
                        part.column("rep").take(pa.array(at)),
                        part.column("copies").take(pa.array(at)),
                        fixed(v.astype(np.float32) if exact else v).take(pa.array(at)),
                        fixed(mask).take(pa.array(at)),
                    ],
                    names=["label", "list", "rep", "copies", "vector", "nearest"],
                )

    return run


POSTING = "label string, list long, rep long, copies long, vector binary, nearest binary"
FOUND = "rep long, links long, near long"


def _matches(cosine: float, listed: int, shared: int):
    """Compare the members of each list, or of two blocks of it; count links, name a neighbour.

    A pair that meets in several lists counts in the first: that of the two
    smallest pivots that both have among their listed ones.  A task has many
    lists, whose pairs are formed ``PAIRS`` at a time.
    """

    def run(table: pa.Table) -> pa.Table:
        key = table.column("list").to_numpy()
        out = [one(table.filter(pa.array(key // (_SPAN * _SPAN) == dim)), int(dim)) for dim in np.unique(key // (_SPAN * _SPAN))]
        return pa.concat_tables(out)

    def one(table: pa.Table, dim: int) -> pa.Table:
        n = table.num_rows
        key, block = table.column("list").to_numpy(), table.column("block").to_numpy()
        left, right = table.column("left").to_numpy(), table.column("right").to_numpy()
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((block != left, right, left, key, label))
        table = table.take(pa.array(order))
        key, block, left, right, label = (x[order] for x in (key, block, left, right, label))
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        unit = _unit(_vectors(table.column("vector"), dim))
        nearest = unpacked(table.column("nearest"), np.int16).reshape(n, -1)
        enough = min(shared, nearest.shape[1])
        # Partners of a row: those after it in its block, or the whole other block.
        starts, group = runs_of(label, key, left, right)
        ends = np.append(starts[1:], n)
        second = starts + np.add.reduceat((block == left).astype(np.int64), starts)
        same = left == right
        first = np.where(same, np.arange(n) + 1, second[group])
        count = np.where(same | (block == left), ends[group] - first, 0)
        upto = np.concatenate([[0], np.cumsum(count)])
        pairs: list[np.ndarray] = []
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + PAIRS, side="right")) - 1)
            a, b = np.repeat(np.arange(i, j), count[i:j]), ranges(first[i:j], count[i:j])
            i = j
            keep = rep[a] != rep[b]
            keep[keep] = (nearest[a[keep]][:, :, None] == nearest[b[keep]][:, None, :]).sum(axis=(1, 2)) >= enough
            a, b = a[keep], b[keep]
            keep = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
            a, b = a[keep], b[keep]
            if nearest.shape[1] > 1:
                mine = nearest[a, :listed].astype(np.int64)
                both = (mine[:, :, None] == nearest[b, None, :listed]).any(axis=2)
                least = np.sort(np.where(both, mine, _SPAN), axis=1)
                keep = (least[:, 0] == key[a] // _SPAN % _SPAN) & (least[:, 1] == key[a] % _SPAN)
                a, b = a[keep], b[keep]
            pairs.append(np.stack([a, b]))
        a, b = np.concatenate(pairs, axis=1)
        links = np.zeros(n, dtype=np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        # Enough links to hold the group together: each vector and the smallest it is connected with here.
        name = rep.copy()
        while True:
            before = name.copy()
            np.minimum.at(name, a, before[b])
            np.minimum.at(name, b, name[a])
            if (name == before).all():
                break
        hit = links > 0
        return pa.table({"rep": pa.array(rep[hit], pa.int64()), "links": pa.array(links[hit], pa.int64()), "near": pa.array(name[hit], pa.int64())})

    return run


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.98,
    *,
    pivots: int | None = None,
    sample: int = SAMPLE,
    listed: int = LISTED,
    prefix: int = PREFIX,
    shared: int = SHARED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` with one row per row of ``vectors``.

    Vectors of equal label and dimension whose cosine is at least ``cosine`` are
    linked, as far as the index finds them; none below it is.  ``n_links``
    counts the other rows linked directly, ``component_id`` is the smallest id
    reachable, the own one included.

    Linked with nothing: rows whose label or id is null, and vectors that are
    null, empty or zero or hold null or non-finite components.  A null id stays
    null and is kept.  Equal vectors under one label are one class, compared
    once; each of them counts as a link of the others, repeated rows included.
    Empty tables give empty results; extra columns are ignored.
    """
    rows = vectors.select(
        id_key(id_col).alias("vec"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast(T.ArrayType(T.DoubleType())).alias("embedding"),
    )
    good = F.expr(f"vec < {NO_ID} and label is not null and {usable()}")
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("hash", F.xxhash64("embedding"))
    # Zero has two signs; vectors are equal as values.
    rows = rows.withColumn("embedding", F.expr("transform(embedding, x -> x + double(0))")).withColumn("hash", F.xxhash64("embedding"))
    usable_rows = rows.where("good")
    classes = usable_rows.groupBy("label", "hash", "embedding").agg(F.min("vec").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes")
    base = fit_pivots(classes, pivots or max(PIVOTS, int(2 * classes.count() ** 0.5)), sample)
    postings = classes.select("label", "rep", "copies", "embedding").mapInArrow(_postings(base, listed, prefix), POSTING)
    postings = materialize(postings, "postings")
    sizes = postings.groupBy("label", "list").agg(F.count("*").alias("n"))
    sizes = materialize(sizes.where("n > 1").selectExpr("label", "list", f"cast(ceil(n / {BLOCK}) as int) as blocks"), "sizes")
    blocked = postings.join(sizes, ["label", "list"]).withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    paired = blocked.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).selectExpr(
        "label", "list", "rep", "copies", "vector", "nearest", "block", "least(block, other) as left", "greatest(block, other) as right"
    )
    dealt = paired.withColumn("bucket", F.pmod(F.xxhash64("label", "list", "left", "right"), F.lit(bucket_count(postings))))
    matched = dealt.groupBy("bucket").applyInArrow(_matches(cosine, listed, shared), FOUND)
    matched = materialize(matched, "matches")
    labels = components(matched.where("rep <> near").select(F.col("rep").alias("a"), F.col("near").alias("b")))
    counts = matched.groupBy("rep").agg(F.sum("links").alias("links"))
    named = (
        classes.select("label", "hash", "embedding", "rep", "copies")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .join(counts, "rep", "left")
        .select("label", "hash", "embedding", F.expr("copies - 1 + coalesce(links, 0)").alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    out = rows.where("good").join(named, ["label", "hash", "embedding"]).select("vec", "links", "component")
    rest = rows.where("not good").select("vec", F.lit(0).cast("long").alias("links"), F.col("vec").alias("component"))
    return out.unionByName(rest).select(
        named_id("vec").alias("vec_id"),
        F.col("links").alias("n_links"),
        named_id("component").alias("component_id"),
        (F.col("vec") == F.col("component")).alias("kept"),
    )
