"""Near-duplicate detection with fast similarity sketching.

A sketch of ``t`` coordinates is filled in rounds.  In a round each shingle of
the set is hashed to one coordinate, and a coordinate that is still empty keeps
the smallest hash it gets; after ``t`` such rounds, round ``t + i`` hashes all
shingles to coordinate ``i``, so that every coordinate is filled for certain.
Unlike one permutation with holes this keeps the concentration of independent
minima, at a cost of a few hashes per shingle.

Sketches are banded.  Documents with equal sets are one class from the start.
In each band's bucket the smallest class is compared with all others, then, where
several components are left, a member drawn by hash.  Of what these stars leave in
separate components, pairs are formed only where two sets share one of their rarest
shingles early enough for a link (see ``_rest``), so no link is lost and no bucket's
pairs are written out.  A pair of a star whose whole sketches agree too little is no
link; the rest are settled on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.graph import components
from reportlake.llm.kernels import U, Words, mix, ranges, text_blocks
from reportlake.llm.repeats import unpacked
from reportlake.llm.shared import NO_ID, documents_of, materialize, named_id, passing, small_or_not, without

WORDS = 5
#: 48 bands of 5: a pair at similarity 0.75 misses all of them with a chance of 2e-6.
BANDS, ROWS = 48, 5
#: Further rounds in which buckets of several components are compared with one drawn member.
STARS = 1
#: Standard deviations by which a sketch may fall short of the similarity asked for; 5 lose 3 pairs in ten million.
SHORT = 5.0
#: Sets of one class of size differ by less than this factor.
STEP = 1.05
_SKETCHED = "doc long, tag long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary"


def shingles(buf: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of a block in ascending order by document, and their starts."""
    w = Words(buf, offs)
    h = w.hashes(buf, lower=True)
    odd = mix(np.arange(1, words + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    at = np.arange(len(h)) - w.first[w.doc]
    full = np.flatnonzero(at + words <= w.count[w.doc])
    value = np.zeros(len(full), dtype=U)
    for i in range(words):
        value += h[full + i] * odd[i]
    of = w.doc[full]
    short = np.flatnonzero((w.count > 0) & (w.count < words))
    if len(short):
        part = np.zeros(len(short), dtype=U)
        for i in range(words - 1):
            there = w.count[short] > i
            part[there] += h[w.first[short[there]] + i] * odd[i]
        value = np.concatenate([value, part ^ mix(w.count[short].astype(U))])
        of = np.concatenate([of, short])
    value = mix(value)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(len(offs)))


def sketch(values: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """One row of ``t`` coordinates per non-empty set; sets are slices of ``values`` at ``first``."""
    sizes = np.diff(first)
    n = len(sizes)
    out = np.full(n * t, np.iinfo(np.uint64).max, dtype=U)
    open_sets = np.arange(n)
    for turn in range(2 * t):
        rows = np.repeat(open_sets, sizes[open_sets])
        h = mix(values[ranges(first[:-1][open_sets], sizes[open_sets])] ^ mix(np.array([turn + 1], dtype=U)))
        if turn < t:
            cell = rows * t + (((h >> U(32)) * U(t)) >> U(32)).astype(np.int64)
            there = out[cell] == np.iinfo(np.uint64).max
            cell, h = cell[there], h[there]
        else:
            cell = rows * t + (turn - t)
            there = out[cell] == np.iinfo(np.uint64).max
            cell, h = cell[there], h[there]
        if len(cell):
            np.minimum.at(out, cell, (U(turn) << U(32)) | (h & U(0xFFFFFFFF)))
        full = (out.reshape(n, t)[open_sets] != np.iinfo(np.uint64).max).all(axis=1)
        open_sets = open_sets[~full]
        if not len(open_sets):
            break
    return out.reshape(n, t)


def bands_of(rows: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    odd = mix(np.arange(1, per_band + 1, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)
    key = (rows.reshape(len(rows), bands, per_band) * odd).sum(axis=2, dtype=U)
    return mix(key + mix(np.arange(1, bands + 1, dtype=U)))


def _sketches(words: int, bands: int, per_band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in text_blocks(batch):
                value, first = shingles(buf, offs, words)
                sizes = np.diff(first)
                some = np.flatnonzero(sizes)
                d1, d2 = np.zeros(j - i, dtype=U), np.zeros(j - i, dtype=U)
                lists, short = pa.nulls(j - i, pa.list_(pa.int64())), pa.nulls(j - i, pa.binary())
                if len(some):
                    d1[some] = np.add.reduceat(mix(value ^ U(0xA5A5A5A5)), first[some])
                    d2[some] = np.add.reduceat(mix(value + U(0x5BD1E995)), first[some])
                        # Of equal sets in a block only the first that has an id carries bands.
                    ids = batch.column("doc").slice(i, j - i).to_numpy()
                    lead = some[ids[some] < NO_ID]
                    _, one = np.unique(np.stack([d1[lead], d2[lead]], axis=1), axis=0, return_index=True)
                    lead = np.sort(lead[one])
                    own = value[ranges(first[lead], sizes[lead])]
                    filled = sketch(own, np.concatenate([[0], np.cumsum(sizes[lead])]), bands * per_band)
                    keys = bands_of(filled, bands, per_band)
                    has = np.zeros(j - i, dtype=bool)
                    has[lead] = True
                    offsets = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)), mask=pa.array(~has))
                    # The last byte of each coordinate is enough to estimate a similarity.
                    low = np.ascontiguousarray((filled & U(0xFF)).astype(np.uint8))
                    width = np.concatenate([[0], np.cumsum(has * low.shape[1])]).astype(np.int32)
                    valid = pa.array(has).buffers()[1]
                    short = pa.Array.from_buffers(pa.binary(), j - i, [valid, pa.py_buffer(width), pa.py_buffer(low)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(i, j - i), batch.column("tag").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists, short],
                    names=["doc", "tag", "n_shingles", "d1", "d2", "bands", "sketch"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in text_blocks(batch):
                value, first = shingles(buf, offs, words)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(i, j - i), batch.column("tag").slice(i, j - i), lists], names=["rep", "tag", "set"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs(a, b)``: intersection and union of full sets, as integers."""
    size = F.size("set").alias
    near = (
        pairs.join(sets.select(F.col("rep").alias("a"), size("na")), "a")
        .join(sets.select(F.col("rep").alias("b"), size("nb")), "b")
        .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        .select("a", "b")
    )
    full = near.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("sb")), "b").join(
        sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a"
    )
    both = full.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("n"), (F.size("sa") + F.size("sb")).alias("m"))
    return both.where(f"100 * n >= {percent} * (m - n)").select("a", "b")


def _plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` whose sketches agree in about as many coordinates as a link's would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (unpacked(batch.column(c), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
            t, p = x.shape[1], percent / 100
            enough = (x == y).sum(axis=1) >= t * p - SHORT * np.sqrt(t * p * (1 - p))
            yield batch.select(["a", "b"]).filter(pa.array(enough))

    both = pairs.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("x")), "a").join(
        sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("y")), "b"
    )
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _tagged(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components: ``key, rep, component``."""
    tagged = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    tagged = materialize(tagged, "tagged")
    mixed = tagged.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return materialize(tagged.join(mixed, "key"), "mixed")


def _star(mixed: DataFrame, turn: int) -> DataFrame:
    """In every bucket of several components, a member drawn by hash with those of other components."""
    drawn = F.xxhash64("rep", "key", F.lit(turn))
    centers = mixed.groupBy("key").agg(F.max(F.struct(drawn.alias("h"), "rep", "component")).alias("c"))
    centers = centers.select("key", F.col("c.rep").alias("center"), F.col("c.component").alias("own"))
    pairs = mixed.join(centers, "key").where("component <> own")
    return pairs.select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b")).distinct()


def _rest(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs ``(a, b)`` of different components that can still be links, and few others.

    Shingles are put in one order, rare ones first.  Two sets of ``n`` and ``m``
    shingles that are linked have ``k = ceil(p (n + m) / (100 + p))`` in common at
    least, so the first shingle that they share has at most ``n - k`` before it in
    one and ``m - k`` in the other.  Copies of one text that were edited too much,
    or texts around one common passage, differ in just their rare shingles: they
    share none so early, and no pair is formed.  Sets meet by shingle and classes of
    size, each set with as many shingles as a partner of the other class can need.
    Of those that meet the most frequent component's are not compared with each other.
    """
    own = mixed.select("rep", "component").distinct().join(sets, "rep").select("rep", "tag", "component", F.size("set").alias("n"), F.explode("set").alias("token"))
    held = own.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    lists = own.join(held, "token").groupBy("rep", "tag", "component", "n").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("tokens"))
    # Shingles of one set alone come first; of them only the number matters.
    early = f"n - cast(ceil({percent} * n / 100) as int) + 1"
    lists = lists.selectExpr("rep", "component", "n", "n - size(tokens) as alone", f"slice(tokens, 1, greatest(0, {early} - (n - size(tokens)))) as tokens")
    posted = lists.select("rep", "component", "n", "alone", F.posexplode("tokens").alias("i", "t"))
    posted = materialize(posted.selectExpr("t.token as token", "rep", "component", "n", f"cast(floor(ln(n) / ln({STEP})) as int) as size", "alone + i as pos"), "posted")
    # How early depends on both sizes: a posting is aimed at those classes of size that its shingle has.
    need = f"cast(ceil({percent} * (n + %s) / {100 + percent}) as int)"
    held = posted.groupBy("token", F.col("size").alias("other")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("first"), F.max("component").alias("last")
    )
    aimed = posted.join(held, "token").where(
        f"(first <> component or last <> component) and 100 * most >= {percent} * n and 100 * n >= {percent} * least and pos <= n - {need % 'least'}"
    )
    aimed = materialize(aimed.selectExpr("token", "size", "other", "least(size, other) as lo", "greatest(size, other) as hi", "rep", "component", "n", "pos"), "aimed")
    cells = aimed.groupBy("token", "lo", "hi", "component").agg(F.count("*").alias("m"))
    most = cells.groupBy("token", "lo", "hi").agg(F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    some = aimed.join(most.selectExpr("token", "lo", "hi", "top.component as most"), ["token", "lo", "hi"])
    some = materialize(some.select("token", "size", "other", "rep", "component", "n", "pos", "most"), "shared")
    minor = some.where("component <> most").selectExpr("token", "size as other", "other as size", "rep as a", "component as ca", "n as na", "pos as pa")
    pairs = minor.join(some, ["token", "size", "other"]).where(
        f"component <> ca and (component = most or a < rep) and 100 * least(n, na) >= {percent} * greatest(n, na) and pos <= n - {need % 'na'} and pa <= na - {need % 'na'}"
    )
    return pairs.select(F.least("rep", "a").alias("a"), F.greatest("rep", "a").alias("b")).distinct()


def _one_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the classes of rows that share an id."""
    sums = rows.groupBy("doc").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.min("d2").alias("lo2"), F.max("d2").alias("hi2"))
    ids = sums.where("lo <> hi or lo2 <> hi2").select("doc")
    held = rows.join(ids, "doc").select("doc", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"])
    return held.where("rep <> doc").select(F.col("rep").alias("a"), F.col("doc").alias("b"))


def near_duplicates(
    documents: DataFrame,
    similarity: int = 75,
    *,
    words: int = WORDS,
    bands: int = BANDS,
    rows_per_band: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc, tag, n_shingles, component)`` with one row per row of ``documents``.

    Documents are linked when the Jaccard similarity of their sets of word
    shingles is at least ``similarity`` percent.  Words are maximal runs without
    ASCII white space in lower case (A to Z only).  A text with fewer words than
    a shingle has its whole sequence as its only element; one without words has
    an empty set and no link.
    """
    docs = documents_of(documents, id_col, text_col)
    sketched = materialize(docs.mapInArrow(_sketches(words, bands, rows_per_band), _SKETCHED), "sketches")
    some = sketched.where(f"n_shingles > 0 and doc < {NO_ID}")
    classes = some.groupBy("d1", "d2").agg(F.min(F.struct("doc", "tag")).alias("one"), F.first("bands", ignorenulls=True).alias("bands"), F.first("sketch", ignorenulls=True).alias("sketch"))
    classes = materialize(classes.select("d1", "d2", F.col("one.doc").alias("rep"), F.col("one.tag").alias("rep_tag"), "bands", "sketch"), "classes")
    # A class is named by its smallest document; classes that share that name, or an id, are one.
    exploded = classes.select("rep", F.explode("bands").alias("key"))
    stars = exploded.groupBy("key").agg(F.min("rep").alias("center"), F.max("rep").alias("far")).where("center <> far").select("key", "center")
    members = materialize(exploded.join(stars, "key"), "members")
    pairs = members.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = materialize(_plausible(pairs, classes, similarity), "pairs")
    members = members.select("key", "rep").distinct()
    wanted = members.select("rep").distinct()
    source = classes.join(wanted, "rep").select("rep", F.col("rep").alias("doc"), F.col("rep_tag").alias("tag"))
    source = small_or_not(materialize(source, "source"))
    with_sets = docs.join(source, ["doc", "tag"]).select("rep", "tag", "text").mapInArrow(_sets(words), "rep long, tag long, set array<long>")
    sets = materialize(with_sets, "sets")
    if sets.count() > source.count():  # repeated rows
        sets = materialize(sets.dropDuplicates(["rep", "tag"]), "sets")
    links = materialize(_verified(pairs, sets, similarity).unionByName(_one_id(some, classes)), "links")
    labels = components(links)
    for turn in range(STARS + 1):
        mixed = _tagged(members, labels)
        if mixed.isEmpty():
            break
        near = _plausible(_star(mixed, turn), classes, similarity) if turn < STARS else _rest(mixed, sets, similarity)
        near = materialize(near, "near")
        more = materialize(_verified(near, sets, similarity), "links")
        if not more.isEmpty():
            labels = components(more, labels)
    named = classes.select("d1", "d2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    joined = sketched.join(named, ["d1", "d2"], "left")
    return joined.select(
        "doc", "tag", "n_shingles", F.when((F.col("n_shingles") > 0) & (F.col("doc") < NO_ID), F.col("component")).otherwise(F.col("doc")).alias("component")
    )


def mark(documents: DataFrame, similarity: int = 75, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: see :func:`near_duplicates`.

    ``component_id`` is the smallest id reachable by links, the document's own
    included, and ``kept`` says whether that is the document itself.  A row with
    a null id is linked with nothing: its component is null and it is kept.
    Repeated rows have one id and are kept or not together; rows that share an
    id are one node, even if their texts differ.  Null texts count as empty.
    Empty tables give empty results; extra columns are ignored.
    """
    found = near_duplicates(documents, similarity, **options)
    return found.select(
        named_id().alias("doc_id"),
        "n_shingles",
        named_id("component").alias("component_id"),
        (F.col("doc") == F.col("component")).alias("kept"),
    )


def deduplicated(documents: DataFrame, similarity: int = 75, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` that :func:`mark` keeps, unchanged."""
    with passing(documents.sparkSession):
        found = near_duplicates(documents, similarity, id_col=id_col, text_col=text_col, **options)
        gone = small_or_not(materialize(found.where("doc <> component").select("doc", "tag").distinct(), "copies", lasting=True))
    return without(documents, gone, id_col, text_col)
