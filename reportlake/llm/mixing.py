"""Mixing sources to target weights by Pareto order sampling.

Sources get targets in words from their weights, none above a multiple of its
size.  Within a source every document has an expected number of copies, which
grows with the logarithm of its length (``DOUBLINGS``) and is ``MOST_COPIES`` at
most; together they make up the target.  The whole part is certain, and the rest
is the document's inclusion probability ``p``.  Pareto order sampling ranks
documents by the odds of a uniform number over the odds of ``p``,
``(u / (1 - u)) / (p / (1 - p))``, and takes the first until the words that are
still missing are reached: the sample's size is fixed in words.  A document that
would overshoot is left out, and smaller ones that still fit, a few for each
source, come from further down the same order.

Where the order is cut follows from histograms, refined until a cell holds few
documents, so no source has to pass through one task; the cut is a number per
source, and each document decides for itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.shared import materialize, small_or_not

#: Weights of sources in code-point order, repeating. Fixed values.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source, and a document, is taken at most so many times.
MOST_COPIES = 3
#: Doublings of a document's length by which its expected copies grow by those of a single word.
DOUBLINGS = 8
#: Orders through a source: the first, then those that fill up what the last one left.
ORDERS = 4
CLOSE = 0.001
#: Cells of a histogram, and documents of a cell that are then sorted.
CELLS, SORTED = 256, 128
#: Copies of the parameters of a source when they do not fit a broadcast.
SALTS = 64


def word_count(column: str) -> Column:
    """Maximal runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def uniform(seed: int, *columns: Column) -> Column:
    """A number between 0 and 1, both excluded, that follows from the columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / float(1 << 53)


def number_sources(sources: DataFrame) -> DataFrame:
    """``place``: the position of each source in code-point order, null last.

    Ranges of sources are numbered side by side; only their counts, one per
    range, are brought together.
    """
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    null = F.col("source").isNull()
    ranged = sources.repartitionByRange(parts, null, "source").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    counts = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, at = [], 0
    for part in sorted(counts):
        before += [F.lit(part), F.lit(at)]
        at += counts[part]
    if not counts:
        return ranged.withColumn("place", F.lit(0).cast("long")).drop("part")
    from pyspark.sql import Window

    own = F.row_number().over(Window.partitionBy("part").orderBy(null, "source")) - 1
    start = F.create_map(*before)[F.col("part")] if len(counts) > 1 else F.lit(0)
    return ranged.withColumn("place", (own + start).cast("long")).drop("part")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` for ``sizes(source, source_size)``.

    Shares of the total by weight; a source above ``most`` times its size stops
    there, and the excess is shared again by weight until none is above.
    """
    array = F.array(*[F.lit(float(w)) for w in weights])
    table = materialize(
        number_sources(sizes).withColumn("weight", F.element_at(array, (F.col("place") % len(weights) + 1).cast("int"))), "sources"
    )
    cap = F.col("source_size") * float(most)
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    rate, capped, seen = None, F.lit(False), -1
    while True:
        r = table.agg(
            F.sum(F.when(~capped, F.col("weight"))).alias("w"), F.sum(F.when(capped, cap)).alias("c"), F.count_if(capped).alias("n")
        ).first()
        if not r.w:
            break
        new = (total - (r.c or 0.0)) / r.w
        done = r.n == seen
        rate, seen = new, r.n
        if done:
            break
        capped = cap <= F.lit(rate) * F.col("weight")
    share = F.lit(rate) * F.col("weight") if rate is not None else cap
    return table.select("source", F.col("source_size").cast("long").alias("source_size"), F.least(cap, share).cast("double").alias("target"))


def _with_parameters(rows: DataFrame, parameters: DataFrame, on: list[str]) -> DataFrame:
    """Join a row per source to documents: broadcast if counted small, else by salted key."""
    small = small_or_not(parameters)
    same = lambda a, b: a.eqNullSafe(b)
    right = small.withColumnRenamed(on[0], "__key")
    if small is not parameters:
        return rows.join(right, same(rows[on[0]], right["__key"]), "left").drop("__key")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("doc", "size"), F.lit(SALTS)).cast("int"))
    right = right.withColumn("__salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(right, same(salted[on[0]], right["__key"]) & (salted["__salt"] == right["__salt_of"]), "left").drop(
        "__key", "__salt", "__salt_of"
    )


def _cuts(rows: DataFrame, open_sources: DataFrame) -> DataFrame:
    """``source, cut``: take documents of rank up to ``cut`` so that their sizes stay within ``want``.

    ``rows(source, rank, size)``, ``open_sources(source, want)``.  Round by
    round the cell of the histogram in which the sum passes ``want`` is divided,
    until it holds at most ``SORTED`` documents, which are then added up in order.
    """
    from pyspark.sql import Window

    state = open_sources.select("source", "want", F.lit(0.0).alias("lo"), F.lit(1.0).alias("width"), F.lit(0).cast("long").alias("below"))
    state = materialize(state, "state")
    by_source = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    for turn in range(6):
        inside = _with_parameters(rows, state, ["source"]).where("want is not null and rank >= lo and rank < lo + width")
        cell = F.expr(f"least({CELLS - 1}, cast((rank - lo) / width * {CELLS} as int))")
        cells = inside.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("width").alias("width"), F.first("below").alias("below"), F.first("want").alias("want"))
        run = cells.withColumn("upto", F.col("below") + F.sum("words").over(by_source))
        crossing = run.where("upto > want").groupBy("source").agg(F.min_by(F.struct("cell", "upto", "words", "n", "lo", "width", "want"), "cell").alias("c"))
        nxt = crossing.select(
            "source",
            F.expr("c.want").alias("want"),
            F.expr(f"c.lo + c.width * c.cell / {CELLS}").alias("lo"),
            F.expr(f"c.width / {CELLS}").alias("width"),
            F.expr("c.upto - c.words").alias("below"),
            F.expr("c.n").alias("n"),
        )
        nxt = materialize(nxt, "state")
        state = nxt.drop("n")
        if nxt.where(f"n > {SORTED}").isEmpty():
            break
    last = _with_parameters(rows, state, ["source"]).where("want is not null and rank >= lo and rank < lo + width")
    order = Window.partitionBy("source").orderBy("rank", "size")
    run = last.withColumn("upto", F.col("below") + F.sum("size").over(order))  # equal ranks and sizes together
    best = run.groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("want"), F.col("rank"))).alias("cut"), F.min("lo").alias("lo"))
    # A source whose documents all fit has no crossing cell: everything is taken.
    cuts = open_sources.select("source").join(best.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    return cuts.select("source", F.when(F.col("s").isNull() & F.col("lo").isNull(), F.lit(2.0)).otherwise(F.coalesce("cut", F.col("lo") - 1e-300)).alias("cut"))


class Mix:
    """A fitted mix: a few numbers per source, from which each document's copies follow."""

    def __init__(self, sources: DataFrame, orders: DataFrame, seed: int):
        self.sources, self.orders, self.seed = sources, orders, seed

    def rank(self) -> Column:
        """The document's place in its source's Pareto order, between 0 and 1; null if it has no odds."""
        u, p = uniform(self.seed, F.col("doc"), F.col("size")), F.col("p")
        q = (u / (1 - u)) * ((1 - p) / p)
        return F.when((p > 0) & (F.col("size") > 0), q / (1 + q))

    def copies(self, rows: DataFrame) -> DataFrame:
        """Add ``source_size, target, copies`` to ``rows(doc, source, size, ...)``."""
        out = _expected(rows, self.sources).withColumn("rank", self.rank())
        out = _with_parameters(out, self.orders, ["source"])
        hit = F.exists("cuts", lambda c: (F.col("rank") <= c["cut"]) & (F.col("size") <= c["most"]))
        extra = F.coalesce(hit, F.lit(False)).cast("long")
        return out.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(F.lit(0))).drop(
            "cuts", "rank", "p", "whole"
        )


def length_class(size: str = "size") -> Column:
    """Doublings of a document's length: documents of a source and class are expected equally often."""
    return F.when(F.col(size) > 0, F.floor(F.log2(F.col(size).cast("double")) + 1e-9)).otherwise(F.lit(0)).cast("int")


def expected_copies(targeted: DataFrame, cells: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Add ``rates`` and ``want`` to ``targeted(source, source_size, target)``.

    ``cells(source, class, words)``.  ``rates`` has the expected copies by class:
    a source's factor times ``1 + class / DOUBLINGS``, at most ``most``.  Classes
    that reach it do so from the longest down, so the factor is that of the first
    class from which on none does.  ``want`` is what certain copies leave open.
    """
    own = cells.groupBy(F.col("source").alias("s")).agg(F.sort_array(F.collect_list(F.struct("class", "words")), False).alias("a"))  # a class for each doubling
    out = targeted.join(own, F.col("source").eqNullSafe(F.col("s")), "left")
    heavy = f"(1 + a[j].class / {DOUBLINGS}D)"
    open_from = f"aggregate(slice(a, j + 1, size(a)), 0D, (t, x) -> t + (1 + x.class / {DOUBLINGS}D) * x.words)"
    factor = f"(target - {most} * aggregate(slice(a, 1, j), 0D, (t, x) -> t + x.words)) / nullif({open_from}, 0D)"
    steps = out.withColumn("factors", F.expr(f"transform(sequence(0, size(a) - 1), j -> struct({factor} as c, {heavy} as m))"))
    steps = steps.withColumn("factor", F.expr(f"element_at(filter(factors, f -> f.c * f.m <= {most} + 1e-9), 1).c"))
    top = "array_max(transform(a, x -> x.class))"
    rate = f"least({most}D, coalesce(factor * (1 + k / {DOUBLINGS}D), {most}D))"
    steps = steps.withColumn("rates", F.expr(f"case when source_size > 0 then transform(sequence(0, {top}), k -> {rate}) end"))
    want = "target - aggregate(a, 0D, (t, x) -> t + floor(rates[x.class] + 1e-12) * x.words)"
    return steps.select("source", "source_size", "target", "rates", F.expr(f"case when source_size > 0 then {want} else 0D end").alias("want"))


def _expected(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Add the certain copies and the probability of one more."""
    out = _with_parameters(rows, sources.drop("want"), ["source"])
    rate = F.coalesce(F.get("rates", length_class()), F.lit(0.0))
    whole = F.floor(rate + 1e-12)
    rest = rate - whole
    return out.withColumn("whole", whole.cast("long")).withColumn("p", F.when(rest > 1e-9, rest).otherwise(F.lit(0.0))).drop("rates")


def fit(rows: DataFrame, seed: int = 20, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> Mix:
    """Targets and cuts for materialized ``rows(doc, source, size)``."""
    cells = rows.groupBy("source", length_class().alias("class")).agg(F.sum("size").cast("long").alias("words"))
    cells = materialize(cells, "cells")
    sizes = cells.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))
    sources = materialize(expected_copies(targets(sizes, weights, most), cells, most), "targets")
    ranked = _expected(rows, sources)
    mix = Mix(sources, None, seed)
    ranked = materialize(ranked.withColumn("rank", mix.rank()).where("rank is not null").select("doc", "source", "size", "rank"), "ranked")
    open_sources = sources.where("source_size > 0").select("source", "want", "target")
    cuts = None
    for turn in range(ORDERS + 1):
        if turn:
            open_sources = open_sources.where(f"want >= 1 and want > {CLOSE} * target")
        open_sources = materialize(open_sources, "open")
        if open_sources.isEmpty():
            break
        # Whom earlier orders have taken is out; who is larger than what is missing, too.
        rest = ranked
        if cuts is not None:
            rest = _with_parameters(rest, cuts, ["source"])
            rest = rest.where(~F.coalesce(F.exists("cuts", lambda c: (F.col("rank") <= c["cut"]) & (F.col("size") <= c["most"])), F.lit(False)))
            limit = open_sources.select("source", F.col("want").alias("limit"))
            last = turn == ORDERS
            fits = "size < 2 * limit" if last else "size <= limit"
            rest = _with_parameters(rest.drop("cuts"), limit, ["source"]).where(fits).select("doc", "source", "size", "rank")
            rest = materialize(rest, "rest")
            if last:
                one = rest.groupBy(F.col("source").alias("s")).agg(F.min(F.struct("size", "rank")).alias("one"))
                now = one.select(F.col("s").alias("source"), F.expr("array(struct(one.rank as cut, cast(one.size as double) as most))").alias("cuts"))
                cuts = _joined(cuts, materialize(now, "cuts"))
                break
        most_now = F.lit(float("inf")) if cuts is None else F.col("want")
        cut = _cuts(rest, open_sources)
        now = cut.withColumnRenamed("source", "s").join(open_sources, F.col("s").eqNullSafe(F.col("source"))).select("source", "want", "target", F.array(F.struct(F.col("cut").alias("cut"), most_now.alias("most"))).alias("cuts"))
        now = materialize(now, "cuts")
        taken = _with_parameters(rest, now.select("source", "cuts"), ["source"]).where(F.exists("cuts", lambda c: F.col("rank") <= c["cut"]))
        taken = taken.groupBy("source").agg(F.sum("size").alias("got"))
        left = now.withColumnRenamed("source", "s").join(taken, F.col("s").eqNullSafe(F.col("source")), "left")
        open_sources = left.select(F.col("s").alias("source"), (F.col("want") - F.coalesce("got", F.lit(0))).alias("want"), "target")
        now = now.select("source", "cuts")
        cuts = now if cuts is None else _joined(cuts, now)
    if cuts is None:
        cuts = sources.limit(0).select("source", F.expr("cast(array() as array<struct<cut:double,most:double>>)").alias("cuts"))
    mix.orders = cuts
    return mix


def _joined(cuts: DataFrame, more: DataFrame) -> DataFrame:
    """The cuts of all orders so far, one array per source."""
    more = more.select(F.col("source").alias("s"), F.col("cuts").alias("more"))
    both = cuts.join(more, F.col("source").eqNullSafe(F.col("s")), "left")
    none = F.expr("cast(array() as array<struct<cut:double,most:double>>)")
    return materialize(both.select("source", F.concat("cuts", F.coalesce("more", none)).alias("cuts")), "cuts")


def measured(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc, source, size)``: all that fitting a mix needs."""
    return documents.select(F.col(id_col).cast("long").alias("doc"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"))


def plan_mix(documents: DataFrame, seed: int = 20, **columns) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` with one row per document.

    ``taken`` is ``copies`` times ``size``.  The same input gives the same mix,
    however it is partitioned.  Null and empty texts have size 0 and are not
    taken; a null source is a source like any other and comes last; rows with
    null ids are drawn like others.  Equal rows are drawn together, as their
    random number follows from id and size.  Empty tables give empty results;
    extra columns are ignored.
    """
    rows = materialize(measured(documents, **columns), "sizes")
    out = fit(rows, seed).copies(rows)
    return out.select(
        F.col("doc").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("copies").cast("long").alias("copies")
    )


def mix_documents(documents: DataFrame, seed: int = 20, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``documents`` as many times as it is taken, unchanged."""
    own = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), own)
    mix = fit(materialize(rows.select("doc", "source", "size"), "sizes"), seed)
    out = mix.copies(rows).where("copies > 0")
    return out.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
