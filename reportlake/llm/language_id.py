"""Language identification by fusing evidence.

Four kinds of evidence meet in one posterior over the languages:

* the text, by naive Bayes over byte trigrams, whose weight stops growing after
  ``TEXT_GRAMS`` trigrams, as neighbouring ones are not independent;
* the language that the markup declares, through how often pages declare it for
  each language that their text shows;
* the address: hosts, their domains and suffixes have prior distributions, each
  smoothed by the one above it, suffixes by that of all rows.

Priors and declarations are counted over all rows by grouped aggregation of
the text's posteriors.  Trigram counts are fitted on a bounded sample of
labelled documents (``SAMPLE`` of each language in expectation, drawn by hash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.kernels import _LOWER, U, mix, text_blocks
from reportlake.llm.shared import BROADCAST_ROWS, id_key, materialize, passing, small_or_not

#: Hashed trigrams; labelled documents of a language to fit on.
GRAMS, SAMPLE = 1 << 14, 1500
#: Trigrams of text that count in full; smoothing mass of each level of the address and of declarations.
TEXT_GRAMS, MASS = 64, 20.0
#: Posterior from which a row is accepted, and trigrams with a letter that it must have.
ACCEPT, LEAST_GRAMS = 0.5, 1
#: Copies of the rows of a table that is too large for a broadcast, for a hot key's sake.
SALTS = 64

SCORES = "key long, grams long, text array<double>"


def _trigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams that hold a letter, and the row of each."""
    if len(buf) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low = _LOWER[buf]
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    low = np.where(letter, low, 32).astype(U)
    code = (low[:-2] << U(16)) | (low[1:-1] << U(8)) | low[2:]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    good = np.flatnonzero((row[:-2] == row[2:]) & (letter[:-2] | letter[1:-1] | letter[2:]))
    return (mix(code[good]) >> U(50)).astype(np.int64), row[good]


def _counts(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        place = {name: i for i, name in enumerate(languages)}
        for batch in batches:
            label = np.array([place[x] for x in batch.column("label").to_pylist()], dtype=np.int64)
            for i, _, buf, offs in text_blocks(batch):
                gram, row = _trigrams(buf, offs)
                held, line = np.unique(label[i + row], return_inverse=True)
                counts = np.bincount(line * GRAMS + gram, minlength=len(held) * GRAMS).reshape(len(held), GRAMS)
                for k, own in zip(held.tolist(), counts, strict=True):
                    total[k] = total[k] + own if k in total else own
        lines = [(k, own.tobytes()) for k, own in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in lines], pa.int32()), pa.array([x[1] for x in lines], pa.binary())], names=["language", "data"])

    return run


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of trigrams, from ``labelled(text, label)``.

    About ``sample`` rows of each label that occurs are used, those with the
    smallest hashes.
    """
    rows = labelled.where("label is not null and text is not null")
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).collect()
    if not counts:
        return [], np.zeros((0, GRAMS))
    languages = sorted(r.label for r in counts)
    share = {r.label: min(1.0, sample / r.n) for r in counts}
    chance = F.create_map(*[F.lit(x) for name in languages for x in (name, share[name])])[F.col("label")]
    drawn = F.shiftrightunsigned(F.xxhash64("text"), 11).cast("double") / float(1 << 53)
    chosen = rows.where(F.col("label").isin(languages)).where(drawn < chance)
    total = np.zeros((len(languages), GRAMS))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for language, data in zip(batch.column("language").to_pylist(), batch.column("data"), strict=True):
                own = np.frombuffer(data.as_buffer(), dtype=np.int64)
                sums[language] = sums[language] + own if language in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["language", "data"])

    each = chosen.select("text", "label").mapInArrow(_counts(languages), "language int, data binary")
    for r in each.repartition(len(languages), "language").mapInArrow(add, "language int, data binary").collect():
        total[r.language] += np.frombuffer(r.data, dtype=np.int64)
    smooth = total + 0.5
    return languages, np.log(smooth / smooth.sum(axis=1, keepdims=True))


def _scores(table: np.ndarray):
    """Log-likelihoods of each language, tempered."""
    wide = np.ascontiguousarray(table.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in text_blocks(batch, most=1 << 20):
                gram, row = _trigrams(buf, offs)
                n = np.bincount(row, minlength=j - i)
                sums = np.zeros((j - i, wide.shape[1]))
                some = np.flatnonzero(n)
                if len(some):
                    starts = np.concatenate([[0], np.cumsum(n[some])])[:-1]
                    for k in range(wide.shape[1]):
                        sums[some, k] = np.add.reduceat(wide[gram, k], starts)
                    sums[some] *= (np.minimum(n[some], TEXT_GRAMS) / n[some])[:, None]
                    sums[some] -= sums[some].max(axis=1, keepdims=True)
                lists = pa.ListArray.from_arrays(pa.array((np.arange(j - i + 1) * wide.shape[1]).astype(np.int32)), pa.array(sums.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), pa.array(n, pa.int64()), lists], names=["key", "grams", "text"])

    return run


def address(url: str) -> dict[str, str]:
    """SQL for ``host``, ``domain`` and ``suffix`` of a URL column; null where there are none."""
    host = f"nullif(lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"
    return {
        "host": host,
        "domain": f"nullif(regexp_extract({host}, '([^.]+[.][^.]+)$', 1), '')",
        "suffix": f"nullif(regexp_extract({host}, '[.]([^.]+)$', 1), '')",
    }


def _row_key(kind: str, *columns: str) -> Column:
    """A hash of a row in which a null differs from every value, whatever column it is in."""
    return F.xxhash64(F.lit(kind), *[x for c in columns for x in (F.isnull(F.col(f"`{c}`")), F.col(f"`{c}`"))])


def _looked_up(rows: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Left join of ``rows`` with a materialized ``table`` that has one row per ``name``, which may be hot or null."""
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), name, "left")
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "doc_id", "page_id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [name, "salt"], "left").drop("salt")


def evidence_of_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``key, doc_id, page_id, text, declared, host, domain, suffix`` of raw pages."""
    html = f"coalesce(`{html_col}`, '')"
    bare = F.expr(f"regexp_replace({html}, '(?is)<(script|style)\\\\b.*?</\\\\1\\\\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;', ' ')")
    lang = F.expr(f"nullif(lower(regexp_extract({html}, '(?is)<html\\\\b[^>]*?\\\\slang\\\\s*=\\\\s*[\"'']?([A-Za-z]+)', 1)), '')")
    parts = address(f"`{url_col}`")
    return pages.select(
        _row_key("page", id_col, url_col, html_col).alias("key"),
        F.lit(None).cast("long").alias("doc_id"),
        F.col(id_col).cast("long").alias("page_id"),
        bare.alias("text"),
        lang.alias("declared"),
        *[F.expr(sql).alias(name) for name, sql in parts.items()],
    )


def evidence_of_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The same of documents: their language column declares, their source is the host."""
    return documents.select(
        _row_key("document", id_col, text_col, lang_col, source_col).alias("key"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.lit(None).cast("long").alias("page_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.lower(F.col(lang_col)).alias("declared"),
        F.col(source_col).cast("string").alias("host"),
        F.lit(None).cast("string").alias("domain"),
        F.lit(None).cast("string").alias("suffix"),
    )


def identify(evidence: DataFrame, model: tuple[list[str], np.ndarray], accept: float = ACCEPT, mass: float = MASS) -> DataFrame:
    """``key, doc_id, page_id, language, confidence, text_language, declared, accepted``, one row per row.

    A row without trigrams that hold a letter has no text evidence: markup and
    address still give it a language, but it is not accepted.  With no labelled
    row to fit on, ``language`` is null and nothing is accepted.  Null ids,
    hosts and declarations are missing evidence; repeated rows get equal
    results.
    """
    languages, table = model
    if not languages:
        null = F.lit(None)
        return evidence.select("key", "doc_id", "page_id", null.cast("string").alias("language"), F.lit(0.0).alias("confidence"), null.cast("string").alias("text_language"), "declared", F.lit(False).alias("accepted"))
    size = len(languages)
    rows = materialize(_passed(evidence, table), "scores")
    soft = "transform(text, x -> exp(x))"
    posterior = f"transform({soft}, x -> x / aggregate({soft}, 0D, (s, y) -> s + y))"
    rows = rows.withColumn("p", F.expr(f"case when grams > 0 then {posterior} end"))
    counted = rows.where("p is not null")
    sums = [F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(size)]
    names = [f"c{i}" for i in range(size)]
    total = counted.agg(*sums).first()
    whole = np.array([float(total[n] or 0) for n in names]) + 1.0
    overall = (whole / whole.sum()).tolist()

    hosts = materialize(counted.groupBy("host", "domain", "suffix").agg(*sums), "hosts")

    def smoothed(counts: DataFrame, above) -> DataFrame:
        n = sum(F.col(c) for c in names)
        prior = F.array(*[(F.col(c) + mass * above[i]) / (n + mass) for i, c in enumerate(names)])
        return counts.withColumn("prior", prior)

    add = [F.sum(n).alias(n) for n in names]
    top = [F.lit(x) for x in overall]
    suffixes = smoothed(hosts.where("suffix is not null").groupBy("suffix").agg(*add), top).select("suffix", F.col("prior").alias("above"))
    fall = F.array(*top)
    domains = hosts.where("domain is not null").groupBy("domain", "suffix").agg(*add).join(suffixes, "suffix", "left")
    domains = smoothed(domains, [F.coalesce("above", fall)[i] for i in range(size)]).select("domain", F.col("prior").alias("above"))
    priors = hosts.where("host is not null").groupBy("host", "domain").agg(*add).join(domains, "domain", "left")
    priors = smoothed(priors, [F.coalesce("above", fall)[i] for i in range(size)]).select("host", "prior")
    priors = materialize(priors, "priors")

    declared = counted.where("declared is not null").groupBy("declared").agg(*sums)
    declared = materialize(declared, "declared")
    of_language = [float(x or 0) for x in declared.agg(*add).first()] if not declared.isEmpty() else [0.0] * size
    kinds = max(1, declared.count())
    given = F.array(*[(F.col(c) + mass / kinds) / (of_language[i] + mass) for i, c in enumerate(names)])
    declared = declared.select("declared", given.alias("given"))

    joined = _looked_up(_looked_up(rows, priors, "host"), declared, "declared")
    ones = F.array(*[F.lit(1.0)] * size)
    joined = joined.withColumn("prior", F.coalesce("prior", fall)).withColumn("given", F.coalesce("given", ones))
    joined = joined.withColumn("w", F.expr("transform(sequence(0, size(text) - 1), i -> exp(text[i]) * prior[i] * given[i])"))
    joined = joined.withColumn("best", F.expr("array_max(w)")).withColumn("all", F.expr("aggregate(w, 0D, (s, x) -> s + x)"))
    name = F.array(*[F.lit(x) for x in languages])
    confidence = F.col("best") / F.col("all")
    at = lambda values, top_of: F.element_at(name, F.array_position(values, top_of).cast("int"))
    return joined.select(
        "key",
        "doc_id",
        "page_id",
        at(F.col("w"), F.col("best")).alias("language"),
        confidence.alias("confidence"),
        F.when(F.col("grams") > 0, at(F.col("text"), F.array_max("text"))).alias("text_language"),
        "declared",
        ((F.col("grams") >= LEAST_GRAMS) & (confidence >= accept)).alias("accepted"),
    )


def _passed(evidence: DataFrame, table: np.ndarray) -> DataFrame:
    """Scores beside the evidence that is not text, in one pass."""
    score = _scores(table)
    others = ["doc_id", "page_id", "declared", "host", "domain", "suffix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(others)
            at = 0
            for scored in score(iter([batch])):
                n = scored.num_rows
                yield pa.RecordBatch.from_arrays([*scored.columns, *own.slice(at, n).columns], names=[*scored.schema.names, *others])
                at += n

    return evidence.mapInArrow(run, SCORES + ", doc_id long, page_id long, declared string, host string, domain string, suffix string")


def fit_documents(documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE):
    return fit(documents.select(F.col(text_col).alias("text"), F.lower(F.col(lang_col)).alias("label")), sample)


def accepted_documents(documents: DataFrame, **columns) -> DataFrame:
    """The rows of ``documents`` whose language is accepted, unchanged."""
    evidence = evidence_of_documents(documents, **columns)
    with passing(documents.sparkSession):
        model = fit_documents(documents, **{k: v for k, v in columns.items() if k in ("text_col", "lang_col")})
        bad = identify(evidence, model).where("not accepted").select(id_key().alias("doc"), "key").distinct()
        bad = small_or_not(materialize(bad, "rejected", lasting=True))
    own = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    names = {"id_col": "doc_id", "text_col": "text", "lang_col": "lang", "source_col": "source"} | columns
    key = _row_key("document", *[names[c] for c in ("id_col", "text_col", "lang_col", "source_col")])
    rows = documents.select(own, id_key(names["id_col"]).alias("doc"), key.alias("key"))
    return rows.join(bad, ["doc", "key"], "left_anti").select("row.*")
