"""Secret scans: fixed patterns, and a battery of randomness tests for the rest.

Everything is DataFrame functions.  Patterns give the base spans.  A run of key
characters that no pattern explains is a candidate: its encoding is inferred
from the characters that occur, and three tests ask whether it could be a
uniform draw from that alphabet:

* chi-squared uniformity of its characters,
* a runs test on whether each index lies in the upper half of the alphabet,
* lag-one serial correlation of the indices.

Short strings pass such tests easily, whatever they are, so passing is no finding.
Each statistic is held against both explanations: a key, under which its law is
known, and text of the same length, whose characters concentrate (``LANGUAGE``)
and whose runs and neighbours stray from chance (``STRAY``).  The product of the
three likelihood ratios says how much better a key explains the candidate, which
grows with length.  The share of keys among all candidates of the table is
estimated from these ratios, and the candidates with the largest ones are reported
as long as the expected share of text among them stays within ``RATE``: a false
discovery rate in which a candidate counts by its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.shared import id_key, materialize, named_id

# Fixed values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "random")
#: Alphabets in the order in which they are tried: name and characters.
ENCODINGS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Sums of squares and cubes of the letter frequencies of text: English, of 26 letters, for larger alphabets;
#: as uneven for smaller ones.
LANGUAGE, LETTERS = (0.0655, 0.0056), 26
#: Standard deviation of the runs and serial statistics in text; 1 for a key.
STRAY = 3.0

#: Characters of a candidate at least.
LEAST_RANDOM = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST_RANDOM},}}"
#: False-discovery rate; cells of the histogram per unit of a log-likelihood ratio, and its ends.
RATE, CELLS, FAR = 0.01, 20, 60


def spans_column(text: str, pattern: str, kind: str, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start,end,kind,value>>``.

    The pieces between matches give their positions; a text without a match
    costs one search.
    """
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int,value:string>>)")
    t, p = F.col(text), F.lit(pattern)
    hits = F.regexp_extract_all(t, p, F.lit(0))
    values = hits if group is None else F.regexp_extract_all(t, p, F.lit(group))
    zipped = F.zip_with(
        F.zip_with(F.split(t, pattern, -1), hits, lambda a, b: F.struct(a.alias("piece"), b.alias("hit"))),
        values,
        lambda a, b: F.struct(F.length(a["piece"]).alias("gap"), F.length(a["hit"]).alias("n"), b.alias("value")),
    )
    # Starts by a fold over lengths alone; the last piece has no match and drops out.
    lengths = F.filter(zipped, lambda z: z["n"].isNotNull())
    ends = F.aggregate(
        lengths,
        F.expr("cast(array(0) as array<int>)"),
        lambda a, z: F.concat(a, F.array(F.element_at(a, -1) + z["gap"] + z["n"])),
    )
    spans = F.zip_with(
        lengths,
        F.slice(ends, 2, F.greatest(F.size(ends) - 1, F.lit(1))),
        lambda z, e: F.struct((e - z["n"]).alias("start"), e.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), z["value"].alias("value")),
    )
    return F.when(t.rlike(pattern), spans).otherwise(none)


def base_spans(text: str) -> Column:
    """All base spans of a text column, ordered by start, then kind."""
    parts = [
        F.filter(spans_column(text, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= LEAST["assign"]),
        F.filter(spans_column(text, r"AKIA[A-Z0-9]{12,}", "access"), lambda s: F.length(s["value"]) >= LEAST["access"]),
        F.filter(spans_column(text, r"[0-9a-f]{32,}", "hex"), lambda s: F.length(s["value"]) >= LEAST["hex"]),
    ]
    return F.concat(*parts)


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-F.least(a * a, F.lit(1400.0)) / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _two_sided(z: Column) -> Column:
    return 2 * _normal_tail(F.abs(z))


def _battery_sql(value: str) -> list[tuple[str, str]]:
    """Columns, step by step, that test the string column ``value``."""
    names = {**dict(ENCODINGS), "mixed": dict(ENCODINGS)["base62"] + "+/_-"}
    struct = {name: _alphabet(name, chars) for name, chars in names.items()}
    pick = " ".join(f"when not {value} rlike '[^{_class(chars)}]' then {struct[name]}" for name, chars in ENCODINGS)
    f2, f3 = (f"greatest({f}D, {f * LETTERS**k}D / pow(length(encoding.folded), {k}))" for k, f in enumerate(LANGUAGE, 1))
    return [
        ("encoding", f"case {pick} else {struct['mixed']} end"),
        ("a", "cast(length(encoding.chars) as double)"),
        ("n", f"cast(length({value}) as double)"),
        ("idx", f"transform(filter(split({value}, ''), c -> c <> ''), c -> cast(instr(encoding.chars, c) - 1 as double))"),
        # Sum of squared counts, a symbol at a time.
        ("squares", f"aggregate(filter(split(encoding.chars, ''), c -> c <> ''), 0D, (s, c) -> s + pow(n - length(replace({value}, c, '')), 2))"),
        ("chi2", "a / n * squares - n"),
        # Wilson and Hilferty: the cube root of chi2 over its degrees of freedom is near normal.
        ("z_uniform", "(pow(greatest(chi2, 0D) / (a - 1), 1D / 3) - (1 - 2 / (9 * (a - 1)))) / sqrt(2 / (9 * (a - 1)))"),
        ("ups", "transform(idx, i -> case when i >= a / 2 then 1D else 0D end)"),
        ("n1", "aggregate(ups, 0D, (s, x) -> s + x)"),
        ("runs", "1 + aggregate(zip_with(slice(ups, 1, size(ups) - 1), slice(ups, 2, size(ups)), (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)"),
        ("runs_mean", "1 + 2 * n1 * (n - n1) / n"),
        ("runs_var", "(runs_mean - 1) * (runs_mean - 2) / (n - 1)"),
        ("z_runs", "case when runs_var > 0 then (runs - runs_mean) / sqrt(runs_var) else 9D end"),
        ("mean", "aggregate(idx, 0D, (s, x) -> s + x) / n"),
        ("spread", "aggregate(idx, 0D, (s, x) -> s + (x - mean) * (x - mean))"),
        ("lagged", "aggregate(zip_with(slice(idx, 1, size(idx) - 1), slice(idx, 2, size(idx)), (x, y) -> (x - mean) * (y - mean)), 0D, (s, x) -> s + x)"),
        ("z_serial", "case when spread > 0 then (lagged / spread + 1 / n) * sqrt(n) else 9D end"),
        # The same with both cases as one, as text uses them: means and spreads in a key and in text of this length.
        ("folded", f"case when encoding.folded = encoding.chars then {value} else lower({value}) end"),
        ("together", "aggregate(filter(split(encoding.folded, ''), c -> c <> ''), 0D, (s, c) -> s + pow(n - length(replace(folded, c, '')), 2))"),
        ("key_mean", "n + n * (n - 1) * encoding.k2"),
        ("key_sd", _spread("encoding.k2", "encoding.k3")),
        ("f2", f2),
        ("f3", f3),
        ("text_mean", "n + n * (n - 1) * f2"),
        ("text_sd", f"greatest({_spread('f2', 'f3')}, key_sd)"),
        ("for_key", "ln(text_sd / key_sd) + (pow((together - text_mean) / text_sd, 2) - pow((together - key_mean) / key_sd, 2)) / 2"),
        ("straying", f"2 * ln({STRAY}D) - (z_runs * z_runs + z_serial * z_serial) / 2 * (1 - 1 / ({STRAY}D * {STRAY}D))"),
    ]


def _spread(p2: str, p3: str) -> str:
    """SQL: the standard deviation of the sum of squared counts of ``n`` draws; sums of squares and cubes of the chances."""
    return f"sqrt(greatest(4 * n * (n - 1) * (n - 2) * ({p3} - {p2} * {p2}) + 2 * n * (n - 1) * ({p2} - {p2} * {p2}), 1D))"


def _alphabet(name: str, chars: str) -> str:
    """SQL: an encoding with its characters, those left if it has both cases and they are one, and what a key draws of these."""
    both = chars.lower() != chars and chars.upper() != chars
    folded = "".join(dict.fromkeys(chars.lower())) if both else chars
    chances = [(chars.lower() if both else chars).count(c) / len(chars) for c in folded]
    k2, k3 = (sum(p**k for p in chances) for k in (2, 3))
    return f"named_struct('name', '{name}', 'chars', '{chars}', 'folded', '{folded}', 'k2', {k2:.12f}D, 'k3', {k3:.12f}D)"


def _class(chars: str) -> str:
    return "".join("\\\\" + c if c in "+/-_" else c for c in chars)


def tested(candidates: DataFrame, value: str = "value") -> DataFrame:
    """``candidates`` with ``encoding``, the p-values of the three tests, and ``log_ratio``: key against text."""
    keep = candidates.columns
    out = candidates
    for name, sql in _battery_sql(value):
        out = out.withColumn(name, F.expr(sql))
    return out.select(
        *keep,
        F.col("encoding.name").alias("encoding"),
        _two_sided(F.col("z_uniform")).alias("p_uniform"),
        _two_sided(F.col("z_runs")).alias("p_runs"),
        _two_sided(F.col("z_serial")).alias("p_serial"),
        (F.col("for_key") + F.col("straying")).alias("log_ratio"),
    )


def discovery_level(tests: DataFrame, rate: float = RATE) -> float:
    """The least ``log_ratio`` of a discovery: above it the expected share of text stays within ``rate``.

    Ratios are counted in cells, rounded against discovery, so the driver sees
    ``2 * FAR * CELLS`` rows at most.  The share of keys is the one that makes the
    counts most likely, found by expectation and maximisation.
    """
    cell = F.floor(F.least(F.greatest("log_ratio", F.lit(-float(FAR))), F.lit(float(FAR))) * CELLS)
    counts = sorted(((r.cell / CELLS, r.n) for r in tests.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, share = sum(n for _, n in counts), 0.5
    if not total:
        return math.inf
    text = lambda x, share: 1 / (1 + share / (1 - share) * math.exp(x))
    for _ in range(200):
        share = min(max(sum(n * (1 - text(x, share)) for x, n in counts) / total, 1e-12), 1 - 1e-9)
    level, upto, false = math.inf, 0, 0.0
    for x, n in counts:
        upto, false = upto + n, false + n * text(x, share)
        if false <= rate * upto:
            level = x
    return level


def scan(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``doc_id, found`` with all spans of each row as ``array<struct<start,end,kind,value>>``.

    Positions are code points, ends exclusive.  Base spans always stay; spans of
    kind ``random`` are added where no base span overlaps.

    Short keys of few different characters cannot be told from text at this rate:
    where a tenth of all candidates are keys, 60 random characters are found from
    alphabets of 36 on, 40 from those of 62.

    Null and empty texts have no spans; a null id stays null; repeated rows give
    repeated results; an empty table gives an empty one; extra columns are
    ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(id_key(id_col).alias("doc"), text.alias("text"))
    rows = rows.select("doc", base_spans("text").alias("base"), spans_column("text", CANDIDATE, "random").alias("candidates"))
    free = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rows = materialize(rows.select("doc", "base", free.alias("candidates"), F.monotonically_increasing_id().alias("row")), "spans")
    tests = tested(rows.select("row", F.explode("candidates").alias("c")).select("row", "c", F.col("c.value").alias("value")))
    tests = materialize(tests.select("row", "c", "encoding", "log_ratio"), "tests")
    keys = tests.where(F.col("log_ratio") >= discovery_level(tests, rate))
    added = keys.groupBy("row").agg(F.collect_list("c").alias("added"))
    out = rows.join(added, "row", "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int,value:string>>)")
    by_start = F.array_sort(F.concat("base", F.coalesce("added", none)))
    return out.select(named_id().alias("doc_id"), F.array_sort("base").alias("base"), by_start.alias("found"))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    # Structs sort by start, end, kind; the order asked for is start, then kind.
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(
        F.transform(keyed, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digest(scanned: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of ``scan``."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("found").alias("spans"),
    )
