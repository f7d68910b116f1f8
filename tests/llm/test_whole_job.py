"""Inputs that an operator once read, found or kept apart only in part."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import near_brute, rows_of, suffixes_brute, windows_brute

from reportlake.llm import decontaminate, embedding_index, graph, kernels, language_id, license_scan, minhash, mixing, secret_scan, shared, substring_dedup, suffix_family
from reportlake.operators import search


def prose(draw, n, vocabulary=400):
    return " ".join(f"word{draw.randrange(vocabulary)}" for _ in range(n))


def leaks(spark, texts, items):
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents, benchmark).collect()}


def test_leak_in_a_third_of_all_texts(spark):
    draw = random.Random(2)
    item = " ".join(f"leak{k}" for k in range(30))
    texts = [prose(draw, 40) + (" " + item + " " if k % 3 == 0 else " ") + prose(draw, 40) for k in range(150)]
    texts += [texts[0]] * 75
    want = {(k, 0) for k, t in enumerate(texts) if item in t}
    assert leaks(spark, texts, [item, prose(draw, 30, 10**6)]) == want


def test_leak_of_a_long_item(spark):
    draw = random.Random(4)
    items = [prose(draw, n, 10**6) for n in (97, 400, 1000, 3000)]
    texts = [prose(draw, 100) for _ in range(40)] + [f"{prose(draw, 37)} {item} {prose(draw, 50)}" for item in items] + items
    assert leaks(spark, texts, items) == {(40 + k, k % 4) for k in range(8)}


@pytest.fixture(scope="module")
def without_id(spark):
    """Different texts under no id and under one id; every second one holds a passage that others hold too."""
    draw = random.Random(6)
    passage = prose(draw, 60)
    rows = []
    for k in range(1600):
        own = f"own{k} " + prose(draw, 1 + k % 7, 10**6)
        rows.append((7 if k < 800 else None, own + " " + passage if k % 2 else own))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_many_texts_without_id_and_repeated_windows(without_id):
    assert rows_of(substring_dedup.remove_repeats(without_id)) == windows_brute(without_id.collect())


def test_many_texts_without_id_and_earlier_suffixes(without_id):
    assert rows_of(suffix_family.remove_earlier(without_id)) == suffixes_brute(without_id.collect())


def test_rows_without_id_stay_beside_those_that_go(spark):
    texts = [f"text {k}" for k in range(6000)]
    rows = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    bad = shared.documents_of(rows.where(F.substring("text", 6, 9).cast("int") < 200)).select("doc", "tag")
    assert sorted(r.text for r in shared.without(rows, bad).collect()) == sorted(texts[200:])


def test_license_reports_by_row(spark):
    mit = "Released under the MIT License."
    texts = [mit, mit + " one", "two " + mit, mit]
    for key in (None, 3):
        rows = spark.createDataFrame([(key, t) for t in texts], "doc_id long, text string").coalesce(1)
        got = sorted((r.doc_id or 0, r.start, r.end) for r in license_scan.scan(rows).collect())
        assert got == [(key or 0, 0, 30)] * 3 + [(key or 0, 4, 34)]


def test_lesser_license_match_beside_many():
    best = [(0, "MIT", 1.0, 5, 100 * k, 100 * k + 30) for k in range(200)]
    lesser = [(0, "MIT", 0.8, 4, 100 * k + 10, 100 * k + 40) for k in range(200)]
    assert license_scan._best(lesser + best) == best


def test_more_than_64_languages(spark):
    draw = random.Random(8)
    rows = []
    for k in range(70):
        words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)]
        rows += [(len(rows), " ".join(draw.choice(words) for _ in range(60)), f"l{k:02}") for _ in range(2 if k < 60 else 1)]
    frame = spark.createDataFrame([(i, t, lang, "x") for i, t, lang in rows], "doc_id long, text string, lang string, source string")
    model = language_id.fit(frame.select("text", F.col("lang").alias("label")))
    assert model[0] == [f"l{k:02}" for k in range(70)]
    named = language_id.identify(language_id.evidence_of_documents(frame.withColumn("lang", F.lit(None).cast("string"))), model)
    assert {(r.doc_id, r.text_language) for r in named.collect()} == {(i, lang) for i, _, lang in rows}


def test_queries_beyond_a_block(spark, monkeypatch):
    chunks = spark.createDataFrame([("r", str(i), i, "H", f"alpha{i % 3} beta{i % 5}") for i in range(20)], "report_ref string, chunk_id string, page int, heading string, text string")
    queries = spark.createDataFrame([(i, f"alpha{i % 3} beta{i % 5}") for i in range(30)], "query_id long, query string")
    scored = lambda: sorted((r.query_id, r.page, r.score) for r in search.score(chunks, queries).collect())
    whole = scored()
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    assert len(whole) == 600 and scored() == whole


def test_near_copy_of_a_row_without_id(spark):
    """The first of equal texts has no id: its class keeps its bands."""
    draw = random.Random(3)
    text = prose(draw, 120, 10**6)
    near = text.rsplit(" ", 2)[0] + " other end"
    rows = spark.createDataFrame([(None, text), (5, text), (9, near)], "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.mark(rows).collect()} == {(None, None, True), (5, 5, True), (9, 5, False)}


def test_texts_around_a_common_passage(spark):
    """Hundreds of texts just below the limit, some pairs above it: no link is lost, few pairs are formed."""
    draw = random.Random(12)
    common = prose(draw, 140, 10**6)
    texts = [common + " " + prose(draw, 22 + k % 9, 10**6) for k in range(300)]
    texts += [t.rsplit(" ", 3)[0] + " and more" for t in texts[::25]]
    base = prose(draw, 150, 10**6).split()
    for k in range(200):  # copies of one text, edited here and there, many too much
        words = list(base)
        for _ in range(1 + k % 14):
            words[draw.randrange(150)] = f"edit{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(minhash.mark(frame)) == near_brute(rows)


def test_components_carried_on(spark, monkeypatch):
    """Components equal union-find; links inside a component are not joined again, neither in later rounds nor by later calls."""
    draw = random.Random(4)
    ladder = [x for k in range(40) for x in ((2000 + k, 3000 + k), (2001 + k, 3000 + k))]  # a path, small and large by turns
    star = [(k, 1500) for k in range(1000, 1400)]  # its centre is the largest
    path = [(4000 + k, 4001 + k) for k in range(60)]
    first = star + ladder + path + [(draw.randrange(900), draw.randrange(900)) for _ in range(500)] + [(7, 7), (9, 8), (8, 9)]
    later = [(1399, 3005), (4060, 5), (6000, 6001), (1000, 1001), (6002, 4030)]

    def want(links):
        name = {x: x for a, b in links if a != b for x in (a, b)}

        def find(x):
            while name[x] != x:
                x = name[x]
            return x

        for a, b in links:
            if a != b:
                x, y = sorted((find(a), find(b)))
                name[y] = x
        return {x: find(x) for x in name}

    written, write = [], graph.materialize

    def noted(df, name, *options):
        out = write(df, name, *options)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(graph, "materialize", noted)
    table = lambda links: spark.createDataFrame(links, "a long, b long")
    labels = graph.components(table(first))
    assert {r.node: r.component for r in labels.collect()} == want(first)
    assert sum(n for name, n in written if name == "links") < 1.7 * len(first)
    written.clear()
    labels = graph.components(table(later), labels)
    rows = labels.collect()
    assert {r.node: r.component for r in rows} == want(first + later) and len(rows) == len(want(first + later))
    assert sum(n for name, n in written if name in ("links", "up")) < 20


def test_copies_edited_too_much_do_not_meet(spark, monkeypatch):
    """Around a large group, copies that no text of their size can be linked with are not compared with its members."""
    draw = random.Random(31)
    base = prose(draw, 144, 10**6).split()
    rows = []
    for k in range(240):  # two thirds with one edit, linked; a third with six, 30 of 140 shingles, linked with nothing
        words = list(base)
        for at in draw.sample(range(4, 139), 1) if k % 3 else [5 + 25 * i + draw.randrange(8) for i in range(6)]:
            words[at] = f"edit{draw.randrange(10**9)}"
        rows.append((k, " ".join(words)))
    rows += [(240, " ".join(base[:112])), (241, " ".join(base[:111] + ["end"])), (242, " ".join(base[:100]))]  # of other sizes, the first two linked with the base's copies or each other
    met, write = [], minhash.materialize

    def noted(df, name, *options, **named):
        out = write(df, name, *options, **named)
        if name == "shared":
            sides = ["token", *({"size", "other"} & set(out.columns))]
            held = out.groupBy(*sides).agg(F.count("*").alias("f"), F.sum((F.col("component") != F.col("most")).cast("long")).alias("m"))
            met.append(held.agg(F.sum(F.col("f") * F.col("m"))).first()[0] or 0)
        return out

    monkeypatch.setattr(minhash, "materialize", noted)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    brute = near_brute(rows)
    assert rows_of(minhash.mark(frame)) == brute
    assert sum(met) < 40 * len(rows)
    assert sorted(r.doc_id for r in minhash.deduplicated(frame).collect()) == sorted(d for d, _, _, kept in brute if kept)


@pytest.mark.parametrize("edit", ["replace", "drop", "insert"])
def test_paraphrased_items(spark, sf, edit):
    """Items with 30 % of their words edited, in texts of other words: recall 0.9, nothing else reported."""
    draw = random.Random(21)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()][:100]
    own = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    words = [w for t in own for w in (t or "").split()[:60]]
    some = lambda: [draw.choice(words) for _ in range(draw.randrange(200))]
    changed = {"replace": lambda w: [draw.choice(words)], "drop": lambda w: [], "insert": lambda w: [w, draw.choice(words)]}[edit]
    texts = [" ".join(some() + [x for w in item.split() for x in (changed(w) if draw.random() < 0.3 else [w])] + some()) for item in items]
    found = leaks(spark, texts + own, items)
    assert {(d, k) for d, k in found if d < len(texts)} <= {(k, k) for k in range(len(items))}
    assert sum((k, k) in found for k in range(len(items))) >= 0.9 * len(items)


def test_inclusion_frequencies(spark):
    """Documents are drawn as often as their expected copies say, which differ by length; words are met."""
    draw = random.Random(17)
    rows = [(k, draw.choice("ab"), int(2 ** draw.uniform(3, 9))) for k in range(6000)]
    frame = spark.createDataFrame(rows, "doc long, source string, size long").repartition(4)
    total, seeds = defaultdict(float), 2
    for seed in range(seeds):
        mix = mixing.fit(frame, seed)
        rates = {r.source: (r.rates, r.target) for r in mix.sources.collect()}
        taken = defaultdict(int)
        for r in mix.copies(frame).collect():
            total[r.source, r.size.bit_length() - 1] += r.copies
            taken[r.source] += r.copies * r.size
        assert all(abs(taken[s] - target) < 0.002 * target for s, (_, target) in rates.items())
    for (source, k), n in total.items():
        docs = seeds * sum(1 for _, s, size in rows if s == source and size.bit_length() - 1 == k)
        rate = rates[source][0][k]
        p = rate % 1
        assert abs(n - docs * rate) <= 5 * (docs * max(p * (1 - p), 0.01)) ** 0.5 + 0.01 * docs, (source, k, n / docs, rate)
    assert len({round(x, 6) for x in rates["b"][0]}) > 3


def test_expected_copies_stop_at_the_most(spark):
    cells = spark.createDataFrame([("a", 2, 100), ("a", 5, 1000), ("b", 3, 50), ("c", 0, 0)], "source string, class int, words long")
    targeted = spark.createDataFrame([("a", 1100, 3250.0), ("b", 50, 150.0), ("c", 0, 0.0)], "source string, source_size long, target double")
    got = {r.source: r for r in mixing.expected_copies(targeted, cells).collect()}
    assert got["a"].rates[5] == 3.0 and abs(got["a"].rates[2] - 2.5) < 1e-9 and abs(got["a"].want - 50) < 1e-6
    assert got["b"].rates[3] == 3.0 and got["c"].rates is None


def test_keys_among_words(spark):
    """Keys of 36 characters and more among words run together, paths, numbers and rules: recall and the share of false ones."""
    draw = random.Random(23)
    english = "the of and to in is that it was for on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who oil its now find long down day did get come made may part".split()
    kinds = {name: chars for name, chars in secret_scan.ENCODINGS if len(chars) >= 36}
    texts, keys = [], set()
    for k in range(3000):
        kind, parts = k % 10, [draw.choice(english) for _ in range(draw.randrange(6, 14))]
        if kind == 0:
            name = sorted(kinds)[k // 10 % len(kinds)]
            value = "".join(draw.choice(kinds[name]) for _ in range(draw.randrange(56, 73)))
            keys.add(k)
        elif kind < 4:
            value = "".join(parts) if kind < 3 else "".join(p.title() for p in parts)
        elif kind < 8:
            value = "/_-/"[kind - 4].join(parts)
        else:
            value = "-=_/"[k % 4 if k % 4 != 1 else 0] * 40 if kind == 8 else "-".join(str(draw.randrange(1990, 2030)) for _ in range(8))
        texts.append(f"see {value} there")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id for r in secret_scan.digest(secret_scan.scan(frame)).collect() if "random" in r.spans}
    assert len(found & keys) >= 0.9 * len(keys) and len(found - keys) <= 0.02 * len(found), (len(found & keys), len(keys), sorted(texts[i] for i in found - keys)[:20], [texts[i] for i in sorted(keys - found)][:20])


def test_vectors_of_any_label_and_width(spark):
    """Labels as text, vectors of single and double floats and of two widths, clashing column names, ties."""
    draw = random.Random(31)
    base = [[draw.gauss(0, 1) for _ in range(12)] for _ in range(40)]
    rows = [(i, v, "ab"[i % 2], 1, "x") for i, v in enumerate(base)]
    rows += [(100 + i, [x * 3 for x in base[i]], "ab"[i % 2], 1, "x") for i in range(20)]  # the same direction
    rows += [(200 + i, base[i][:7], "ab"[i % 2], 1, "x") for i in range(10)] + [(300, base[0], "ab"[0], 1, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, rep int, component string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_index.near_vectors(frame).collect()}
    assert got[0] == (2, 0, True) and got[100] == (2, 0, False) and got[300] == (2, 0, False)
    assert all(got[i] == (1, i, True) and got[100 + i] == (1, i, False) for i in range(1, 20))
    assert all(got[i] == (0, i, True) for i in [*range(20, 40), *range(200, 210)])


def fused_brute(rows, model, mass=language_id.MASS):
    """Language and confidence of each row of evidence, by key."""
    languages, table = model
    ones = np.ones(len(languages))
    texts = []
    for r in rows:
        low = [b + 32 if 65 <= b <= 90 else b for b in r.text.encode()]
        low = [b if 97 <= b <= 122 or b >= 128 else 32 for b in low]
        code = [low[i] << 16 | low[i + 1] << 8 | low[i + 2] for i in range(len(low) - 2) if any(b != 32 for b in low[i : i + 3])]
        gram = (kernels.mix(np.array(code, dtype=np.uint64)) >> np.uint64(50)).astype(int) if code else []
        score = sum((table[:, g] for g in gram), 0 * ones) * (min(len(code), language_id.TEXT_GRAMS) / max(len(code), 1))
        score = np.exp(score - score.max())
        texts.append((score, score / score.sum() if code else 0 * ones))
    total = sum(p for _, p in texts) + 1
    overall = total / total.sum()

    def counted(name):
        out = defaultdict(lambda: 0 * ones)
        for r, (score, p) in zip(rows, texts, strict=True):
            if r[name] is not None and p.any():
                out[r[name]] = out[r[name]] + p
        return out

    above = {"suffix": defaultdict(lambda: overall)}
    for name, upper in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        parent = {r[name]: r[upper] for r in rows} if upper else {}
        of = above[name] = defaultdict(lambda: overall)
        for value, n in counted(name).items():
            top = above[upper][parent[value]] if upper else overall
            of[value] = (n + mass * top) / (n.sum() + mass)
    said = counted("declared")
    whole = sum(said.values(), 0 * ones)
    out = {}
    for r, (score, _) in zip(rows, texts, strict=True):
        w = score * above["host"][r.host]
        if r.declared in said:
            w = w * (said[r.declared] + mass / len(said)) / (whole + mass)
        out[r.key] = (languages[int(w.argmax())], w.max() / w.sum())
    return out


@pytest.mark.parametrize("limit", [50_000, 0])
def test_evidence_is_fused_as_by_hand(spark, sf, monkeypatch, limit):
    """The whole chain of priors; without room for a broadcast, by salted joins."""
    monkeypatch.setattr(language_id, "BROADCAST_ROWS", limit)
    documents = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = [(900, None, None, "x"), (901, None, "x", None), (902, "12 34", "fr", None), (903, "le chat et la table", None, None), (903, "le chat et la table", None, None)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string")
    evidence = language_id.evidence_of_documents(documents.select(*odd.columns).unionByName(odd))
    evidence = evidence.unionByName(language_id.evidence_of_pages(spark.read.parquet(f"{sf}/pages.parquet").limit(60)))
    model = language_id.fit_documents(documents)
    rows = evidence.collect()
    want = fused_brute(rows, model)
    got = language_id.identify(spark.createDataFrame(rows, evidence.schema), model).collect()
    assert len(got) == len(rows) and len(want) == len(rows) - 1  # one row is there twice
    for r in got:
        language, confidence = want[r.key]
        assert abs(r.confidence - confidence) < 1e-9 and (r.language == language or abs(confidence - 0.5) < 1e-9), r


def test_nulls_in_different_columns_are_different_rows(spark):
    """A rejected row without language stays apart from one of the same id and text without source."""
    rows = spark.createDataFrame([(None, "x"), ("x", None)], "lang string, source string").selectExpr("1L as doc_id", "'12' as text", "lang", "source")
    assert language_id.evidence_of_documents(rows).select("key").distinct().count() == 2


def aligned_brute(text, template):
    """Matched words of the best local alignment, without a band."""
    best = (0, 0)
    before = [(0, 0)] * (len(text) + 1)
    for word in template:
        now = [(0, 0)]
        for j, other in enumerate(text, 1):
            score, matched = before[j - 1]
            ways = [(0, 0), (score + 2, matched + 1) if word == other else (score - 1, matched), (before[j][0] - 1, before[j][1]), (now[-1][0] - 1, now[-1][1])]
            now.append(max(w if w[0] > 0 else (0, 0) for w in ways))
        before, best = now, max(best, *now)
    return best[1]


def test_licenses_against_alignment_of_everything(spark):
    """Every text against every template; edited notices, whole short ones; one answer for any partitioning."""
    draw, split = random.Random(41), lambda t: re.findall(r"[a-z0-9]+", t.lower())
    texts = [prose(draw, 60) for _ in range(6)] + [None, "", "license"]
    for name, template in license_scan.TEMPLATES.items():
        words = template.split()
        for k in range(3):
            own = list(words)
            if len(own) > 30:
                for _ in range(2 * k):
                    at = draw.randrange(14, len(own))
                    own[at : at + 1] = [[], ["edited"], [own[at], "added"]][draw.randrange(3)]
            texts.append(" ".join([prose(draw, draw.randrange(20)), *own, prose(draw, draw.randrange(20))]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    answers = [rows_of(license_scan.scan(frame.repartition(n))) for n in (1, 4, 16)]
    assert answers[0] == answers[1] == answers[2]
    want = {}
    for d, t in enumerate(texts):
        for name, template in license_scan.TEMPLATES.items():
            matched = aligned_brute(split(t or ""), split(template))
            if matched >= license_scan.COVERAGE * len(split(template)):
                want[d, name] = matched
    got = defaultdict(int)
    for d, name, _, matched, start, end in answers[0]:
        got[d, name] = max(got[d, name], matched)
        assert matched <= len(split(texts[d][start:end]))
    assert dict(got) == want


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty, long and repeated texts, rows without id: each stage keeps what it should."""
    import corpus_pipeline

    draw = random.Random(43)
    item, base = prose(draw, 30, 10**6), prose(draw, 90)
    rows = [(i, prose(draw, 60), draw.choice(["en", None]), draw.choice(["a", "b", None])) for i in range(40)]
    rows += [(100, base, "en", "a"), (101, base, "en", "b"), (None, base, None, None), (None, prose(draw, 50), None, None), (102, None, "en", "a"), (103, "", None, None)]
    rows += [(104, "12 34", "en", "a"), (105, prose(draw, 40) + " " + item, "en", "a"), (106, prose(draw, 20_000), "en", None), rows[0], rows[0]]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tag", F.lit(1)).withColumn("row", F.lit("x"))
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, str(tmp_path)), "stage")
        assert sorted(docs.columns) == sorted(documents.columns)
        left.append(sorted((r.doc_id for r in docs.collect()), key=repr))
    assert not {102, 103, 104} & set(left[0]) and len(left[0]) == len(rows) - 3
    assert set(left[1]) == set(left[0]) - {101} and left[1].count(None) == 2
    assert set(left[2]) == set(left[1]) - {105}
    assert set(left[3]) <= set(left[2])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.slot for r in out) == list(range(len(out))) and {r.doc_id for r in out} <= set(left[2])
