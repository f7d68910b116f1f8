"""Rules that the queries do not reach, against independent statements of them."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from reportlake.functions import text as T
from reportlake.operators import access, catalog, chunking, compaction, contracts, dispatch, ocr, ordering, report_session, search, tasks
from reportlake.sources import config, reports


def pieces(text, most=6000):
    rest, out = text.strip(), []
    while rest:
        if len(rest) <= most:
            return [*out, rest]
        cut = rest.rfind("\n\n", 0, most + 1)
        cut = most if cut < most // 2 else cut
        out.append(rest[:cut].strip())
        rest = rest[cut:].strip()
    return out


def test_bounded_pieces(spark):
    draw = random.Random(1)
    texts = ["", "  ", "x" * 6000, "x" * 6001, "a" * 2999 + "\n\n" + "b" * 9000, "a" * 3000 + "\n\n" + "b" * 9000, "a" * 6000 + "\n\nb", " a "]
    texts += ["".join(draw.choice(["word ", "\n\n", "é" * 40, " " * 7]) for _ in range(draw.randrange(900))) for _ in range(30)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in rows.selectExpr("i", f"{T.bounded_pieces('t')} as p").collect()}
    assert [got[i] for i in range(len(texts))] == [pieces(t) for t in texts]


def test_markdown_report(spark):
    text = "# Cover\n\n<--- Page Split --->\n\n# Financial Statements\n" + "x" * 6500 + "\n\n<---page split--->\n\n# Consolidated Statements of Operations\nRevenue"
    report = spark.createDataFrame([("AAP_2017", text)], "report_ref string, text string")
    chunks = chunking.chunk_reports(report)
    assert chunks.count() == 4
    asked = spark.createDataFrame([(1, "Consolidated Statements of Operations")], "query_id long, query string")
    assert search.top_k(search.score(chunks, asked)).orderBy("rank").first().chunk_id == "AAP_2017:p3:c0"
    assert chunking.manifests(report).first().total_pages == 3


def test_full_scan_reaches_the_last_chunk(spark):
    rows = [(f"ACME_2025:p{i}:c0", i, "Annual Report", "ordinary disclosure") for i in range(2000)] + [("ACME_2025:p2000:c0", 2000, "Annual Report", "Consolidated revenue for 2025 was USD 123 million.")]
    chunks = spark.createDataFrame([("ACME_2025", *r) for r in rows], "report_ref string, chunk_id string, page int, heading string, text string")
    asked = spark.createDataFrame([(1, "consolidated revenue")], "query_id long, query string")
    scored = search.score(chunks, asked)
    assert search.stats(scored).first().scanned_chunks == 2001
    best = search.hits(search.top_k(scored, 8)).collect()
    assert best[0].chunk_id == "ACME_2025:p2000:c0" and len(best) <= 8 and len(best[0].snippet) <= 600


def test_score_matches_python(spark):
    texts = ["Revenue revenues été weiß STRASSE aaaa", "nothing", "annual  report annual report", ""]
    asked = ["revenue", "annual report", "aa", "été", "weiß", ""]
    rows = spark.createDataFrame([("r", str(i), i, "H", t) for i, t in enumerate(texts)], "report_ref string, chunk_id string, page int, heading string, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {(r.query_id, r.page): r.score for r in search.score(rows, queries).collect()}
    for q, query in enumerate(asked):
        for p, t in enumerate(texts):
            hay, phrase = f"h\n{t}".casefold(), " ".join(query.casefold().split())
            want = sum(hay.count(x) for x in re.findall("[a-z0-9]+", query.casefold())) + (10 * hay.count(phrase) if phrase else 0)
            assert got[q, p] == want


def test_artifacts_fail_as_a_whole(spark):
    good = json.dumps({"chunk_id": "a:p1:c0", "page": 1, "heading": "h", "text": "t", "extra": 1})
    files = [("a", "a.jsonl", good + "\n\n"), ("b", "b.jsonl", good + '\n{"chunk_id":'), ("c", "c.jsonl", '{"chunk_id": "x", "page": 1}'), ("d", "d.jsonl", json.dumps({"chunk_id": "d", "page": 1, "heading": "h", "text": "x" * 6001}))]
    rows = [(r, n, "application/x-ndjson", bytearray(t.encode())) for r, n, t in files] + [("e", "e.md", "text/markdown", bytearray(b"\xff\xfe"))]
    chunks, errors = reports.load_chunks(spark.createDataFrame(rows, "report_ref string, artifact_name string, mime_type string, content binary"))
    assert [r.report_ref for r in chunks.collect()] == ["a"]
    assert {r.report_ref: r.error for r in errors.collect()} == {"b": chunking.BAD_JSONL, "c": chunking.BAD_CHUNK, "d": chunking.LONG_CHUNK, "e": reports.NOT_UTF8}


def test_catalogue(spark):
    rows = catalog.METRICS
    assert len(rows) == 31 and len({r["kpi_key"] for r in rows}) == 31 and all(all(r.values()) for r in rows)
    asked = spark.createDataFrame([("revenue",), ("revenues",)], "kpi_key string")
    assert [r.kpi_key for r in catalog.unknown(asked).collect()] == ["revenues"]
    found = {r.kpi_key: r for r in catalog.lookup(asked).collect()}
    assert found["revenue"].error is None and len(found["revenues"].supported) == 31


def test_budget_refusals_do_not_accumulate(spark):
    calls = spark.createDataFrame([("t", i, n) for i, n in enumerate([400_000, 90_000, 70_000, 20_000, 10_000])], "task string, seq int, size long")
    got = access.budget_fold(calls, "task", "seq", "size").first()
    assert (got.output_chars, got.accepted, got.refused) == (480_000, 3, 2)


def test_contracts(spark):
    one = lambda sql: spark.sql(f"select {sql} as v").first().v
    assert one(contracts.kpi_result("'found'", "0D", "true", "0")) is None
    assert one(contracts.kpi_result("'ambiguous'", "cast(null as double)", "false", "0")) is None
    assert one(contracts.kpi_result("'explicit_zero'", "1D", "true", "0")) == contracts.NEEDS_ZERO
    assert one(contracts.qa_result("'answered'", "'q'", "' '", "1", "5", "0")) == contracts.NEEDS_ANSWER


def test_dispatch_keeps_failures_apart(spark):
    calls = []

    def bad(task):
        calls.append(1)
        return json.loads("{")

    got = dispatch.attempt(bad, {"task_id": "1"}, pause=0)
    assert len(calls) == 3 and got["error_code"] == "worker_invalid_json" and got["retryable"]
    assert dispatch.attempt(lambda t: None, {})["error_code"] == "worker_invalid_result"

    class Wrapped(Exception):
        def __init__(self, error):
            self.error = error

    assert dispatch.classify(Wrapped(Wrapped(ValueError()))) == "worker_invalid_result"
    assert dispatch.classify(TimeoutError()) == "worker_execution_failed"


class Script:
    """Replies in turn; an exception is raised."""

    def __init__(self, *replies):
        self.replies, self.sizes, self.budgets = list(replies), [], []

    def __call__(self, pages, budget):
        self.sizes.append(len(pages))
        self.budgets.append(budget)
        reply = self.replies.pop(0) if self.replies else "<PAGE>".join(f"p{p}" for p in pages)
        if isinstance(reply, Exception):
            raise reply
        return reply


@pytest.mark.parametrize(
    "replies, sizes",
    [
        ([ocr.Truncated("p0<PAGE>cut")], [4, 3]),
        (["only one"], [4, 2, 2]),
        ([ocr.TimedOut()], [4, 2, 2]),
        ([ocr.TransportFailed()], [4, 4]),
        ([ocr.TransportFailed(), ocr.TransportFailed()], [4, 4, 2, 2]),
    ],
)
def test_ocr_batches_around_failures(replies, sizes):
    request = Script(*replies)
    got = ocr.Reader(request, pause=0).read(range(4))
    assert request.sizes == sizes and got == ["p0", "p1", "p2", "p3"]


def test_ocr_single_page():
    request = Script(ocr.Truncated("x"))
    assert ocr.Reader(request, pause=0).read([7]) == ["p7"] and request.budgets == [8192, 24576]
    assert ocr.Reader(Script(ocr.TimedOut()), pause=0).read([7]) == ["p7"]
    with pytest.raises(ocr.OcrError):
        ocr.Reader(Script("  "), pause=0).read([7])


@pytest.mark.parametrize("change", [{"batch_pages": 9}, {"batch_pages": 31}, {"render_dpi": 71}, {"max_pages": 0}, {"max_parallel_pages": 0}, {"cache_version": " "}])
def test_ocr_config_ranges(change):
    with pytest.raises(ValueError):
        ocr.OcrConfig("http://a.b", "m", **change)


def test_service_urls(spark, monkeypatch):
    urls = ["http://host/", "https://a.example.com/x", "https://example.com", "ftp://host", "host", "https://myexample.com/"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r.v for r in rows.selectExpr(f"{config.valid_url('u')} as v").collect()]
    want = []
    for u in urls:
        try:
            config.service_url(u)
            want.append(True)
        except RuntimeError:
            want.append(False)
    assert got == want == [True, False, False, False, False, True]
    monkeypatch.delenv("REPORTLAKE_OCR_BASE_URL", raising=False)
    monkeypatch.delenv("REPORTLAKE_OCR_MODEL", raising=False)
    assert config.ocr_config() is None


def test_boundaries_match_python(spark):
    draw = random.Random(3)
    rows, want = [], []
    for s in range(20):
        open_ids = set()
        for p in range(1, 25):
            responses, calls = [f"c{draw.randrange(5)}" for _ in range(draw.randrange(3))], [f"c{draw.randrange(5)}" for _ in range(draw.randrange(2))]
            rows.append((s, p, "x", list(set(calls)), list(set(responses))))
            open_ids = (open_ids - set(responses)) | set(calls)
            if not open_ids:
                want.append((s, p))
    contents = spark.createDataFrame(rows, "scope int, pos int, json string, calls array<string>, responses array<string>")
    got = sorted(map(tuple, compaction.boundaries(contents).collect()))
    assert got == want


def test_new_ids_start_after_the_counter(spark):
    rows = spark.createDataFrame([(3,), (1,)], "o int")
    assert sorted(map(tuple, tasks.new_ids(rows, 4, "o").collect())) == [(1, 5), (3, 6)]


def test_save_and_versions(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", 1), ("a.md", 2), ("b.md", 1)], "artifact_name string, at int")
    reports.save(reports.next_versions(rows, "at"), str(tmp_path / "artifacts"))
    saved = spark.read.parquet(str(tmp_path / "artifacts"))
    assert saved.groupBy("artifact_name").agg(F.max("version").alias("v")).where("artifact_name = 'a.md'").first().v == 1


def test_folding_is_full(spark):
    words = ["Straße ẞ", "ﬁne ﬂow", "ΣΟΦΟΣ σοφος", "İstanbul ı I", "Kelvin K µ", "ſtop ŉ ǰ", "ŒUVRE Ñandú", "ΐ ᾳ", "", "plain"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", f"{T.fold('w')} as f").collect()
    assert all(r.f == r.w.casefold() for r in rows)


def test_numbered_rows(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, f"n{i}") for i in range(1000)], "k long, name string").repartition(5)
    got = ordering.numbered(rows, "k", start=11).collect()
    assert sorted(r.position for r in got) == list(range(11, 1011)) and all(r.position == r.k + 11 for r in got)
    assert ordering.numbered(rows.limit(0), "k").collect() == []


def test_missing_and_repeated_chunks(spark):
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "request_id long, chunk_ids array<string>")
    chunks = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("c", 3, "t")], "chunk_id string, line int, text string")
    assert sorted((r.request_id, r.position, r.text) for r in access.read_chunks(asked, chunks, "line").collect()) == [(1, 0, "new"), (2, 0, "t")]
    assert [tuple(r) for r in access.missing_chunks(asked, chunks).collect()] == [(1, 1, "b")]


def test_each_worker_runs_once(spark, tmp_path):
    """Outcomes that are joined to a retry are settled first."""
    def worker(task):
        with open(f"{tmp_path}/calls", "a") as f:
            f.write(task["task_id"] + "\n")
        raise ValueError

    asked = spark.createDataFrame([(str(i), i) for i in range(6)], "task_id string, ordinal long")
    first = ordering.settled(dispatch.dispatch(asked, worker, pause=0.0))
    again = dispatch.dispatch(dispatch.retry_set(first).select("task_id", "ordinal"), dispatch.null_worker, pause=0.0)
    assert {r.status for r in dispatch.final(first, again).collect()} == {"succeeded"}
    assert sorted(open(f"{tmp_path}/calls").read().split()) == [str(i) for i in range(6)]


def test_report_session(spark):
    rows = [(f"r:p{i}:c0", i, "H", f"revenue row {i}") for i in range(12)] + [("r:p50:c0", 50, "H", "other")]
    chunks = spark.createDataFrame(rows, "chunk_id string, page int, heading string, text string")
    session = report_session.ReportSession(chunks, "r")
    assert session.search("  ")["error"] == access.EMPTY_QUERY and session.search("revenue", limit=9)["error"] == access.BAD_LIMIT
    assert session.search("revenue", "made up")["error"] == access.BAD_CURSOR
    first = session.search("revenue", limit=3)
    assert (first["scanned_chunks"], first["total_matches"], len(first["items"])) == (13, 12, 3)
    assert session.search("row", first["next_cursor"], 3)["error"] == access.OTHER_CURSOR
    second = session.search("revenue", first["next_cursor"], 3)
    ids = [i["chunk_id"] for i in first["items"] + second["items"]]
    assert len(set(ids)) == 6
    assert session.read(["r:p50:c0"])["error"] == access.NOT_RETURNED
    assert [c["chunk_id"] for c in session.read([ids[4], ids[0]])["chunks"]] == [ids[4], ids[0]]
    assert session.read(ids[:4])["error"] == access.BAD_IDS and session.read([ids[0]] * 2)["error"] == access.BAD_IDS
    session.searches = access.MAX_SEARCH_CALLS
    assert session.search("revenue") == {"status": "error", "error": access.SEARCHES_SPENT, "budget_exhausted": True}
    session.output_chars = access.MAX_OUTPUT - 10
    assert session.read([ids[0]])["error"] == access.OUTPUT_SPENT and session.output_chars == access.MAX_OUTPUT - 10
    assert report_session.ReportSession(chunks, "r", allowed=False).read(["x"])["error"] == access.NO_READ_ACCESS


def test_update_results(spark):
    rows = [(1, 1, ["status", "owner"], "in_progress"), (1, 2, ["metadata"], None), (1, 3, ["subject", "status"], "deleted"), (1, 4, ["status"], "pending"), (2, 1, ["status"], "pending")]
    got = tasks.update_results(spark.createDataFrame(rows, "task long, seq long, fields array<string>, status string"), "task", "seq").orderBy("task", "seq").collect()
    assert [(r.success, r.updated_fields, r.from_status, r.to_status, r.error) for r in got] == [
        (True, ["status", "owner"], "pending", "in_progress", None),
        (True, ["metadata"], None, None, None),
        (True, ["status"], "in_progress", "deleted", None),
        (False, [], None, None, tasks.UNKNOWN_TASK),
        (True, ["status"], None, None, None),
    ]
