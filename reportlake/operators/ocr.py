"""OCR as a hook: cache keys, batch plans, and what to do when a batch goes wrong.

Rendering and requests stay outside; a ``request`` callable takes the pages of a
batch and a token budget and returns text, or raises one of the errors below.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.functions import text as T

SEPARATOR, JOINER = "<PAGE>", "\n\n<--- Page Split --->\n\n"
BATCH_TOKENS, PAGE_TOKENS, RETRY_PAUSE = 24_576, 8_192, 0.25


class OcrError(RuntimeError):
    pass


class Truncated(OcrError):
    def __init__(self, partial: str):
        super().__init__("output was truncated")
        self.partial = partial


class TimedOut(OcrError):
    pass


class TransportFailed(OcrError):
    pass


class _Mismatch(OcrError):
    """As many sections as pages were asked for, and something else came."""


@dataclass(frozen=True)
class OcrConfig:
    base_url: str
    model: str
    api_key: str = ""
    timeout_seconds: float = 180.0
    max_pages: int = 500
    batch_pages: int = 20
    max_parallel_pages: int = 8
    render_dpi: int = 144
    cache_version: str = "v1"
    single_page_prompt: str = ""
    multi_page_prompt: str = ""

    def __post_init__(self) -> None:
        for ok, why in (
            (self.max_parallel_pages >= 1, "max_parallel_pages must be at least 1"),
            (self.max_pages >= 1, "max_pages must be at least 1"),
            (10 <= self.batch_pages <= 30, "batch_pages must be between 10 and 30"),
            (self.render_dpi >= 72, "render_dpi must be at least 72"),
            (bool(self.cache_version.strip()), "cache_version must not be empty"),
        ):
            if not ok:
                raise ValueError(why)

    def fingerprint(self) -> str:
        """Of every setting that can change what a page reads as."""
        names = ("base_url", "batch_pages", "cache_version", "max_pages", "model", "multi_page_prompt", "render_dpi", "single_page_prompt")
        settings = {n: getattr(self, n) for n in names} | {"page_separator": SEPARATOR}
        return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def settings_digest(self) -> str:
        return hashlib.sha256(self.fingerprint().encode()).hexdigest()[:16]


def sections(text: str) -> list[str]:
    return [s.strip() for s in text.split(SEPARATOR) if s.strip()]


Request = Callable[[Sequence, int], str]


class Reader:
    """Reads the pages of a document, batch by batch, around failures.

    * A batch whose sections do not match its pages, or that times out, is halved.
    * A transport error is tried once more, then the batch is halved, once on the way down.
    * Of a truncated batch the complete sections are kept and the rest is read again.
    * A page alone is tried once more after a timeout or transport error, and with the larger budget after truncation.
    """

    def __init__(self, request: Request, batch_pages: int = 20, pause: float = RETRY_PAUSE):
        self.request, self.batch_pages, self.pause = request, batch_pages, pause

    def read(self, pages: Sequence) -> list[str]:
        out: list[str] = []
        for start in range(0, len(pages), self.batch_pages):
            out += self._batch(pages[start : start + self.batch_pages], 1)
        return out

    def _batch(self, pages: Sequence, halvings: int) -> list[str]:
        if len(pages) == 1:
            return [self._page(pages[0])]
        try:
            found = sections(self._again(pages, BATCH_TOKENS, (TransportFailed,)))
            if len(found) == len(pages):
                return found
        except Truncated as e:
            partial = sections(e.partial)
            whole = min(max(len(partial) - 1, 0), len(pages) - 1)
            if whole:
                return partial[:whole] + self._batch(pages[whole:], 1)
        except TimedOut:
            pass
        except TransportFailed:
            if not halvings:
                raise
            halvings -= 1
        middle = len(pages) // 2
        return self._batch(pages[:middle], halvings) + self._batch(pages[middle:], halvings)

    def _page(self, page) -> str:
        unsteady = (TimedOut, TransportFailed)
        try:
            text = self._again([page], PAGE_TOKENS, unsteady)
        except Truncated:
            text = self._again([page], BATCH_TOKENS, unsteady)
        if not text.strip():
            raise OcrError("empty text")
        return text.strip()

    def _again(self, pages: Sequence, budget: int, unsteady: tuple) -> str:
        try:
            return self.request(pages, budget)
        except unsteady:
            time.sleep(self.pause)
            return self.request(pages, budget)


def cache_key(content: str, settings_digest: str) -> str:
    """SQL: where a document's text is kept."""
    return f"concat('{settings_digest}/', sha2({content}, 256), '.md')"


def cache_plan(documents: DataFrame, content: str, order: str, settings_digest: str, cache: DataFrame | None = None) -> DataFrame:
    """``cache_key, hit``: whether each document is read from the cache or has to be computed.

    Of equal contents that the cache lacks the first in order is the miss; the
    others find what it leaves.
    """
    keyed = documents.withColumn("cache_key", F.expr(cache_key(content, settings_digest)))
    first = keyed.groupBy("cache_key").agg(F.min(order).alias("first"))
    if cache is not None:
        first = first.join(cache.select("cache_key", F.lit(True).alias("cached")), "cache_key", "left")
    else:
        first = first.withColumn("cached", F.lit(None).cast("boolean"))
    return keyed.join(first, "cache_key").withColumn("hit", F.coalesce("cached", F.lit(False)) | (F.col(order) > F.col("first"))).drop("first", "cached")


def batch_plan(pages: str, batch_pages: int) -> str:
    """SQL: the batches of a document as ``array<struct<first_page, n>>``."""
    starts = f"sequence(0, cast(({pages} - 1) div {batch_pages} as int))"
    return f"transform({starts}, i -> named_struct('first_page', i * {batch_pages} + 1, 'n', cast(least({batch_pages}, {pages} - i * {batch_pages}) as int)))"


def bisections(batches: DataFrame, n: str = "n", most: int = 30) -> DataFrame:
    """All requests that halving a batch down to single pages makes: ``depth, offset, size``.

    A half may be a page larger than the other; five halvings reach one page
    from 30.
    """
    current = batches.withColumn("depth", F.lit(0)).withColumn("offset", F.lit(0)).withColumn("size", F.col(n).cast("int"))
    out = current
    for _ in range((most - 1).bit_length()):
        halves = F.expr("array(named_struct('o', offset, 's', size div 2), named_struct('o', cast(offset + size div 2 as int), 's', cast(size - size div 2 as int)))")
        current = current.where("size > 1").withColumn("half", F.explode(halves)).select(*batches.columns, (F.col("depth") + 1).alias("depth"), F.expr("cast(half.o as int)").alias("offset"), F.expr("cast(half.s as int)").alias("size"))
        out = out.unionByName(current)
    return out


def split_sections(text: str) -> str:
    """SQL: the non-blank sections of a reply."""
    return f"filter(transform(split({text}, '{SEPARATOR}', -1), s -> {T.strip('s')}), s -> s <> '')"


def data_uri(content: str) -> str:
    """SQL: a data URI on one line; Spark may break base64 into lines of 76."""
    return f"concat('data:image/png;base64,', regexp_replace(base64({content}), '\\\\s', ''))"


def extract(documents: DataFrame, id_col: str, render: Callable[[bytes], Sequence], request: Request, batch_pages: int = 20) -> DataFrame:
    """``id, markdown, pages, error``: a document's pages rendered and read by the two hooks, one failure at a time."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            rows = []
            for key, content in zip(frame[id_col], frame["content"], strict=True):
                try:
                    read = Reader(request, batch_pages).read(list(render(bytes(content))))
                    rows.append((key, JOINER.join(read), len(read), None))
                except Exception as e:
                    rows.append((key, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=[id_col, "markdown", "pages", "error"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, "content").mapInPandas(run, f"{id_col} {kind}, markdown string, pages long, error string")
