"""Event streams in SSE form, titles and histories of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.operators.uploads import is_placeholder

TITLE, HISTORY = 60, 20


def sse_payloads(bodies: DataFrame, body: str, *keep: str) -> DataFrame:
    """``at, payload`` of the records of an SSE body: their data lines, joined by line breaks."""
    records = bodies.select(*keep, F.posexplode(F.split(body, "\\r?\\n\\r?\\n")).alias("at", "record"))
    data = "filter(split(record, '\\\\r?\\\\n'), l -> startswith(l, 'data:'))"
    joined = f"array_join(transform({data}, l -> ltrim(substring(l, 6))), '\\n')"
    return records.select(*keep, "at", F.expr(joined).alias("payload")).where("payload <> ''")


def title(text: str, most: int = TITLE) -> str:
    return f"substring(trim(regexp_replace({text}, '\\\\s+', ' ')), 1, {most})"


def history(sessions: DataFrame, updated: str, key: str, most: int = HISTORY) -> DataFrame:
    """The newest sessions, newest first."""
    return sessions.orderBy(F.desc(updated), key).limit(most)


def visible_root_text(parts: str, author: str) -> str:
    """SQL over ``array<struct<text, thought>>``: what of a root event is shown."""
    shown = f"filter({parts}, p -> coalesce(p.text, '') <> '' and not coalesce(p.thought, false))"
    return f"case when {author} = 'root_agent' then array_join(transform({shown}, p -> p.text), '') else '' end"


def clean_user_text(parts: str, author: str) -> str:
    shown = f"filter(transform({parts}, p -> coalesce(p.text, '')), t -> t <> '' and not {is_placeholder('t')})"
    return f"case when {author} = 'user' then trim(array_join({shown}, '\\n')) else '' end"
