"""Uploaded attachments: kinds, names, placeholders, the current report."""

from __future__ import annotations

from reportlake.functions import text as T

MAX_UPLOAD = 100 * 1024 * 1024
MARKDOWN_TYPES = "('text/markdown', 'text/x-markdown')"


def kind(mime: str, name: str) -> str:
    """SQL: ``markdown``, ``pdf`` or ``other``; PDF decides if a name and a type disagree."""
    lowered = f"lower(coalesce({name}, ''))"
    return (
        f"case when {mime} = 'application/pdf' or {lowered} like '%.pdf' then 'pdf' "
        f"when {mime} in {MARKDOWN_TYPES} or {lowered} like '%.md' or {lowered} like '%.markdown' then 'markdown' else 'other' end"
    )


def may_upload(name: str, size: str) -> str:
    return f"(lower({name}) rlike '[.](pdf|md|markdown)$' and {size} <= {MAX_UPLOAD})"


def safe_name(name: str, invocation: str, index: str) -> str:
    return f"coalesce(nullif({T.base_name(f'coalesce({name}, {chr(39)}{chr(39)})')}, ''), concat('report_', {invocation}, '_', {index}, '.md'))"


def stored_name(kind_col: str, name: str) -> str:
    """PDF reports are kept as the text that OCR gives."""
    return f"case when {kind_col} = 'pdf' then concat({T.stem(name)}, '.ocr.md') else {name} end"


def placeholder(name: str, ref: str) -> str:
    return f"""concat('[Uploaded annual report artifact: "', {name}, '"; use report_ref "', {ref}, '" for KPI tasks.]')"""


def is_placeholder(text: str) -> str:
    return f"startswith({text}, '[Uploaded annual report artifact:')"
