"""Markdown tables and block kinds as SQL expressions."""

from __future__ import annotations


def cells(line: str) -> str:
    """The cells of a table row; a pipe after a backslash is text."""
    trimmed = f"trim({line})"
    inner = f"regexp_replace(regexp_replace({trimmed}, '^\\\\|', ''), '\\\\|$', '')"
    return f"transform(split({inner}, '(?<!\\\\\\\\)\\\\|', -1), c -> trim(replace(c, '\\\\|', '|')))"


def is_alignment(cell_array: str) -> str:
    return f"forall({cell_array}, c -> c rlike '^:?-{{3,}}:?$')"


def alignments(cell_array: str) -> str:
    return f"transform({cell_array}, c -> case when startswith(c, ':') and endswith(c, ':') then 'center' when endswith(c, ':') then 'right' else 'left' end)"


def fitted(cell_array: str, columns: str) -> str:
    """A row with as many cells as the header: padded, or the overflow folded into the last one."""
    pad = f"concat({cell_array}, array_repeat('', {columns} - size({cell_array})))"
    cut = f"concat(slice({cell_array}, 1, {columns} - 1), array(array_join(slice({cell_array}, {columns}, size({cell_array})), ' | ')))"
    return f"case when size({cell_array}) <= {columns} then {pad} else {cut} end"


def status_badge(cell: str) -> str:
    return f"case when lower(trim({cell})) in ('found', 'absent', 'ambiguous', 'explicit_zero') then lower(trim({cell})) else 'neutral' end"


def block_kind(line: str) -> str:
    """What a line outside fences and tables begins."""
    return (
        f"case when trim({line}) = '' then 'blank' when startswith({line}, '```') then 'fence' "
        f"when {line} rlike '^#{{1,6}}\\\\s+.+$' then concat('h', least(length(regexp_extract({line}, '^(#+)', 1)) + 1, 6)) "
        f"when {line} rlike '^\\\\s*[-*+]\\\\s+.+$' then 'ul' when {line} rlike '^\\\\s*\\\\d+\\\\.\\\\s+.+$' then 'ol' else 'p' end"
    )
