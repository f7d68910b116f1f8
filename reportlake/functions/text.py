"""Text expressions as Spark SQL strings; each takes and returns SQL.

Folding is Unicode's full case folding.
"""

from __future__ import annotations

MAX_CHUNK, SNIPPET, LEAD = 6000, 600, 150
PAGE_BREAK = r"(?i)<---\\s*Page Split\\s*--->"
TERMS_PATTERN = "[a-z0-9]+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '(?U)\\\\A\\\\s+|\\\\s+\\\\z', '')"


def collapse(x: str) -> str:
    """White space runs as one space, none at the ends."""
    return f"trim(regexp_replace({x}, '(?U)\\\\s+', ' '))"


#: Letters whose case folding is not their lower case, by Unicode's own rule; capital sigma's lower case depends on its place.
_FOLDINGS = {chr(c): chr(c).casefold() for c in [*range(128, 0xD800), *range(0xE000, 0x10000)] if chr(c).casefold() != chr(c).lower()} | {"Σ": "σ"}
_PLAIN = "ßẞ"
_FOLD_MAP = "map(" + ", ".join(f"'{a}', '{b}'" for a, b in _FOLDINGS.items()) + ")"
_FOLD_CLASS = "[" + "".join(c for c in _FOLDINGS if c not in _PLAIN) + "]"


def fold(x: str) -> str:
    """Unicode's full case folding. Nearly all texts need lower case and sharp s only; the rest goes letter by letter."""
    letters = f"array_join(transform(split({x}, ''), c -> coalesce(try_element_at({_FOLD_MAP}, c), lower(c))), '')"
    return f"case when {x} rlike '{_FOLD_CLASS}' then {letters} else replace(lower({x}), 'ß', 'ss') end"


def terms(query: str) -> str:
    return f"regexp_extract_all({fold(query)}, '{TERMS_PATTERN}', 0)"


def phrase(query: str) -> str:
    return collapse(fold(query))


def occurrences(haystack: str, needle: str) -> str:
    """Non-overlapping occurrences of a non-empty string; most haystacks hold none."""
    counted = f"cast((length({haystack}) - length(replace({haystack}, {needle}, ''))) div length({needle}) as bigint)"
    return f"case when contains({haystack}, {needle}) then {counted} else 0L end"


def pages(text: str) -> str:
    return f"split({text}, '{PAGE_BREAK}', -1)"


def heading(page: str) -> str:
    found = f"regexp_extract({page}, '(?md)^#{{1,6}}\\\\s+(.+?)\\\\s*$', 1)"
    return f"case when {found} = '' then 'Annual Report' else substring({found}, 1, 200) end"


def bounded_pieces(text: str, most: int = MAX_CHUNK) -> str:
    """Pieces of at most ``most`` characters, cut at the last blank line in the second half if there is one.

    Each cut strips, which moves the next one, so this is a fold; every step
    consumes half of ``most`` at least, which bounds the number of steps.
    """
    half = most // 2
    window = f"substring(a.rem, 1, {most + 1})"
    back = f"locate('\\n\\n', reverse({window}))"
    cut = f"case when {back} = 0 or {most} - {back} < {half} then {most} else {most} - {back} end"
    longer = (
        "transform(array(" + cut + "), b -> named_struct('rem', " + strip("substring(a.rem, b + 1, length(a.rem))")
        + ", 'out', concat(a.out, array(" + strip("substring(a.rem, 1, b)") + "))))[0]"
    )
    step = (
        f"case when a.rem = '' then a when length(a.rem) <= {most} "
        f"then named_struct('rem', '', 'out', concat(a.out, array(a.rem))) else {longer} end"
    )
    start = f"named_struct('rem', {strip(text)}, 'out', cast(array() as array<string>))"
    return f"aggregate(sequence(1, cast(ceil(length({text}) / {half}.0) as int) + 1), {start}, (a, i) -> {step}, a -> a.out)"


def snippet_start(term_array: str, folded_text: str) -> str:
    """Where a snippet begins: a little before the first term, counted in the folded text."""
    at = f"transform(filter({term_array}, t -> contains({folded_text}, t)), t -> locate(t, {folded_text}) - 1)"
    return f"greatest(0, coalesce(array_min({at}), 0) - {LEAD})"


def base_name(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)/*$', 1)"


def stem(name: str) -> str:
    """A file name without its last suffix; a leading dot begins no suffix."""
    return f"regexp_replace({name}, '(?<=[^.])\\\\.[^.]*$', '')"


def report_ref(name: str) -> str:
    cleaned = f"trim(BOTH '_' FROM regexp_replace({stem(base_name(name))}, '[^A-Za-z0-9]+', '_'))"
    return f"coalesce(nullif({cleaned}, ''), 'report')"


def percent_quoted(name: str) -> str:
    """Percent-encoding that leaves letters, digits and ``_.-~/``."""
    encoded = f"replace(replace(replace(url_encode({name}), '+', '%20'), '*', '%2A'), '%7E', '~')"
    return f"replace({encoded}, '%2F', '/')"


def byte_size(n: str) -> str:
    """A size with one decimal in KB, or from one MiB on in MB."""
    return f"case when {n} < 1048576 then concat(format_string('%.1f', {n} / 1024D), ' KB') else concat(format_string('%.1f', {n} / 1048576D), ' MB') end"
