"""Contracts of structured results as SQL: the first violation, or null."""

from __future__ import annotations

# Fixed values.
KPI_STATUSES = ("found", "explicit_zero", "absent", "ambiguous")
QA_STATUSES = ("answered", "not_found", "ambiguous")
NEEDS_VALUE = "found and explicit_zero require value and evidence"
NEEDS_ZERO = "explicit_zero requires value=0"
NEEDS_NULL = "absent and ambiguous require value=null"
NEEDS_SCOPE = "absent requires notes describing the searched scope"
NEEDS_ANSWER = "answered requires a non-empty answer and evidence"
NO_ANSWER = "not_found and ambiguous require answer=null"
NEEDS_NOTES = "not_found and ambiguous require explanatory notes"
ONLY_RESULT = "succeeded outcome requires only result"
NEEDS_FAILURE = "failed outcome requires structured failure guidance"


def kpi_result(status: str, value: str, has_evidence: str, n_notes: str) -> str:
    known = ", ".join(f"'{s}'" for s in KPI_STATUSES)
    return (
        f"case when {status} is null or {status} not in ({known}) then 'unknown status' "
        f"when {status} in ('found', 'explicit_zero') and ({value} is null or not {has_evidence}) then '{NEEDS_VALUE}' "
        f"when {status} = 'explicit_zero' and {value} <> 0 then '{NEEDS_ZERO}' "
        f"when {status} in ('absent', 'ambiguous') and {value} is not null then '{NEEDS_NULL}' "
        f"when {status} = 'absent' and {n_notes} = 0 then '{NEEDS_SCOPE}' end"
    )


def qa_result(status: str, question: str, answer: str, n_evidence: str, longest_evidence: str, n_notes: str) -> str:
    known = ", ".join(f"'{s}'" for s in QA_STATUSES)
    return (
        f"case when {status} is null or {status} not in ({known}) then 'unknown status' "
        f"when length({question}) < 1 or length({question}) > 4000 then 'question length' "
        f"when length({answer}) > 12000 then 'answer length' when {n_evidence} > 5 then 'evidence count' "
        f"when {n_evidence} > 0 and ({longest_evidence} < 1 or {longest_evidence} > 2000) then 'evidence length' "
        f"when {status} = 'answered' and ({answer} is null or trim({answer}) = '' or {n_evidence} = 0) then '{NEEDS_ANSWER}' "
        f"when {status} <> 'answered' and {answer} is not null then '{NO_ANSWER}' "
        f"when {status} <> 'answered' and {n_notes} = 0 then '{NEEDS_NOTES}' end"
    )


def outcome(status: str, has_result: str, error: str, code: str, retryable: str) -> str:
    return (
        f"case when {status} = 'succeeded' and (not {has_result} or {error} is not null or {code} is not null or {retryable} is not null) then '{ONLY_RESULT}' "
        f"when {status} = 'failed' and ({has_result} or {error} is null or {error} = '' or {code} is null or {retryable} is null) then '{NEEDS_FAILURE}' "
        f"when {status} not in ('succeeded', 'failed') then 'unknown status' end"
    )
