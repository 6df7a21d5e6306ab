"""Counters and markers of page review as Column expressions.

Pattern values fixed by the subject (conformance words, markers) are listed as
plain text; hosts of chat and wiki links are parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import text as T

# fixed values: conformance words, markers of unfinished text, notes to readers
CONFORMANCE = ("SHALL", "SHOULD", "MAY")
INCOMPLETE = (r"to-do", r"todo", r"to\s+do", r"will\s+consider", r"\.\.\.", r"future\s+versions")
READER_NOTES = (
    r"\[%stu-note%\]", r"stu-note", r"stu\s+note",
    r"\[%impl-note%\]", r"implementation\s+note", r"implementer\s+note", r"note\s+to\s+implementers",
    r"\[%feedback-note%\]", r"feedback",
    r"\[%dragons-start%\]", r"dragon",
    r"balloters", r"voters",
)
TRIAL_USE = r"""(?i)(>\s*Trial\s+Use\s*<|class\s*=\s*['"]stu['"])"""
#: The host of code systems; tokens that link to them aren't looked at, with or without a scheme.
TERMINOLOGY_HOST = "terminology.example.org"
# fixed values: patterns of tokens that page review doesn't look at; each is searched anywhere in the token
SKIPPED = {
    "url": r"(?i)(http|https|ftp|sftp)://[^\s/$.?#].[^\s]*",
    "base_path": r"(?i)\[base\]/[^\s]*",
    "type_path": r"(?i)\[type\]/(\[type\]/?)?[^\s]*",
    "mail": r"(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "urn": r"(?i)urn:[a-zA-Z0-9][a-zA-Z0-9-]{1,31}:[^\s]+",
    "schema_type": r"(?i)xs[d]?:[a-zA-Z0-9._%+-]+(/[a-zA-Z0-9._%+-]+)?",
    "shape": r"(?i)fhir:[a-zA-Z0-9._%+-]+(/[a-zA-Z0-9._%+-]+)?",
    "code_system": r"(?i)(http://|https://)?" + TERMINOLOGY_HOST.replace(".", r"\.") + r"(/CodeSystem[^\s]*|/temporary/CodeSystem[^\s]*)",
    "file": r"(?i)[^\s]+\.(png|jpg|jpeg|gif|svg|htm|html|diagram|xsd|json|xml|sch|zip|shex|ttl)",
    # a date-time: all behind its year may be missing, so any year from 0001 to 9999 makes one
    "date_time": r"[0-9][0-9][0-9][1-9]|[0-9][0-9][1-9]0|[0-9][1-9]00|[1-9]000",
}


def followed_count(text: Column, word: str, exact_case: bool, negated: bool) -> Column:
    """How often a conformance word stands with (or without) NOT behind it."""
    tail = r"\s+NOT\b" if negated else r"\b(?!\s+NOT)"
    return F.regexp_count(text, F.lit(("" if exact_case else "(?i)") + rf"\b{word}{tail}"))


def conformance_columns(text: Column, words: Sequence[str] = CONFORMANCE) -> dict[str, Column]:
    """word -> count in capitals (conformant) and in other spelling (not conformant), plain and negated."""
    out = {}
    for word in words:
        for negated in (False, True):
            name = word.lower() + ("_not" if negated else "")
            good = followed_count(text, word, True, negated)
            out[f"{name}_conformant"] = good
            out[f"{name}_other"] = followed_count(text, word, False, negated) - good
    return out


def markers(text: Column, patterns: Sequence[str]) -> Column:
    """The markers found, each once whatever its case, sorted; the first spelling stays."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(" + "|".join(patterns) + r")\b"), F.lit(1))
    firsts = F.filter(found, lambda x, i: F.array_position(F.transform(found, F.lower), F.lower(x)) == i + 1)
    return F.array_sort(firsts, lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0))


def link_count(text: Column, host: str) -> Column:
    """Links to a host. As in the rules of old, a plain 'http:' link doesn't count, only 'https:' and 'http?:'."""
    return F.regexp_count(text, F.lit(r"(?i)http[s?]://" + host.replace(".", r"\.") + "/"))


def trial_use_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(TRIAL_USE))


def skip_reason(token: Column) -> Column:
    """The first rule that makes review skip the token; null if none does.

    Only tokens with one of a few characters can match a pattern; the others
    meet no regular expression but that one.
    """
    out = F.when(F.lit(False), "")
    for name, pattern in SKIPPED.items():
        out = out.when(token.rlike(pattern), name)
    out = out.when(token.startswith("[%") | token.endswith("%]"), "markup")
    symbol = T.prefix_symbol(token)
    out = out.when(symbol.isin("%", "#"), "symbol").when((symbol == "/") & token.startswith("/"), "path")
    return F.when(token.rlike(r"[0-9:/@.%#\[]"), out)
