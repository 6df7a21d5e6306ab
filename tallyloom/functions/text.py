"""String functions of the tracker and its keyword index, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = r"[ \t\r\n]+"
TAG = "<.*?>"


def strip_html(text: Column) -> Column:
    """Tags removed; what they parted is joined. A tag never spans lines."""
    return F.regexp_replace(text, TAG, "")


def strip_html_trimmed(text: Column) -> Column:
    return F.trim(strip_html(text))


def strip_html_spaced(text: Column) -> Column:
    """Tags replaced by a blank each."""
    return F.regexp_replace(text, TAG, " ")


def tokens(text: Column) -> Column:
    """array<string> of the runs between blanks, tabs and line ends."""
    return F.filter(F.split(text, WHITESPACE), lambda t: t != "")


def sanitize(token: Column) -> Column:
    """Cased letters in lower case and decimal digits; all else dropped."""
    return F.lower(F.regexp_replace(token, r"[^\p{Lu}\p{Lt}\p{Ll}\p{Nd}]", ""))


def first_letter(token: Column) -> Column:
    """The first cased letter as written; '' if there is none."""
    return F.regexp_extract(token, r"([\p{Lu}\p{Lt}\p{Ll}])", 1)


def prefix_symbol(token: Column) -> Column:
    """The first punctuation or symbol before any letter; '' if there is none."""
    return F.regexp_extract(token, r"^[^\p{Lu}\p{Lt}\p{Ll}\p{P}\p{Sm}\p{Sc}\p{So}]*([\p{P}\p{Sm}\p{Sc}\p{So}])", 1)


def csv_list(cell: Column) -> Column:
    """array<string> of a comma-separated cell, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(cell, ","), lambda x: F.trim(x)), lambda x: x != "")


def csv_has(cell: Column, name: Column) -> Column:
    """Whether an item of the cell equals the name, letter case ignored."""
    return F.coalesce(F.exists(csv_list(cell), lambda x: F.lower(x) == F.lower(name)), F.lit(False))


def title_without_key(title: Column, project: Column) -> Column:
    """'[ABC-1] text' -> 'text' if the bracket starts with the project key; else unchanged."""
    end = F.instr(title, "]")
    return F.when(F.startswith(title, F.concat(F.lit("["), project)) & (end > 0), F.trim(F.substring(title, end + 1, F.length(title)))).otherwise(title)


def url_stem(url: Column) -> Column:
    """Last path segment of an absolute URL without its extension; other text unchanged."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.regexp_extract(path, r"([^/]*)/?$", 1)
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.regexp_replace(last, r"\.[^.]*$", "")).otherwise(url)


def clean_field(value: Column) -> Column:
    """A key/value field as it is promoted: line ends out, '&amp;' resolved, trimmed, null to ''."""
    bare = F.replace(F.replace(F.replace(value, F.lit("\n"), F.lit("")), F.lit("\r"), F.lit("")), F.lit("&amp;"), F.lit("&"))
    return F.coalesce(F.trim(bare), F.lit(""))


def join_values(values: Column) -> Column:
    """Several values as one text, ', ' between; blank gives null."""
    joined = F.array_join(values, ", ")
    return F.when(F.trim(joined) == "", None).otherwise(joined)


def parse_date(text: Column) -> Column:
    """RFC 1123 or ISO text as UTC timestamp; null if it is neither."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]+,\s*", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]")), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd")))


def watches(count: Column) -> Column:
    """A number of watchers as text; 0 gives null."""
    return F.nullif(count.cast("int"), F.lit(0)).cast("string")


def squeeze(text: Column) -> Column:
    """Runs of white space made one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def file_size(size: Column) -> Column:
    """'1.5 KB': one decimal, B to TB."""
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.format_string("%.1f TB", size / F.lit(1024.0**4))
    for i in range(len(units) - 2, -1, -1):
        out = F.when(size < F.lit(1024.0 ** (i + 1)), F.concat(F.format_string("%.1f", size / F.lit(1024.0**i)), F.lit(f" {units[i]}"))).otherwise(out)
    return out


def days_inclusive(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def replaced_code(code: Column, replacements: dict[str, str], known: list[str], default: str) -> Column:
    """null or unknown -> default; a replaced code -> its successor; else itself."""
    out = F.when(code.isNull(), F.lit(default))
    for old, new in replacements.items():
        out = out.when(code == old, F.lit(new))
    return out.when(code.isin(known), code).otherwise(F.lit(default))


def expected_path(kind: Column, name: Column) -> Column:
    """Where the source of an artifact is expected: by its type."""
    low = F.lower(name)
    return F.when(kind == "Resource", F.concat(F.lit("source/"), low, F.lit("/structuredefinition-"), low, F.lit(".xml"))).when(kind == "Profile", F.concat(F.lit("source/profiles/"), low, F.lit(".xml"))).when(kind == "Extension", F.concat(F.lit("source/extensions/"), low, F.lit(".xml"))).otherwise(F.concat(F.lit("source/"), low, F.lit(".xml")))
