"""Normal forms of short strings, built from JVM expressions only."""

from __future__ import annotations

import html
import unicodedata
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _composed_pairs() -> dict[str, str]:
    """Every two-character sequence that Unicode composes to one letter.

    Built from the rule (canonical decomposition), not listed.
    """
    pairs: dict[str, str] = {}
    for code in range(0x00C0, 0x2000):
        one = chr(code)
        two = unicodedata.normalize("NFD", one)
        if len(two) > 1 and unicodedata.normalize("NFC", two) == one:
            base, mark = unicodedata.normalize("NFC", two[:-1]), two[-1]
            if len(base) == 1:
                pairs[base + mark] = one
    return pairs


def compose_accents(text: Column) -> Column:
    """Combining marks joined with their letter (NFC for letters with up to three marks).

    Null gives null. Strings without a mark skip the work altogether.
    """
    table = F.create_map(*[F.lit(x) for pair in _composed_pairs().items() for x in pair])

    def once(value: Column) -> Column:
        pieces = F.regexp_extract_all(value, F.lit(r"(?s)(.\p{M}?)"), F.lit(1))
        return F.array_join(F.transform(pieces, lambda x: F.coalesce(F.element_at(table, x), x)), "")

    marked = text.rlike(r"\p{M}")
    return F.when(marked, once(once(once(text)))).otherwise(text)


def plain_form(text: Column) -> Column:
    """Only letters and decimal digits, lower case, accents composed.

    '' where nothing is left, null for null. Invisible characters, blanks and
    punctuation vanish; a mark that composes with no letter is dropped.
    """
    kept = F.regexp_replace(text, r"[^\p{L}\p{Nd}\p{M}]", "")
    return F.lower(F.regexp_replace(compose_accents(kept), r"[^\p{L}\p{Nd}]", ""))


_ENTITY = r"&(?:#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


@cache
def _entity_table() -> str:
    """Every named entity of HTML and the numbers with a meaning of their own, as pairs for str_to_map; hard blanks become blanks."""
    named = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
    numbers = {f"#{n}": html.unescape(f"&#{n};") for n in range(161)}
    return "\x01".join(f"{name}\x02{' ' if text == chr(160) else text}" for name, text in (named | numbers).items())


def resolve_entities(text: Column) -> Column:
    """Character entities, named or numeric, replaced by their characters in one pass ('&amp;lt;' gives '&lt;').

    What isn't an entity of HTML stays as written; numbers of no character give U+FFFD.
    """
    table = F.str_to_map(F.lit(_entity_table()), F.lit("\x01"), F.lit("\x02"))

    def one(piece: Column) -> Column:
        name = F.substring(piece, F.lit(2), F.length(piece) - 2)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 99), 16, 10)).otherwise(F.substring(name, 2, 99)).cast("int")
        there = number.between(0, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.when(number < 161, F.element_at(table, F.concat(F.lit("#"), number.cast("string")))).when(there, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")
        return F.when(~piece.rlike(f"^{_ENTITY}$"), piece).when(F.startswith(name, F.lit("#")), char).otherwise(F.coalesce(F.element_at(table, name), piece))

    pieces = F.regexp_extract_all(text, F.lit(f"({_ENTITY}|[^&]+|&)"), F.lit(1))
    return F.when(text.rlike(_ENTITY), F.array_join(F.transform(pieces, one), "")).otherwise(text)
