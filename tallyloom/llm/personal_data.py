r"""Personal data in free text: found, typed, replaced.

Detection reads a normal form of the text (character entities resolved,
invisible characters gone, accents composed, all kinds of dash and blank made
one) and maps every finding back to the characters it stands on, so the rest of
the text stays as it was, byte for byte.

Entities are e-mail addresses (also written out with "at" and "dot"), telephone
numbers, identity numbers behind their label, street addresses and full names
of persons. Names come from a directory of given and family names plus titles; a
family name alone is no finding. A directory of up to PATTERN_NAMES names is one
pattern; of a larger one, of any size, each text gets just the names whose
longest word it holds, by a join (`with_names`), with the same result.

Each distinct entity gets a keyed surrogate of its own type: the same entity the
same surrogate everywhere, and two entities never the same one (collision checks
over all distinct entities, in rounds, against each other and against the real
entities). The secret is a parameter.

* Names keep script, accents, hyphens, apostrophes and particles. Gender follows
  the titles a person is mentioned with, else the ending of the given name.
* An initial with a family name is the person of that name in the same text, or
  else in all texts, if there is exactly one; else it stays an entity of its own.
* An e-mail address whose local part spells a person's name is built from that
  person's surrogate; a domain has one surrogate for all its addresses.
* Telephone and identity numbers go through a keyed permutation of all numbers of
  their shape (kept prefix, classes of characters). Where more than one in
  DENSE numbers of a shape is a real one the permutation itself makes them
  distinct and none its own surrogate, but a surrogate may be someone else's real
  number: more than half of the numbers in use leave no other way.

Each mention shows its entity's surrogate in its own letter case and format
(`rendered`); a mention whose words can't be paired with those of the entity's
first written form shows it in that form.

Defined results: null and empty texts hold nothing; of overlapping findings the
one of the earlier type in TYPES stays; rows with one id are treated one by one;
an empty table or directory gives no names but everything else. Entities without
a free surrogate after ROUNDS rounds (the room for names, addresses and e-mail
grows with each) get a running number behind it.
"""

from __future__ import annotations

import hashlib
import hmac
import html
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.references import lookup_salted
from tallyloom.session import materialise

TYPES = ("email", "id_number", "phone", "address", "person")
PATTERN_NAMES = 5_000
ROUNDS = 12
DENSE = 16
SALTS = 16

_ODD = re.compile(
    r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
    r"|[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]"
    r"|[\u00a0\u2000-\u200a\u202f\u205f\u3000]"
    r"|[\u2010-\u2015\u2212\u2018\u2019\u02bc\u00b4]"
    r"|.[\u0300-\u036f]+",
    re.DOTALL,
)
_PLAIN_CHARS = {**dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "-"), **dict.fromkeys("\u2018\u2019\u02bc\u00b4", "'")}


def _plain_piece(piece: str) -> str:
    if piece[0] == "&":
        out = html.unescape(piece)
        return piece if out == piece else "".join(_plain_piece(c) if _ODD.fullmatch(c) else c for c in out)
    if len(piece) > 1:
        return unicodedata.normalize("NFC", piece)
    if piece in _PLAIN_CHARS:
        return _PLAIN_CHARS[piece]
    return " " if piece.isspace() else ""


def normal_form(text: str) -> tuple[str, list[int] | None]:
    """The text as detection reads it, and where each of its characters starts (None: unchanged).

    The list has one more entry, the text's length.
    """
    if text.isascii() and "&" not in text:
        return text, None
    parts, places, at = [], [], 0
    for m in _ODD.finditer(text):
        parts.append(text[at : m.start()])
        places.extend(range(at, m.start()))
        new = _plain_piece(m.group())
        parts.append(new)
        places.extend([m.start()] * len(new))
        at = m.end()
    if not at:
        return text, None
    parts.append(text[at:])
    places.extend(range(at, len(text) + 1))
    return "".join(parts), places


def entity_key(text: str) -> str:
    """Only letters and digits, lower case, accents composed."""
    return "".join(c for c in unicodedata.normalize("NFC", text.lower()) if c.isalpha() or c.isdecimal())


# --- e-mail ---------------------------------------------------------------
_LOCAL = r"(?P<local>[\w][\w.+%'-]*)"
_DOT = r"(?:\.|[ \t]*[\[({][ \t]*dot[ \t]*[\])}][ \t]*|[ \t]+dot[ \t]+)"
_WORD_DOT = r"(?:[ \t]*[\[({][ \t]*dot[ \t]*[\])}][ \t]*|[ \t]+dot[ \t]+)"
_LABEL = r"[A-Za-z0-9](?:[\w-]*[A-Za-z0-9])?"
EMAIL = re.compile(
    rf"(?<![\w.+%/-]){_LOCAL}(?:"
    rf"[ \t]?@[ \t]?(?P<d1>{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}})"
    rf"|[ \t]*[\[({{][ \t]*at[ \t]*[\])}}][ \t]*(?P<d2>{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}})"
    rf"|[ \t]+at[ \t]+(?P<d3>{_LABEL}(?:\.{_LABEL})*(?:{_WORD_DOT}{_LABEL})*{_WORD_DOT}[A-Za-z]{{2,}})"
    r")(?![\w-]|:[\w/~.-]+)",
    re.IGNORECASE,
)
#: Accounts of systems, not of persons.
_SYSTEM = frozenset("git svn hg ssh noreply no-reply donotreply do-not-reply mailer-daemon postmaster root daemon www-data".split())
_OBFUSCATED_DOT = re.compile(_WORD_DOT, re.IGNORECASE)
_BRACKETED_AT = re.compile(r"[\[({][ \t]*at[ \t]*[\])}]", re.IGNORECASE)


def find_emails(text: str) -> Iterator[tuple[int, int, str]]:
    # without '@' an address has its 'at' in brackets or a written-out 'dot'
    if "@" not in text and "dot" not in text.lower() and not _BRACKETED_AT.search(text):
        return
    for m in EMAIL.finditer(text):
        local = m["local"].rstrip(".'")
        domain = m["d1"] or m["d2"] or m["d3"]
        if local.lower() in _SYSTEM or text[max(0, m.start() - 3) : m.start()].endswith("://"):
            continue
        yield m.start(), m.end(), entity_key(local + _OBFUSCATED_DOT.sub(".", domain))


# --- identity numbers -----------------------------------------------------
_S = r"[ \t\r\n]*"
_B = r"[ \t\r\n]+"
_IS = rf"(?:{_S}(?:number|no\.?|num\.?|nr\.?|id|#))?{_S}(?:(?:[:=#]|\bis\b|\bwas\b){_S})?"
_SSN = r"\d{3}[ -]?\d{2}[ -]?\d{4}(?![\d-])"
_NINO = r"[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-D](?!\w)"
_CHART = r"(?:\d{4}[ -]\d{4}|\d{5,12})(?![\d-])"
_PASS = r"(?:[A-Z]{1,3}[ -]?\d{6,9}|\d{9})(?!\w)"
ID_NUMBERS = tuple(
    re.compile(rf"(?<![\w]){label}{_IS}(?P<value>{value})", re.IGNORECASE)
    for label, value in (
        (rf"(?:ssn|soc(?:ial)?\.?{_B}sec(?:urity)?)", _SSN),
        (rf"(?:nino|ni|nat(?:ional|\.)?{_B}ins(?:urance|\.)?|insurance)", _NINO),
        (rf"(?:mrn|med(?:ical|\.)?{_B}rec(?:ord|\.)?|chart|hospital|patient{_B}(?:id|record))", _CHART),
        (rf"(?:passport|travel{_B}document)", _PASS),
    )
)
_ID_HINTS = ("ssn", "soc", "nino", "ni ", "ni:", "ni=", "ni#", "nat", "insur", "mrn", "medical", "med ", "med.", "chart", "hospital", "patient id", "patient rec", "passport", "travel")


#: Five digits with little between them, which every identity and telephone number has.
_FIVE_DIGITS = re.compile(r"\d(?:\W{0,3}\d){4}")


def find_ids(text: str) -> Iterator[tuple[int, int, str]]:
    if not _FIVE_DIGITS.search(text):
        return
    low = text.lower()
    if not any(hint in low for hint in _ID_HINTS):
        return
    for pattern in ID_NUMBERS:
        for m in pattern.finditer(text):
            yield m.start("value"), m.end("value"), entity_key(m["value"])


# --- telephone numbers ----------------------------------------------------
_P = r"[ \t\r\n]?[-./]?[ \t]?"
PHONE = re.compile(
    r"(?<![\w./@#=-])(?:"
    # international: + or 00, country, then groups
    r"(?:\+|00)[ ]?(?:44|61|49|33|34|39|41|43|31|32|353|64)[ .-]?(?:\(0\)[ ]?)?\d(?:[ .\-\n]?\d){7,10}"
    r"|(?:\+[ ]?|00)1[ .-]?\(?[2-9]\d\d\)?[ .\-/\n]{0,2}[2-9]\d\d[ .\-\n]?\d{4}"
    # North American: area code in brackets, with separators, or ten digits
    r"|(?:1[ .-])?\([2-9]\d\d\)[ \n]?[2-9]\d\d[ .\-\n]\d{4}"
    r"|(?:1[ .\-\n])?[2-9]\d\d[ .\-/\n][2-9]\d\d[ .\-\n]\d{4}"
    r"|1?[2-9]\d\d[2-9]\d{6}"
    # British and Australian national
    r"|0[1-9]\d{2,4}[ \-\n]?\d{3}[ \-\n]?\d{3,4}|0[1-9]\d[ \-\n]\d{4}[ \-\n]\d{4}|0[1-9]\d{8,9}"
    r"|\(0[1-9]\d{0,3}\)[ \n]?\d{3,4}[ \-\n]?\d{3,4}"
    r")(?![\w/]|[.-]\d)"
)
#: A bare run of digits behind one of these words, or an identifier that ends with one (rowId), counts things.
_THINGS = frozenset("concept code codes instance id ids oid row rows line lines over shard item items version error build ratio slot number key hash count total bytes ticket issue port and".split())
_BARE = re.compile(r"\d+")
_LAST_PART = re.compile(r"[A-Z]?[a-z]+\Z|[A-Z]+\Z")


def _word_before(text: str, at: int, skipped: str) -> str:
    """The letters and digits that stand before `at`, characters of `skipped` between them left out."""
    while at and text[at - 1] in skipped:
        at -= 1
    end = at
    while at and text[at - 1].isalnum():
        at -= 1
    return text[at:end]


def find_phones(text: str) -> Iterator[tuple[int, int, str]]:
    if not _FIVE_DIGITS.search(text):
        return
    for m in PHONE.finditer(text):
        if _BARE.fullmatch(m.group()) and (part := _LAST_PART.search(_word_before(text, m.start(), " \t:#="))) and part.group().lower() in _THINGS:
            continue
        yield m.start(), m.end(), entity_key(m.group())


# --- street addresses -----------------------------------------------------
_STREET = r"(?:street|road|lane|avenue|drive|way|close|court|boulevard|terrace|place|square|crescent|parkway|highway|mews|grove|gardens|circle|trail|walk|row|st|rd|ln|ave|av|dr|ct|cl|blvd|terr?|pl|sq|cres|pkwy|hwy|cir)"
_NAME = r"[^\W\d_](?:[^\W\d_]|['-])*\.?"
ENGLISH = re.compile(rf"(?<![\w./#-])(?P<no>\d{{1,5}}[A-Za-z]?(?:-\d{{1,5}})?(?:[ ]1/2)?),?{_B}(?P<street>(?:{_NAME}{_B}){{1,3}}?{_STREET})(?![\w'-])", re.IGNORECASE)
_FRENCH_WAY = r"(?:rue|avenue|boulevard|all[ée]e|chemin|impasse|quai|cours|route|place|square|passage|ruelle|sentier|faubourg|esplanade|promenade)"
_FRENCH_FIRST = r"(?:vieux|vieil|vieille|grande?|petite?|hauts?|haute|bas|basse|saint|sainte|jean|marie|victor|charles|g[ée]n[ée]ral|mar[ée]chal|docteur|pr[ée]sident|neuf|neuve|belle|beau|bon|bonne|quatre|trois|deux|cinq|premier)"
FRENCH = re.compile(
    rf"(?<![\w./#-])(?P<no>\d{{1,4}}(?:{_S}(?:bis|ter|quater)\b|[A-Da-d]\b)?),?{_S}(?P<street>{_FRENCH_WAY}{_B}(?:(?:de{_B}la|de{_B}l'|des|du|de|d'|l'|la|le|les|aux?){_S})?(?:{_FRENCH_FIRST}{_B})*[^\W\d_](?:[^\W\d_]|['-])+)(?!\w)",
    re.IGNORECASE,
)
_GERMAN_WAY = r"(?:stra(?:ß|ss)e|str\.|weg|allee|gasse|platz|ring|damm|ufer|steig|chaussee|graben|markt|pfad|stieg|zeile|promenade)"
_GERMAN_PLACE = r"(?:tor|berg|bach|hang|see|wald|feld|markt|graben|park|hof|ufer|bahnhof|kirche|kirchplatz|anger|br[üu]cke|m[üu]hle|linden|garten|g[äa]rten|wiese|teich|rain|wall|plan|ring|dom|stadt|brunnen)"
GERMAN = re.compile(
    rf"(?<![\w-])(?P<street>(?:[^\W\d_]|-)*[^\W\d_]{_GERMAN_WAY}|(?:am|an{_B}de[rmn]|auf{_B}de[rmn]|im|in{_B}de[rmn]|zu[mr]|unter{_B}den|hinter{_B}de[rmn]|vor{_B}de[rmn]|bei{_B}de[rmn]){_B}(?:[^\W\d_]+e[nrms]?{_B})?[^\W\d_]*{_GERMAN_PLACE}){_B}(?P<no>\d{{1,4}}(?:[ ]?[a-h]\b)?)(?![\w])",
    re.IGNORECASE,
)
_DIGITS = re.compile(r"\d+")
#: The end of the word before the number of a German address, and most words a street has.
_GERMAN_END = re.compile(rf"(?:{_GERMAN_WAY}|{_GERMAN_PLACE})\Z", re.IGNORECASE)
_GERMAN_WORDS = 4
#: Words that never stand between a house number and the word for a street.
_NO_NAME = frozenset("a an and any are as at be been bindings by cases code codes columns copies do does each elements entries every fields files for forms from has have he her his i if in into is issues it items its lines more no not of on one or our out over pages per rows see she slices so tests than that the their them then there they this times to under was we were what when where which who will with words years you days minutes hours weeks months percent ms".split())


def _words_back(text: str, at: int, n: int) -> int:
    """Where the n-th word before `at` begins; an empty line is not crossed."""
    start = at
    for _ in range(n):
        end = start
        while end and text[end - 1] in " \t\r\n":
            end -= 1
        if "\n\n" in text[end:start]:
            return start
        start = end
        while start and text[start - 1] not in " \t\r\n":
            start -= 1
    return start


def find_addresses(text: str) -> Iterator[tuple[int, int, str]]:
    # every address has a house number, and numbers are few
    for n in _DIGITS.finditer(text):
        at = n.start()
        if at and (text[at - 1] in "./#-_" or text[at - 1].isalnum()):
            continue
        if (m := ENGLISH.match(text, at)) and not any(w.strip(".'").lower() in _NO_NAME or w.endswith(".") and w.lower() != "st." for w in m["street"].split()[:-1]):
            yield m.start(), m.end(), entity_key(m["no"] + m["street"])
        elif m := FRENCH.match(text, at):
            yield m.start(), m.end(), entity_key(m["no"] + m["street"])
        elif at and text[at - 1] in " \t\r\n" and _GERMAN_END.search(text[_words_back(text, at, 1) : at].rstrip()):
            for m in GERMAN.finditer(text, _words_back(text, at, _GERMAN_WORDS)):
                if m.start("no") == at:
                    yield m.start(), m.end(), entity_key(m["street"] + m["no"])
                if m.start("no") >= at:
                    break


# --- persons --------------------------------------------------------------
def _folded(name: str) -> set[str]:
    bare = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))
    return {name, bare}


def _name_pattern(names: Iterable[str]) -> str:
    """An alternation of names, longest first; blanks, dashes and apostrophes may vary."""
    forms = {f for n in names for f in _folded(unicodedata.normalize("NFC", n.strip())) if f}
    out = []
    for n in sorted(forms, key=lambda n: (-len(n), n)):
        out.append("".join(_B if c.isspace() else "'" if c in "'\u2019" else re.escape(c) for c in n))
    return "(?:" + "|".join(out) + ")" if out else "(?!)"


_INITIALS = rf"[^\W\d_a-z]\.(?:{_S}[^\W\d_a-z]\.)*"
_CAP = r"[^\W\d_a-z][^\W\d_]*(?:['-][^\W\d_]+)*"
TITLED = re.compile(rf"(?<!\w)(?:Mr|Mrs|Ms|Miss|Dr|Prof|Nurse|Sister|Doctor)\.?[ \t]+(?P<given>{_CAP}(?:[ \t]+[^\W\d_a-z]\.)?)[ \t]+(?P<family>{_CAP})(?![\w'-])")
#: What every title of TITLED contains.
_TITLES = ("Mr", "Ms", "Miss", "Dr", "Prof", "Nurse", "Sister", "Doctor")
_NOT_A_NAME = frozenset("The This That These Those And But For From With Practitioner Practitioners Resource Patient".split())


def _longest_words(name: str) -> set[str]:
    """The longest word of each form of a name, in lower case; a text that holds the name holds one of them."""
    forms = (re.findall(r"[^\W_]+", f.lower()) for f in _folded(unicodedata.normalize("NFC", name)))
    return {max(words, key=len) for words in forms if words}


@lru_cache(maxsize=4096)
def _person_patterns(given: tuple[str, ...], family: tuple[str, ...]) -> tuple:
    g, f = _name_pattern(given), _name_pattern(family)
    middle = rf"(?:{_B}[^\W\d_]\.)*"
    parts = sorted({w for n in family for w in _longest_words(n)})
    return (
        re.compile(rf"(?<![\w.+-])(?<!\w@)(?P<given>{g}{middle}){_B}(?P<family>{f})(?![\w-]|'\w|@|[.+]\w+@)", re.IGNORECASE),
        re.compile(rf"(?<![\w.+-])(?P<family>{f}),{_B}(?P<given>{g}{middle})(?![\w-]|'\w|{_B}{f}(?![\w.+@-]))", re.IGNORECASE),
        re.compile(rf"(?<![\w.+-])(?P<given>{_INITIALS}){_S}(?P<family>(?i:{f}))(?![\w-]|'\w|@)"),
        re.compile(rf"(?<![\w.+-])(?P<family>(?i:{f})),{_B}(?P<given>{_INITIALS})(?!\w)"),
        _any_of(tuple(parts)),
    )


def _any_of(parts: tuple[str, ...]):  # noqa: ANN202
    """A test whether a text in lower case may hold one of the words."""
    if not parts:
        return lambda text: False
    if len(parts) < 50:
        return lambda text: any(p in text for p in parts)
    try:
        import ahocorasick
    except ImportError:
        return re.compile("|".join(map(re.escape, parts))).search

    tree = ahocorasick.Automaton()
    for part in parts:
        tree.add_word(part, 1)
    tree.make_automaton()
    return lambda text: next(tree.iter(text), None) is not None


def find_persons(text: str, given: tuple[str, ...], family: tuple[str, ...]) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, key, key of the given names, whether those are initials)."""
    full, turned, initials, initials_turned, may_hold = _person_patterns(given, family)
    if may_hold(text.lower()):
        for pattern in (full, initials, turned, initials_turned):
            for m in pattern.finditer(text):
                first = entity_key(m["given"])
                yield m.start(), m.end(), first + entity_key(m["family"]), first, pattern in (initials, initials_turned)
    for m in TITLED.finditer(text) if any(t in text for t in _TITLES) else ():
        if m["given"] not in _NOT_A_NAME and m["family"] not in _NOT_A_NAME:
            first = entity_key(m["given"])
            yield m.start("given"), m.end(), first + entity_key(m["family"]), first, False


#: Titles that tell a person's gender.
_GENDERED = {**dict.fromkeys("mr herr sr señor monsieur".split(), "m"), **dict.fromkeys("mrs ms miss frau mme mlle sra señora madame".split(), "f")}


def _located(text: str | None, given: tuple[str, ...], family: tuple[str, ...]) -> list[tuple[int, int, str, str, str, bool, str | None]]:
    """(start, end, type, key, key of the given names, whether initials, gender by title) of the entities, in order, never overlapping."""
    if not text:
        return []
    plain, places = normal_form(text)
    taken = []
    used = bytearray(len(plain))
    finders = (("email", find_emails), ("id_number", find_ids), ("phone", find_phones), ("address", find_addresses), ("person", lambda t: find_persons(t, given, family)))
    for kind, finder in finders:
        for start, end, key, *name in finder(plain):
            if key and used.find(1, start, end) < 0:
                used[start:end] = b"\1" * (end - start)
                gender = _GENDERED.get(_word_before(plain, start, ". \t").lower()) if name else None
                taken.append((start, end, kind, key, *(name or ("", False)), gender))
    taken.sort()
    if places is None:
        return taken
    # an end lies behind all that belongs to the last character found
    return [(places[s], places[e], *rest) for s, e, *rest in taken]


def find_entities(text: str | None, given: tuple[str, ...], family: tuple[str, ...]) -> list[tuple[int, int, str, str]]:
    """(start, end, type, key) of the entities in the text, in order, never overlapping."""
    return [f[:4] for f in _located(text, given, family)]


# --- operator -------------------------------------------------------------
@dataclass(frozen=True)
class Directory:
    """Given and family names; where there are too many for a pattern, `names` has them as (token, side, name)."""

    given: tuple[str, ...] = ()
    family: tuple[str, ...] = ()
    names: DataFrame | None = None


def _tokens_of_name(name: str) -> Column:
    @F.pandas_udf("array<string>")
    def tokens(names: pd.Series) -> pd.Series:
        return pd.Series([sorted(_longest_words(n)) for n in names], dtype=object)

    return tokens(name)


def _tokens_of_text(text: str) -> Column:
    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(re.findall(r"[^\W_]+", normal_form(t)[0].lower()))) for t in texts], dtype=object)

    return tokens(text)


def directory(people: DataFrame, display_name: Column, limit: int = PATTERN_NAMES) -> Directory:
    """The names of a table of 'Given Family' names, of any size; up to `limit` of a side are collected."""
    names = people.select(F.trim(display_name).alias("n")).where("n LIKE '% %'").select(F.split_part("n", F.lit(" "), F.lit(1)).alias("g"), F.expr("ltrim(substring(n, instr(n, ' ') + 1))").alias("f"))
    sides = []
    for side in ("g", "f"):
        rows = names.select(side).distinct().limit(limit + 1).collect()
        if len(rows) > limit:
            every = names.select(F.explode(F.array(F.struct(F.lit("g").alias("side"), F.col("g").alias("name")), F.struct(F.lit("f").alias("side"), F.col("f").alias("name")))).alias("x")).select("x.*").where("name <> ''").distinct()
            return Directory(names=every.withColumn("token", F.explode(_tokens_of_name("name"))))
        sides.append(tuple(sorted(r[0] for r in rows if r[0])))
    return Directory(*sides)


def with_names(rows: DataFrame, people: Directory) -> DataFrame:
    """rows (row_id, text) plus `names`, the names that each text may hold; null if the directory is a pattern.

    Only tokens that are in the directory travel, with a hash of their text.
    """
    if people.names is None:
        return rows.withColumn("names", F.lit(None).cast("array<struct<side: string, name: string>>"))
    keyed = rows.withColumn("__h", F.xxhash64("row_id", "text"))
    tokens = keyed.where("text IS NOT NULL").select("__h", F.explode(_tokens_of_text("text")).alias("token"))
    held = tokens.join(people.names, "token").groupBy("__h").agg(F.collect_set(F.struct("side", "name")).alias("names"))
    # texts without a name get an empty list
    return keyed.join(held, "__h", "left").select("row_id", "text", F.coalesce("names", F.array().cast("array<struct<side: string, name: string>>")).alias("names"))


def _sides(names: Iterable[dict] | None, people: tuple[tuple[str, ...], tuple[str, ...]]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    if names is None:
        return people
    return tuple(sorted(n["name"] for n in names if n["side"] == "g")), tuple(sorted(n["name"] for n in names if n["side"] == "f"))


_FINDING = "start_at int, end_at int, pii_type string, pii_key string, given_key string, initials boolean, gender string, written string"


def detect(rows: DataFrame, row_id: Column, text: Column, people: Directory) -> DataFrame:
    """(row_id, start_at, end_at, pii_type, pii_key, given_key, initials, gender, written), one row per finding."""
    source = with_names(rows.select(row_id.alias("row_id"), text.alias("text")).where("text IS NOT NULL AND text <> ''"), people)
    kind = source.schema["row_id"].dataType.simpleString()
    known = (people.given, people.family)
    columns = ["row_id", *(c.split()[0] for c in _FINDING.split(", "))]

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, *f, text[f[0] : f[1]]) for i, text, names in zip(batch["row_id"], batch["text"], batch["names"], strict=True) for f in _located(text, *_sides(names, known))]
            yield pd.DataFrame(out, columns=columns)

    return source.mapInPandas(found, f"row_id {kind}, {_FINDING}")


def mask(rows: DataFrame, row_id: Column, text: Column, people: Directory) -> DataFrame:
    """(row_id, masked_text): the text with [EMAIL], [PHONE], ... in the place of each finding, otherwise unchanged."""
    source = with_names(rows.select(row_id.alias("row_id"), text.alias("text")), people)
    known = (people.given, people.family)

    @F.pandas_udf("string")
    def masked(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([_replaced(t, [(s, e, f"[{kind.upper()}]") for s, e, kind, *_ in _located(t, *_sides(n, known))]) if t else t for t, n in zip(texts, names, strict=True)], dtype=object)

    return source.select("row_id", masked("text", "names").alias("masked_text"))


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, new in spans:
        out += (text[at:start], new)
        at = end
    return "".join(out) + text[at:]


# --- surrogates -----------------------------------------------------------
#: Invented syllables for surrogate names by script: onsets, vowels, codas, initials.
_SYLLABLES = {
    "LATIN": ("B D F G H J K L M N P R S T V W Br Dr Gr Kr Pr Tr St".split(), "a e i o u ai ei oa".split(), "l n r s t m d k".split(), "ABCDEFGHJKLMNOPRSTVW"),
    "CYRILLIC": ("Б В Г Д К Л М Н П Р С Т Ф Х Бр Др Гр Кр Пр Тр Ст".split(), "а е и о у ай ей".split(), "л н р с т м д к".split(), "АБВГДЕКЛМНОПРСТФХ"),
    "GREEK": ("Β Γ Δ Κ Λ Μ Ν Π Ρ Σ Τ Φ Χ Βρ Δρ Κρ Πρ Τρ Στ".split(), "α ε η ι ο υ αι ει οι".split(), "λ ν ρ".split(), "ΑΒΓΔΕΚΛΜΝΟΠΡΣΤΦΧ"),
}
#: The usual ends of a woman's given name, and the one its surrogate gets.
_FEMALE = {"LATIN": ("aeiy", "a"), "CYRILLIC": ("ая", "а"), "GREEK": ("αηωάήώ", "α")}
#: Ends of family names that agree with the person's gender; kept.
_FAMILY_ENDS = re.compile(r"(?:ова|ева|ёва|ина|ская|цкая|ов|ев|ёв|ин|ский|цкий|ová|ská|ский|όπουλος|οπούλου|ίδης|ίδου)\Z", re.IGNORECASE)
#: Words inside a name or a street that are no names themselves.
_PARTICLES = frozenset("van von de der den ten ter la le las los da di do dos del della du des d el al bin ibn zu zur zum y e".split())
_STREET_WORDS = _PARTICLES | frozenset("les l en et sur sous the of and am an im in auf aus bei dem die das unter hinter vor st bis quater n s e w ne nw se sw".split())


def _script(text: str) -> str:
    """The script of the first letter, as Unicode names it; Latin without a letter."""
    first = next((c for c in text if c.isalpha()), "a")
    return unicodedata.name(first, "LATIN").split()[0]


@cache
def _letters(script: str) -> str:
    """The plain letters of a script without syllables of its own here."""
    start = "HANGUL SYLLABLE " if script == "HANGUL" else script + " "
    plain = (c for c in map(chr, range(0x10000)) if unicodedata.name(c, "").startswith(start))
    return "".join(c for c in plain if c.isalpha() and not c.isupper() and unicodedata.category(c) != "Lm" and unicodedata.normalize("NFKC", c) == c)


class _Draw:
    """A keyed stream of choices for one entity and attempt."""

    def __init__(self, secret: bytes, *what: object) -> None:
        self.state = hmac.new(secret, "|".join(map(str, what)).encode(), hashlib.sha256).digest()

    def below(self, n: int) -> int:
        self.state = hashlib.sha256(self.state).digest()
        return int.from_bytes(self.state[:8], "big") % n

    def of(self, options: list[str] | str) -> str:
        return options[self.below(len(options))]


class Permutation:
    """A keyed permutation of 0 .. size - 1: a Feistel network over a power of two, walked until inside."""

    ROUNDS = 6

    def __init__(self, secret: bytes, tweak: str, size: int) -> None:
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.bytes = (self.half + 7) // 8
        self.keys = [hmac.new(secret, f"{tweak}|{i}".encode(), hashlib.sha256).digest() for i in range(self.ROUNDS + 1)]

    def _mix(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(x.to_bytes(self.bytes, "big"), key=self.keys[i], digest_size=min(64, self.bytes)).digest(), "big") & ((1 << self.half) - 1)

    def forward(self, x: int) -> int:
        while True:
            left, right = x >> self.half, x & ((1 << self.half) - 1)
            for i in range(self.ROUNDS):
                left, right = right, left ^ self._mix(i, right)
            x = left << self.half | right
            if x < self.size:
                return x

    def backward(self, x: int) -> int:
        while True:
            left, right = x >> self.half, x & ((1 << self.half) - 1)
            for i in reversed(range(self.ROUNDS)):
                left, right = right ^ self._mix(i, left), left
            x = left << self.half | right
            if x < self.size:
                return x

    def moved(self, x: int) -> int:
        """Another permutation, one that leaves nothing in its place (if there is more than one number)."""
        if self.size < 2:
            return x
        step = 1 + int.from_bytes(self.keys[-1], "big") % (self.size - 1)
        return self.forward((self.backward(x) + step) % self.size)


_NUMBERS = ("phone", "id_number")


def _is_code(char: str) -> bool:
    return char.isalpha() or char.isdecimal()


def _alphabets(kind: str, written: str) -> tuple[str, list[tuple[str, str]]]:
    """(kept prefix, (character, the characters that may stand in its place) of the rest) of a number in lower case."""
    code = [c for c in unicodedata.normalize("NFC", normal_form(written)[0].lower()) if _is_code(c)]
    head = re.match(r"\+\d{1,2}|00\d{1,2}|\(0?|0", normal_form(written)[0]) if kind == "phone" else None
    kept = sum(map(_is_code, head.group())) if head else 0
    out = []
    for i, c in enumerate(code[kept:]):
        if c.isdecimal():
            zero = ord(c) - unicodedata.decimal(c)
            digits = "".join(chr(zero + d) for d in range(10))
            # the first digit of a telephone number behind its prefix tells its kind, and of ten the fourth begins the exchange
            tells = kind == "phone" and (i == 0 or i == 3 and len(code) - kept == 10)
            out.append((c, digits if not tells else digits[2:] if c in digits[2:] else digits[:2]))
        elif "a" <= c <= "z":
            # the last letter of an insurance number is one of four
            out.append((c, "abcd" if c in "abcd" and kept + i == len(code) - 1 else "abcdefghijklmnopqrstuvwxyz"))
        else:
            letters = _letters(_script(c)) if _script(c) not in _SYLLABLES else "".join(sorted({x.lower() for x in "".join(_SYLLABLES[_script(c)][0])}))
            out.append((c, letters if c in letters else c))
    return "".join(code[:kept]), out


def shape_of(kind: str, written: str) -> tuple[str, float]:
    """(shape, how many numbers have it) of a telephone or identity number."""
    prefix, rest = _alphabets(kind, written)
    size = 1.0
    for _, alphabet in rest:
        size *= len(alphabet)
    return f"{prefix}|" + "".join(a[0] if len(a) == 10 else f"[{a[0]}{len(a)}]" for _, a in rest), size


def _permuted(kind: str, written: str, attempt: int, secret: bytes, dense: bool) -> str:
    prefix, rest = _alphabets(kind, written)
    place = size = 0
    for i, (c, alphabet) in enumerate(rest):
        place = place * len(alphabet) + alphabet.index(c)
        size = (size if i else 1) * len(alphabet)
    if size < 2:
        return prefix + "".join(c for c, _ in rest)
    mixer = Permutation(secret, f"{kind}|{shape_of(kind, written)[0]}|{attempt}", size)
    place = mixer.moved(place) if dense else mixer.forward(place)
    out = []
    for _, alphabet in reversed(rest):
        place, at = divmod(place, len(alphabet))
        out.append(alphabet[at])
    return prefix + "".join(reversed(out))


def _cased(new: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if letters and all(c.isupper() for c in letters) and len(letters) > 1:
        return new.upper()
    if letters and all(c.islower() for c in letters):
        return new.lower()
    return new[:1].upper() + new[1:].lower()


def _syllables(draw: _Draw, n: int, like: str) -> str:
    """n syllables in the script of `like`; for scripts not in _SYLLABLES as many letters as it has, at least n - 1."""
    script = _script(like)
    if script not in _SYLLABLES and _letters(script):
        return "".join(draw.of(_letters(script)) for _ in range(max(n - 1, sum(map(str.isalpha, like)))))
    onsets, vowels, codas, _ = _SYLLABLES.get(script, _SYLLABLES["LATIN"])
    return "".join(draw.of(onsets).lower() + draw.of(vowels) + (draw.of(codas) if i == n - 1 else "") for i in range(n))


def _accented(new: str, like: str) -> str:
    """The accents of `like`, in order, on letters of `new` of the same kind (vowel or consonant) that can carry them."""
    decomposed = unicodedata.normalize("NFD", like)
    out, at = list(new), 0
    vowel = lambda c: unicodedata.normalize("NFD", c)[0].lower() in "aeiouyаеиоуαεηιουω"
    for i, mark in enumerate(decomposed):
        if not unicodedata.combining(mark):
            continue
        base = next((c for c in reversed(decomposed[:i]) if not unicodedata.combining(c)), "a")
        for k in range(at, len(out)):
            both = unicodedata.normalize("NFC", out[k] + mark)
            if len(both) == 1 and vowel(out[k]) == vowel(base):
                out[k], at = both, k + 1
                break
    return "".join(out)


_LETTER_RUN = re.compile(r"[^\W\d_]+")


def _surrogate_name(draw: _Draw, name: str, given: bool, gender: str | None, n: int) -> str:
    """A name like `name`: every run of letters replaced, hyphens and apostrophes kept."""
    runs = _LETTER_RUN.findall(name)

    def one(m: re.Match) -> str:
        old, script = m.group(), _script(m.group())
        if len(old) < 2 and script in _SYLLABLES:
            return _cased(draw.of(_SYLLABLES[script][3]), old)
        end = _FAMILY_ENDS.search(old) if not given and len(old) > 5 else None
        new = _syllables(draw, n, old)
        ends, female = _FEMALE.get(script, ("", ""))
        if given and (gender == "f" or gender is None and runs[0][-1].lower() in ends):
            new += female
        return _cased(_accented(new, old[: end.start()] if end else old) + (end.group() if end else ""), old)

    return _LETTER_RUN.sub(one, name)


def _digits(draw: _Draw, written: str) -> str:
    """Same format, other digits."""
    return "".join(chr(ord(c) - unicodedata.decimal(c) + draw.below(9) + 1) if c.isdecimal() else c for c in written)


def folded(text: str) -> str:
    """Letters and digits only, in lower case, without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if c.isalnum())


def _owner_parts(owner: tuple[str, str]) -> dict[str, str]:
    """What parts of an address can stand for in a person's name, and the same of the person's surrogate."""
    old, new = ([m.group() for m in _words("person", t)] for t in owner)
    if len(old) != len(new) or len(old) < 2:
        return {}
    parts = {folded(a): folded(b) for a, b in zip(old, new, strict=True) if len(folded(a)) > 1}
    first, last = (folded(old[0]), folded(new[0])), (folded("".join(old[1:])), folded("".join(new[1:])))
    parts[last[0]] = last[1]
    for a, b in ((first[0][:1], first[1][:1]), first):
        parts |= {a + last[0]: b + last[1], last[0] + a: last[1] + b}
    parts.setdefault(first[0][:1], first[1][:1])
    return parts


def _surrogate_email(draw: _Draw, secret: bytes, written: str, attempt: int, owner: tuple[str, str] | None) -> str:
    """Every run of letters and digits replaced, separators and the way of writing 'at' and 'dot' kept; a reserved domain."""
    m = EMAIL.fullmatch(normal_form(written)[0])
    if not m:
        return f"{_syllables(draw, 2 + attempt, '')}@{draw.of(['example.com', 'example.net', 'example.org'])}"
    known = _owner_parts(owner) if owner else {}

    def run(piece: re.Match) -> str:
        old = piece.group()
        if not old[0].isalpha():
            return "".join(str(draw.below(10)) for _ in old)
        new = known.get(folded(old)) or _syllables(draw, 2 + attempt // 2, old)
        return _cased(new, old if len(old) > 1 else m["local"])

    local = re.sub(r"[^\W\d_]+|\d+", run, m["local"])
    if known and attempt:
        local += "".join(str(draw.below(10)) for _ in range(attempt + 1))
    domain = m["d1"] or m["d2"] or m["d3"]
    at = m.group()[len(m["local"]) : len(m.group()) - len(domain)]
    dot = re.search(_DOT, domain, re.IGNORECASE).group()
    # the domain alone decides its surrogate, so all its addresses stay together; three syllables make two domains with one unlikely
    house = _syllables(_Draw(secret, "domain", folded(_OBFUSCATED_DOT.sub(".", domain))), 3, domain)
    return local + at + _cased(house, domain) + dot + _cased("example", domain)


def _surrogate_address(draw: _Draw, written: str, n: int) -> str:
    words = _WORDS["address"].findall(written)
    last = max((i for i, w in enumerate(words) if w[:1].isalpha()), default=0)
    # German: the only word carries the kind of street; else the last (English) or first (French) word does
    carrier = last if re.fullmatch(_STREET + r"\.?", words[last], re.IGNORECASE) else next((i for i, w in enumerate(words) if re.fullmatch(_FRENCH_WAY, w, re.IGNORECASE)), -1)
    kept = {i for i, w in enumerate(words) if i != carrier and re.sub(r"['’.].*", "", w.lower()) in _STREET_WORDS}
    names = [i for i, w in enumerate(words) if w[:1].isalpha() and i != carrier and i not in kept]
    if not names:  # 'De Road': then the particle is the name
        kept = set()
    out = []
    for i, w in enumerate(words):
        tail = re.search(f"(?:{_GERMAN_WAY}|{_GERMAN_PLACE})$", w, re.IGNORECASE) if carrier < 0 else None
        if any(c.isdigit() for c in w):
            out.append(_digits(draw, w))
        elif i == carrier or (i in kept and "'" not in w) or w.lower() in ("bis", "ter", "quater"):
            out.append(w)
        elif i in kept:  # d'Oak, l'Oak
            article, rest = w.split("'", 1)
            out.append(f"{article}'{_cased(_accented(_syllables(draw, n, rest), rest), rest)}" if rest else w)
        else:
            out.append(_cased(_accented(_syllables(draw, n, w), w[: tail.start()] if tail else w) + (tail.group().lower() if tail else ""), w))
    return _refilled("address", written, out)


def surrogate(kind: str, key: str, written: str, attempt: int, secret: bytes, gender: str | None = None, owner: tuple[str, str] | None = None, dense: bool = False) -> str:
    """A replacement of the same type and format, decided by the secret, the entity and the attempt.

    owner: the written form and the surrogate of the person an e-mail address is named for.
    """
    draw = _Draw(secret, kind, key, attempt)
    written = normal_form(written)[0]
    if kind == "email":
        return _surrogate_email(draw, secret, written, attempt, owner)
    if kind in _NUMBERS:
        return rendered(kind, _permuted(kind, written, attempt, secret, dense), written)
    size = 2 + attempt // 2  # the room grows with every second attempt
    if kind == "address":
        return _surrogate_address(draw, written, size)
    names = [m.group() for m in _words(kind, written)]
    # the first of the given names, which come first unless the name is turned
    new = [p if i and p.lower() in _PARTICLES else _surrogate_name(draw, p, i == 0, gender, size) for i, p in enumerate(names)]
    return _refilled(kind, written, new)


#: What is replaced as one word; all between them stays as written.
_WORDS = {"person": re.compile(r"[^\s,.]+"), "address": re.compile(r"[^\s,]+"), "email": re.compile(r"[^\W\d_]+|\d+")}
_NUMBERED = re.compile(r" #\d+\Z")


def _words(kind: str, text: str) -> list[re.Match]:
    """The words of a text; those of a turned name ('Family, Given') with the given names first."""
    found = list(_WORDS[kind].finditer(text))
    comma = text.find(",") if kind == "person" else -1
    return [m for m in found if m.start() > comma] + [m for m in found if m.start() < comma]


def _refilled(kind: str, text: str, new: list[str]) -> str:
    """The text with its words, in the order of _words, replaced by `new`."""
    return _replaced(text, sorted((m.start(), m.end(), w) for m, w in zip(_words(kind, text), new, strict=True)))


def _like(new: str, old: str) -> str:
    """`new` in the letter case of `old`; character by character where digits are in it."""
    if any(c.isdigit() for c in new):
        return "".join(c.upper() if o.isupper() else c.lower() if o.islower() else c for c, o in zip(new, old, strict=True)) if len(new) == len(old) else new
    return _cased(new, old)


def _initialled(fresh: list[str], were: list[str], chosen: str) -> list[str] | None:
    """The words of a person's surrogate for a mention by initials: as many of them, the first from the given name."""
    n = next((i for i, w in enumerate(were) if len(w) > 1), len(were))
    if not n or len(fresh) < 2 or len(fresh[0]) < 2 or len(fresh) - 1 != len(were) - n:
        return None
    drawn = [fresh[0][0]] + [_Draw(chosen.encode(), i).of(_SYLLABLES.get(_script(fresh[0]), _SYLLABLES["LATIN"])[3]) for i in range(1, n)]
    return drawn + fresh[1:]


def rendered(kind: str, chosen: str, written: str) -> str:
    """The chosen surrogate in the letter case and format of one mention of its entity."""
    plain = normal_form(written)[0]
    number = _NUMBERED.search(chosen)
    base, tail = (chosen[: number.start()], number.group()) if number else (chosen, "")
    if kind in _NUMBERS:
        fresh, places = [c for c in base if _is_code(c)], [i for i, c in enumerate(plain) if _is_code(c)]
        if len(fresh) != len(places):
            return chosen
        return _replaced(plain, [(i, i + 1, _like(c, plain[i])) for i, c in zip(places, fresh, strict=True)]) + tail
    if kind == "email":
        old, new = EMAIL.fullmatch(plain), EMAIL.fullmatch(base)
        if not old or not new:
            return chosen
        words = _WORDS[kind].findall(new["local"])
        were = _WORDS[kind].findall(old["local"])
        domain, label = (m["d1"] or m["d2"] or m["d3"] for m in (old, new))
        if len(words) == len(were):
            local = _refilled(kind, old["local"], [_cased(n, o if len(o) > 1 else old["local"]) if n.isalpha() else n for n, o in zip(words, were, strict=True)])
        else:
            local = _cased(new["local"], old["local"]) if old["local"].isupper() or old["local"].islower() else new["local"]
        at = plain[len(old["local"]) : len(plain) - len(domain)]
        dot = re.search(_DOT, domain, re.IGNORECASE).group()
        return local + at + _cased(re.split(_DOT, label, flags=re.IGNORECASE)[0], domain) + dot + _cased("example", domain) + tail
    fresh, were = ([m.group() for m in _words(kind, t)] for t in (base, plain))
    if kind == "person" and were and len(were[0]) == 1:
        fresh = _initialled(fresh, were, base) or fresh
    if len(fresh) != len(were):
        return chosen
    return _refilled(kind, plain, [_like(n, o) for n, o in zip(fresh, were, strict=True)]) + tail


def _shown() -> Column:
    @F.pandas_udf("string")
    def shown(kind: pd.Series, chosen: pd.Series, written: pd.Series) -> pd.Series:
        return pd.Series([rendered(a, b, c) for a, b, c in zip(kind, chosen, written, strict=True)], dtype=object)

    return shown("pii_type", "surrogate", "written")


# --- who is meant ---------------------------------------------------------
def _spelled_in(address: str) -> list[dict]:
    """What an e-mail address may spell: (a: given name or its initial, b: family name), likeliest first."""
    m = EMAIL.fullmatch(normal_form(address)[0])
    parts = [folded(p) for p in re.findall(r"[^\W\d_]+", m["local"].split("+")[0])] if m else []
    pairs = []
    if len(parts) > 1:
        pairs = [(parts[0], "".join(parts[1:])), ("".join(parts[1:]), parts[0]), (parts[-1], "".join(parts[:-1]))]
    elif parts and len(parts[0]) > 3:
        pairs = [(parts[0][0], parts[0][1:]), (parts[0][-1], parts[0][:-1])]
    return [{"a": a, "b": b, "place": i} for i, (a, b) in enumerate(dict.fromkeys(pairs))]


def _names_in_address(written: str) -> Column:
    @F.pandas_udf("array<struct<a: string, b: string, place: int>>")
    def names(texts: pd.Series) -> pd.Series:
        return pd.Series([_spelled_in(t) for t in texts], dtype=object)

    return names(written)


def _folded_column(text: str | Column) -> Column:
    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return pd.Series([folded(t) if t is not None else None for t in texts], dtype=object)

    return fold(text)


def with_entity(found: DataFrame) -> DataFrame:
    """found plus `entity_key`: whom a mention means. Initials with a family name are the one person of that name in the text, else in all texts."""
    is_short = (F.col("pii_type") == "person") & F.col("initials")
    family = F.substr("pii_key", F.length("given_key") + 1)
    named = found.withColumn("family_key", F.when(F.col("pii_type") == "person", family)).withColumn("letter", F.substring("given_key", 1, 1))
    full = named.where((F.col("pii_type") == "person") & ~F.col("initials"))

    def only(keys: list[str], name: str) -> DataFrame:
        """The person of each group that has exactly one."""
        return full.groupBy(*keys).agg(F.min("pii_key").alias(name), F.max("pii_key").alias("__max")).where(F.col(name) == F.col("__max")).drop("__max")

    near = named.where(is_short).join(only(["row_id", "family_key", "letter"], "__near"), ["row_id", "family_key", "letter"], "left")
    # one name may stand in a third of all texts
    short = lookup_salted(near, only(["family_key", "letter"], "__far"), ["family_key", "letter"], SALTS)
    rest = named.where(~is_short).withColumn("entity_key", F.col("pii_key"))
    columns = [*found.columns, "entity_key"]
    return short.withColumn("entity_key", F.coalesce("__near", "__far", "pii_key")).select(*columns).unionByName(rest.select(*columns))


def _owners(mentions: DataFrame, persons: DataFrame) -> DataFrame:
    """(pii_key, owner): e-mail addresses that spell the name of exactly one person."""
    addresses = mentions.where("pii_type = 'email'").groupBy("pii_key").agg(F.min("written").alias("written"))
    wanted = addresses.select("pii_key", F.explode(_names_in_address("written")).alias("x")).select("pii_key", "x.*")
    family = F.substr("pii_key", F.length("given_key") + 1)
    people = persons.select(F.col("pii_key").alias("owner"), _folded_column("given_key").alias("a"), _folded_column(family).alias("b"))

    def only(df: DataFrame) -> DataFrame:
        return df.groupBy("a", "b").agg(F.min("owner").alias("owner"), F.max("owner").alias("__max")).where("owner = __max").drop("__max")

    whole = only(people)
    by_letter = only(people.withColumn("a", F.substring("a", 1, 1)))
    hits = wanted.join(whole, ["a", "b"]).unionByName(wanted.where(F.length("a") == 1).join(by_letter, ["a", "b"]))
    return hits.groupBy("pii_key").agg(F.min_by("owner", F.struct("place", "owner")).alias("owner"))


# --- surrogates of all entities -------------------------------------------
def _drawn(attempt: int, secret: bytes) -> Column:
    @F.pandas_udf("string")
    def drawn(kind: pd.Series, key: pd.Series, written: pd.Series, gender: pd.Series, dense: pd.Series, owner_was: pd.Series, owner_is: pd.Series) -> pd.Series:
        rows = zip(kind, key, written, gender, dense, owner_was, owner_is, strict=True)
        return pd.Series([surrogate(k, i, w, attempt, secret, g, (a, b) if a and b else None, bool(d)) for k, i, w, g, d, a, b in rows], dtype=object)

    return drawn("pii_type", "entity_key", "written", "gender", "dense", "owner_was", "owner_is")


def _in_rounds(open_: DataFrame, real: DataFrame, secret: bytes, rounds: int) -> DataFrame:
    """open_ plus `surrogate`, no two of one type alike.

    In each round the entities without a surrogate draw one; of those that drew
    the same, or one that is a real entity or already given, only the first key
    (if free) keeps it.
    """
    done = None
    # keys have the given names first, so a turned name is compared that way
    straight = F.when(F.col("pii_type") == "person", F.regexp_replace("surrogate", r"(?s)^([^,]*),(.*)$", "$2$1")).otherwise(F.col("surrogate"))
    for attempt in range(rounds):
        drawn = open_.withColumn("surrogate", _drawn(attempt, secret)).withColumn("s_key", F.lower(F.regexp_replace(straight, r"[^\p{L}\p{Nd}]", "")))
        # numbers of a dense shape may be real ones
        free = drawn.withColumn("r_key", F.when(~F.col("dense"), F.col("s_key"))).join(real, ["pii_type", "r_key"], "left_anti")
        if done is not None:
            free = free.join(done.select("pii_type", "s_key"), ["pii_type", "s_key"], "left_anti")
        kept = materialise(free.withColumn("r", F.row_number().over(Window.partitionBy("pii_type", "s_key").orderBy("entity_key"))).where("r = 1").drop("r", "r_key"))
        done = kept if done is None else done.unionByName(kept)
        open_ = materialise(open_.join(kept.select("pii_type", "entity_key"), ["pii_type", "entity_key"], "left_anti"))
        if open_.isEmpty():
            return done.drop("s_key")
    rest = open_.withColumn("surrogate", _drawn(rounds, secret)).withColumn("r", F.row_number().over(Window.partitionBy("pii_type", "surrogate").orderBy("entity_key")))
    numbered = rest.withColumn("surrogate", F.concat_ws(" ", "surrogate", F.concat(F.lit("#"), F.col("r").cast("string")))).drop("r")
    return numbered if done is None else done.drop("s_key").unionByName(numbered)


def surrogates(mentions: DataFrame, secret: bytes, rounds: int = ROUNDS) -> DataFrame:
    """(pii_type, entity_key, written, surrogate), one row per distinct entity of the mentions (see `with_entity`)."""
    # written in full before initials, without a comma before with one: the given names come first
    best = F.min(F.struct((F.col("entity_key") != F.col("pii_key")).alias("other"), F.contains("written", F.lit(",")).alias("turned"), "written", "given_key")).alias("w")
    votes = F.sum(F.when(F.col("gender") == "f", 1).when(F.col("gender") == "m", -1))
    grouped = mentions.groupBy("pii_type", "entity_key").agg(best, votes.alias("votes"), F.bool_and("initials").alias("initials"))
    gender = F.when(F.col("votes") > 0, "f").when(F.col("votes") < 0, "m")

    @F.pandas_udf("struct<shape: string, size: double>")
    def shaped(kind: pd.Series, written: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shape_of(k, w) if k in _NUMBERS else (None, None) for k, w in zip(kind, written, strict=True)], columns=["shape", "size"])

    entities = materialise(grouped.select("pii_type", "entity_key", "w.written", "w.given_key", gender.alias("gender"), "initials", shaped("pii_type", "w.written").alias("x")))
    counts = entities.where("x.shape IS NOT NULL").groupBy("pii_type", F.col("x.shape").alias("shape")).agg((F.count("*") * DENSE > F.max("x.size")).alias("dense"))
    flagged = entities.withColumn("shape", F.col("x.shape")).join(counts, ["pii_type", "shape"], "left").withColumn("dense", F.coalesce("dense", F.lit(False))).drop("x", "shape")
    real = materialise(mentions.select("pii_type", F.col("pii_key").alias("r_key")).distinct())
    no_owner = [F.lit(None).cast("string").alias("owner_was"), F.lit(None).cast("string").alias("owner_is")]
    columns = ["pii_type", "entity_key", "written", "gender", "dense"]
    first = _in_rounds(flagged.where("pii_type <> 'email'").select(*columns, *no_owner), real, secret, rounds)
    # addresses come after the persons they are named for
    persons = entities.where("pii_type = 'person' AND NOT initials").select(F.col("entity_key").alias("pii_key"), "given_key")
    named = first.where("pii_type = 'person'").select(F.col("entity_key").alias("owner"), F.col("written").alias("owner_was"), F.col("surrogate").alias("owner_is"))
    owned = _owners(mentions, persons).join(named, "owner").select(F.col("pii_key").alias("entity_key"), "owner_was", "owner_is")
    second = _in_rounds(flagged.where("pii_type = 'email'").select(*columns).join(owned, "entity_key", "left").select(*columns, "owner_was", "owner_is"), real, secret, rounds)
    out = ["pii_type", "entity_key", "written", "surrogate"]
    return first.select(*out).unionByName(second.select(*out))


def pseudonymise(rows: DataFrame, row_id: Column, text: Column, people: Directory, secret: bytes) -> DataFrame:
    """(row_id, start_at, end_at, pii_type, pii_key, entity_key, written, surrogate, shown), one row per finding.

    `surrogate` is the entity's, `shown` the same in the mention's own case and
    format. The findings are written once to the checkpoint folder, so detection -
    the dear part - runs over the texts a single time. row_id may be a struct.
    """
    mentions = materialise(with_entity(materialise(detect(rows, row_id, text, people))))
    named = surrogates(mentions, secret).select("pii_type", "entity_key", "surrogate")
    columns = ["row_id", "start_at", "end_at", "pii_type", "pii_key", "entity_key", "written", "surrogate"]
    return lookup_salted(mentions, named, ["pii_type", "entity_key"], SALTS, how="inner").select(*columns, _shown().alias("shown"))


def replace_spans(text: Column, spans: Column) -> Column:
    """The text with each span's `new` in its place; spans: array<struct<start_at, end_at, new>>, never overlapping."""

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or x is None else _replaced(t, sorted((s["start_at"], s["end_at"], s["new"]) for s in x)) for t, x in zip(texts, found, strict=True)], dtype=object)

    return replaced(text, spans)
