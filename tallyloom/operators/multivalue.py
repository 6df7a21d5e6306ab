r"""Cells that hold several values: infer the delimiters of a source, split, explode.

A source is one column. Its delimiters are chosen among CANDIDATES by two
figures taken over every cell of the source:

* piece-count consistency - of the cells a candidate occurs in, the share it
  cuts into two or more pieces that hold something, as many as all candidates
  in play cut together: by whichever of them the cell is read, the count agrees;
* piece type regularity - of the pieces it yields, the share whose type (known
  name, link, code such as ABC-12, word) also occurs as a whole single-valued
  cell of that source.

Quoted values, known names, links and escaped characters are opaque to both the
scoring and the split, so 'Read; Write; Delete' stays one value if it is quoted
or named in the dictionary. All sources are scored in one pass and each pass
drops what fails; the decision is one row per source and candidate. The split
itself is a regular expression inside the scan stage. Cells with too many quotes
and escapes for its bound are read by the same expression without one in an
Arrow batch function; a source without such cells starts no Python.

A dictionary of up to PATTERN_NAMES names is part of the expression. Of a larger
one, of any size, each cell gets just the names whose longest word it holds, by a
join, and is read in Python, with the same result.

Defined results: a null or blank cell gives no row; blank pieces are skipped
and not counted; a cell wrapped in [ ] is read as a JSON array of strings;
repeated rows give repeated rows (callers choose distinct).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.normal import resolve_entities

#: Candidate delimiters as (name, characters inside a regex class).
CANDIDATES = (("newline", r"\r\n"), ("tab", r"\t"), ("semicolon", ";"), ("pipe", "|"), ("comma", ","), ("slash", "/"), ("blank", r" \u00a0"))
#: The same characters as they are.
CHARACTERS = {"newline": "\r\n", "tab": "\t", "semicolon": ";", "pipe": "|", "comma": ",", "slash": "/", "blank": " \u00a0"}
#: Largest dictionary of names that is put into one pattern; names of a larger one are joined.
PATTERN_NAMES = 1_000
LINK = r"[A-Za-z][A-Za-z0-9+.]*://[^\s,;|\"'“”<>]+"
MASK = "\ue000"
BLANKS = " \t\r\n\u00a0\u200b\ufeff"
#: Steps inside one value that the JVM's matcher may take; cells that might need more are read in Python.
NESTED = 1000
MIN_REGULARITY, MIN_CONSISTENCY = 0.8, 0.3


@dataclass(frozen=True)
class Source:
    """A column to split: the table it is in, its known names (as a frame with the column `name` if they are many)."""

    table: str
    field: str
    known: tuple[str, ...] = ()
    names: DataFrame | None = None


def known_names(df: DataFrame, column: str, limit: int = PATTERN_NAMES) -> dict[str, object]:
    """The distinct names of a dictionary table as arguments of a Source: a tuple of up to `limit`, else a frame.

    A name without a letter or digit is no name.
    """
    names = df.select(F.col(column).alias("name")).where(F.col("name").rlike(r"[\p{L}\p{N}]")).distinct()
    rows = names.limit(limit + 1).collect()
    return {"names": names} if len(rows) > limit else {"known": tuple(sorted(r.name for r in rows))}


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _with_names(cells: DataFrame, source: Source) -> DataFrame:
    """cells plus `__names`: the names of a large dictionary that each cell may hold; unchanged for a small one.

    Distinct words of distinct cells meet the longest word of every name, so a
    hot cell travels once.
    """
    if source.names is None:
        return cells
    first = F.array_sort(_words(F.col("name")), lambda a, b: F.length(b) - F.length(a))[0]
    by_word = source.names.select("name", first.alias("word"))
    keyed = cells.withColumn("__h", F.xxhash64("cell"))
    words = keyed.select("__h", F.explode(F.array_distinct(_words(_cell(F.col("cell"))))).alias("word")).distinct()
    held = words.join(by_word, "word").groupBy("__h").agg(F.collect_set("name").alias("__names"))
    return keyed.join(held, "__h", "left").drop("__h").withColumn("__names", F.coalesce("__names", F.array().cast("array<string>")))


@lru_cache(maxsize=4096)
def _known_pattern(names: tuple[str, ...]) -> str | None:
    """Names that aren't plain words, longest first; blanks and escapes may vary."""
    forms = []
    for name in sorted({n.strip() for n in names}, key=lambda n: (-len(n), n)):
        if re.fullmatch(r"\w+", name):
            continue
        out = []
        for char in name:
            if char.isspace():
                out.append(r"[ \u00a0]+")
            elif char.isalnum():
                out.append(char)
            else:
                out.append(r"\\?" + ("['’]" if char == "'" else re.escape(char)))
        forms.append("".join(out))
    return "(?:" + "|".join(forms) + ")" if forms else None


def _opaque(known: str | None, ends: str) -> list[str]:
    """Alternatives that are read as one value, each up to a delimiter or the end."""
    after = rf"(?=[\s\u00a0]*(?:{ends}|$))"
    parts = [
        rf'"(?:[^"\\]++|\\.|""){{0,{NESTED}}}+"{after}',
        rf"'(?:[^']++|'(?![\s\u00a0]*(?:{ends}|$))){{0,{NESTED}}}+'{after}",
        rf"“[^”]*”{after}",
    ]
    if known:
        parts.append(rf"(?i:{known}){after}")
    parts.append(LINK)
    return parts


def _is_long(cell: Column) -> Column:
    """Whether a cell as written may need more than NESTED steps: a quote, escape or entity takes two, and one is left over."""
    return F.length(cell) - F.length(F.translate(cell, "\"'\\&", "")) > (NESTED - 1) // 2


def has_long(cells: DataFrame) -> bool:
    """Whether a cell of the column `cell` has to be read in Python."""
    return not cells.where(_is_long(F.col("cell"))).isEmpty()


#: An escaped character as the JVM reads it, where a dot is no end of a line.
_ESCAPED = r"\\[^\n\r\u0085\u2028\u2029]"


@lru_cache(maxsize=4096)
def _long_patterns(known: str | None, chars: str, split: bool) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """The expression for long cells, the same without single quotes, and a closing single quote."""
    ends = f"[{chars}]"
    parts = [p.replace(f"{{0,{NESTED}}}+", "*+").replace(r"\\.|", _ESCAPED + "|") for p in _opaque(known, ends)]
    rest = [rf"(?:[^{chars}\\]++|{_ESCAPED})++", r"\\"] if split else []
    before = r"(?<![\s\u00a0])[\s\u00a0]*+" if split else ""
    both = [re.compile(before + "(" + "|".join(x + rest) + ")", re.ASCII) for x in (parts, [parts[0], *parts[2:]])]
    return *both, re.compile(rf"'(?=[\s\u00a0]*(?:{ends}|$))", re.ASCII)


def _long_matches(text: str, known: str | None, chars: str, split: bool) -> Iterator[re.Match]:
    """Matches in a long cell; behind its last closing single quote none is searched for, so the time stays linear."""
    full, unquoted, closing = _long_patterns(known, chars, split)
    last = max((m.start() for m in closing.finditer(text)), default=-1)
    at = 0
    while m := (full if at < last else unquoted).search(text, at):
        yield m
        at = m.end()


def _bare(piece: str) -> str:
    piece = piece.strip(BLANKS)
    if len(piece) > 1 and piece[0] == piece[-1] == '"':
        piece = piece[1:-1].replace('""', '"')
    else:
        for first, final in ("''", "“”"):
            if len(piece) > 1 and piece[0] == first and piece[-1] == final:
                piece = piece[1:-1]
    return re.sub(r"\\(.)", r"\1", piece, flags=re.DOTALL).strip(BLANKS)


def _pattern_of(known: str | None, names: Iterable[str] | None) -> str | None:
    return known if names is None else _known_pattern(tuple(sorted(names)))


def _long_values(text: Column, source: Source, chars: str) -> Column:
    """What values_of gives, for cells of any number of quotes and escapes; null for null."""
    known = _known_pattern(source.known)

    @F.pandas_udf("array<string>")
    def values(cells: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else [v for m in _long_matches(c, _pattern_of(known, n), chars, True) if (v := _bare(m[1]))] for c, n in zip(cells, names, strict=True)], dtype=object)

    return values(text, _names_column(source))


def _long_masked(text: Column, source: Source, chars: str) -> Column:
    """The cell with every opaque value masked, for cells of any number of quotes and escapes; null for null."""
    known = _known_pattern(source.known)

    def one(cell: str, known: str | None) -> str:
        out, at = [], 0
        for m in _long_matches(cell, known, chars, False):
            out += (cell[at : m.start()], MASK)
            at = m.end()
        return "".join(out) + cell[at:]

    @F.pandas_udf("string")
    def masked(cells: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else one(c, _pattern_of(known, n)) for c, n in zip(cells, names, strict=True)], dtype=object)

    return masked(text, _names_column(source))


def _names_column(source: Source) -> Column:
    return F.lit(None).cast("array<string>") if source.names is None else F.col("__names")


def _cell(column: Column) -> Column:
    text = resolve_entities(column)
    return F.regexp_replace(text, r"(?s)^\s*\[(.*)\]\s*$", "$1")


#: What stands for a piece of each kind in the shape of a cell.
KINDS = {"opaque": MASK, "code": "\ue001", "word": "\ue002", "other": "\ue003"}


def _shape(masked: Column, every: str) -> Column:
    """A cell with every run free of delimiters put as its kind: all that the scores depend on, and the same for most cells.

    every: the candidates' characters inside a regex class.
    """
    begin, end = f"(?<![^{every}])", f"(?![^{every}])"
    codes = F.regexp_replace(masked, rf"{begin}\p{{L}}++[-‐-―]\p{{Nd}}++{end}", KINDS["code"])
    words = F.regexp_replace(codes, rf"{begin}[\p{{L}}_][\p{{L}}\p{{Nd}}_]*+{end}", KINDS["word"])
    return F.regexp_replace(words, rf"{begin}(?![{MASK}-{KINDS['word']}]{end})[^{every}]++", KINDS["other"])


def _classes(names: tuple[str, ...]) -> str:
    return "".join(chars for name, chars in CANDIDATES if name in names)


def score_delimiters(cells: DataFrame, source: Source, names: tuple[str, ...] | None = None, long: bool | None = None) -> DataFrame:
    """(delimiter, cells, consistency, regularity) of each candidate over all cells.

    cells has one string column, `cell`. Candidates that never occur are absent.
    regularity is null where no piece is free of other candidates. Without any
    single-valued cell, known names, codes and words count as regular.
    """
    candidates = tuple((n, c) for n, c in CANDIDATES if names is None or n in names)
    every = "".join(chars for _, chars in candidates)
    cells, cell = _with_names(cells.select("cell"), source), F.col("cell")
    if source.names is not None:
        whole = _long_masked(_cell(cell), source, every)
    else:
        opaque = "|".join(_opaque(_known_pattern(source.known), f"[{every}]"))
        whole = F.regexp_replace(_cell(cell), opaque, MASK)
        if has_long(cells) if long is None else long:
            of_long = _long_masked(F.when(_is_long(cell), _cell(cell)), source, every)
            whole = F.coalesce(of_long, F.when(~_is_long(cell), whole))
    masked = cells.select(F.regexp_replace(whole, r"\\.", MASK).alias("m"))
    masked = masked.where("trim(m) <> ''").select(F.trim("m").alias("m"))
    # scored once per shape, weighted by its cells
    shapes = masked.select(_shape(F.col("m"), every).alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    ends = F.lit("".join(CHARACTERS[n] for n, _ in candidates))
    single = F.btrim("m", ends)

    def pieces_by(chars: str) -> Column:
        return F.filter(F.transform(F.split("m", f"[{chars}]+"), lambda x: F.btrim(x, ends)), lambda x: x != "")

    def judged(chars: str) -> Column:
        pieces = pieces_by(chars)
        there = F.col("m").rlike(f"[{chars}]")
        return F.struct(
            there.alias("there"),
            (there & (F.size(pieces) >= 2)).alias("cuts"),
            (there & (F.size(pieces) >= 2) & (F.size(pieces) == F.col("every"))).alias("agrees"),
            pieces.alias("pieces"),
        )

    counted = shapes.select("m", "n", single.alias("single"), F.size(pieces_by(every)).alias("every"))
    scored = counted.select("n", "single", F.explode(F.array(*[F.struct(F.lit(n).alias("delimiter"), judged(c).alias("j")) for n, c in candidates])).alias("x"))
    kinds = tuple(KINDS)
    weighed = lambda cond, by=F.lit(1): F.sum(F.when(cond, F.col("n") * by).otherwise(0))

    def pieces_of(kind: str) -> Column:
        return weighed(F.col("x.j.cuts"), F.size(F.filter("x.j.pieces", lambda p: p == KINDS[kind])))

    one = scored.groupBy(F.col("x.delimiter").alias("delimiter")).agg(
        weighed(F.col("x.j.there")).alias("cells"),
        weighed(F.col("x.j.agrees")).alias("agreed"),
        *[pieces_of(k).alias(f"n_{k}") for k in kinds],
        *[weighed(F.col("single") == KINDS[k]).alias(f"s_{k}") for k in kinds],
    )
    singles = sum((F.col(f"s_{k}") for k in kinds), F.lit(0))
    seen = sum((F.when(F.col(f"s_{k}") > 0, F.col(f"n_{k}")).when((singles == 0) & F.lit(k != "other"), F.col(f"n_{k}")).otherwise(0) for k in kinds), F.lit(0))
    total = sum((F.col(f"n_{k}") for k in kinds), F.lit(0))
    return one.where("cells > 0").select("delimiter", "cells", (F.col("agreed") / F.col("cells")).alias("consistency"), F.when(total > 0, seen / total).alias("regularity"))


@dataclass(frozen=True)
class Evidence:
    """What one pass found about one candidate of one source."""

    source: Source
    pass_no: int
    delimiter: str
    cells: int
    consistency: float
    regularity: float | None
    chosen: bool


def infer_all(sources: Sequence[tuple[DataFrame, Source]], long: Sequence[bool] | None = None) -> tuple[list[tuple[str, ...]], list[Evidence]]:
    """The delimiters of each source, given with its cells, and the evidence of every pass.

    A pass scores all undecided sources in one job. Candidates whose pieces are
    irregular are dropped and the rest is scored anew, since what they cut up may
    be a value after all; then the least consistent one, if it is below the
    threshold. What is left when nothing is dropped is chosen: usually after one
    pass, after as many as candidates at most. A candidate no piece of which is
    free of the others is not chosen. A source without a cell gets every
    candidate but the slash.
    """
    long = list(long) if long is not None else any_long([c for c, _ in sources])
    names: list[tuple[str, ...]] = [tuple(n for n, _ in CANDIDATES)] * len(sources)
    chosen: dict[int, tuple[str, ...]] = {}
    evidence = []
    for pass_no in range(1, len(CANDIDATES) + 2):
        open_ = [i for i in range(len(sources)) if i not in chosen]
        if not open_:
            break
        frames = [score_delimiters(*sources[i], names[i], long[i]).select(F.lit(i).alias("i"), "*") for i in open_]
        found = reduce(DataFrame.unionByName, frames).collect()  # at most one row per source and candidate
        for i in open_:
            rows = {r.delimiter: r for r in found if r.i == i}
            dropped = {n for n, r in rows.items() if r.regularity is not None and r.regularity < MIN_REGULARITY}
            if not dropped:
                weak = sorted((r.consistency, n) for n, r in rows.items() if r.consistency < MIN_CONSISTENCY)
                dropped = {n for _, n in weak[:1]}
            kept = tuple(n for n in names[i] if n not in dropped)
            if not dropped or not kept:
                chosen[i] = tuple(n for n in kept if n in rows and rows[n].regularity is not None) if rows else tuple(n for n in names[i] if n != "slash")
            names[i] = kept
            evidence += [Evidence(sources[i][1], pass_no, n, r.cells, r.consistency, r.regularity, n in chosen.get(i, ())) for n, r in rows.items()]
    return [chosen[i] for i in range(len(sources))], evidence


def any_long(frames: Sequence[DataFrame]) -> list[bool]:
    """For each frame of cells whether one of them has to be read in Python; one job for all."""
    if not frames:
        return []
    flags = [f.agg(F.coalesce(F.max(_is_long(F.col("cell"))), F.lit(False)).alias("long")).select(F.lit(i).alias("i"), "long") for i, f in enumerate(frames)]
    found = {r.i: r.long for r in reduce(DataFrame.unionByName, flags).collect()}
    return [found[i] for i in range(len(frames))]


def infer_delimiters(cells: DataFrame, source: Source, long: bool | None = None) -> tuple[str, ...]:
    """Names of the candidates that separate the values of one source."""
    return infer_all([(cells, source)], None if long is None else [long])[0][0]


def values_of(column: Column, source: Source, delimiters: tuple[str, ...], long: bool = True) -> Column:
    """array<string> of the values of a cell in their order, blanks left out; long: whether some cell may be a long one.

    For a source with a large dictionary the row must have `__names` (see `_with_names`).
    """
    chars = _classes(delimiters)
    if source.names is not None:
        return _long_values(_cell(column), source, chars)
    opaque = "|".join(_opaque(_known_pattern(source.known), f"[{chars}]"))
    # a run of blanks is skipped from its start only, or long runs would be read again and again
    token = rf"(?<![\s\u00a0])[\s\u00a0]*+((?:{opaque})|(?:[^{chars}\\]++|\\.){{1,{NESTED}}}+|\\)"

    def cleaned(piece: Column) -> Column:
        bare = F.btrim(piece, F.lit(BLANKS))
        bare = F.when(bare.rlike(r'(?s)^".*"$') & (F.length(bare) > 1), F.replace(F.regexp_replace(bare, r'(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))).otherwise(
            F.regexp_replace(F.regexp_replace(bare, r"(?s)^'(.*)'$", "$1"), r"(?s)^“(.*)”$", "$1")
        )
        return F.btrim(F.regexp_replace(bare, r"(?s)\\(.)", "$1"), F.lit(BLANKS))

    usual = F.filter(F.transform(F.regexp_extract_all(_cell(column), F.lit(token), F.lit(1)), cleaned), lambda x: x != "")
    if not long:
        return usual
    return F.coalesce(_long_values(F.when(_is_long(column), _cell(column)), source, chars), F.when(~_is_long(column), usual))


def cells_of(df: DataFrame, row_id: Column, cell: Column) -> DataFrame:
    """(row_id, cell) of the cells that hold something."""
    return df.select(row_id.alias("row_id"), cell.alias("cell")).where(F.col("cell").isNotNull() & (F.trim("cell") != ""))


def split_all(sources: Sequence[tuple[DataFrame, Source]]) -> DataFrame:
    """(table_name, row_id, field_name, item_no, item_text) of several sources, each given with its cells (see `cells_of`)."""
    long = any_long([c for c, _ in sources])
    chosen, _ = infer_all(sources, long)
    return reduce(DataFrame.unionByName, [_split(c, s, d, x) for (c, s), d, x in zip(sources, chosen, long, strict=True)])


def split_values(df: DataFrame, source: Source, row_id: Column, cell: Column, delimiters: tuple[str, ...] | None = None) -> DataFrame:
    """(table_name, row_id, field_name, item_no, item_text), one row per value.

    Delimiters are inferred over the whole column unless given.
    """
    cells = cells_of(df, row_id, cell)
    return split_all([(cells, source)]) if delimiters is None else _split(cells, source, delimiters, has_long(cells))


def _split(cells: DataFrame, source: Source, delimiters: tuple[str, ...], long: bool) -> DataFrame:
    values = _with_names(cells, source).select("row_id", values_of(F.col("cell"), source, delimiters, long).alias("values"))
    return values.select("row_id", F.posexplode("values").alias("at", "item_text")).select(
        F.lit(source.table).alias("table_name"),
        "row_id",
        F.lit(source.field).alias("field_name"),
        (F.col("at") + 1).alias("item_no"),
        "item_text",
    )
