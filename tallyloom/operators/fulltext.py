"""Boolean full-text match over an inverted index, with rank.

Query grammar: terms, "phrases", prefix*, field:term, AND, OR, NOT and
brackets; terms side by side are joined by AND; NOT binds closest, then AND,
then OR. Terms are runs of letters and digits in lower case.

A query is evaluated field by field: a record matches if one of its fields alone
fulfils the whole expression, and a field without text never does. A term of
another field is false there.

The index is three tables, to be written once (`FullTextIndex`): the postings in
the order of their terms, each with the lengths of its record, so a search reads
those of its own terms and nothing else; the lengths of every record's fields, for
queries that hold without a term; and one row of totals.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


class QueryError(ValueError):
    """A query that the grammar doesn't allow."""


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]
    prefix: bool = False
    field: str | None = None


@dataclass(frozen=True)
class Node:
    kind: str  # and, or, not
    parts: tuple


_LEX = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|(?:(?P<field>[A-Za-z_]\w*)\s*:\s*)?(?:"(?P<phrase>[^"]*)"(?P<star2>\*?)|(?P<word>[^\s()"*:]+)(?P<star>\*?)))')


def words_of(text: str) -> tuple[str, ...]:
    """The terms of a piece of text in order."""
    return tuple(re.findall(r"[^\W_]+", text.lower()))


def parse(query: str) -> Term | Node:
    lexed, at = [], 0
    while at < len(query.rstrip()):
        m = _LEX.match(query, at)
        if not m or m.end() == at:
            raise QueryError(f"can't read the query at {query[at:at + 20]!r}")
        at = m.end()
        if m["open"] or m["close"]:
            lexed.append(m["open"] or m["close"])
        elif m["word"] in ("AND", "OR", "NOT") and not m["field"]:
            lexed.append(m["word"])
        else:
            words = words_of(m["phrase"] if m["phrase"] is not None else m["word"])
            if not words:
                raise QueryError("a term without a letter or digit")
            lexed.append(Term(words, bool(m["star"] or m["star2"]), m["field"]))
    if not lexed:
        raise QueryError("an empty query")
    node, rest = _either(lexed)
    if rest:
        raise QueryError(f"unexpected {rest[0]}")
    return node


def _either(lexed: list) -> tuple:
    node, rest = _both(lexed)
    parts = [node]
    while rest and rest[0] == "OR":
        node, rest = _both(rest[1:])
        parts.append(node)
    return (parts[0] if len(parts) == 1 else Node("or", tuple(parts))), rest


def _both(lexed: list) -> tuple:
    node, rest = _unit(lexed)
    parts = [node]
    while rest and rest[0] not in ("OR", ")"):
        node, rest = _unit(rest[1:] if rest[0] == "AND" else rest)
        parts.append(node)
    return (parts[0] if len(parts) == 1 else Node("and", tuple(parts))), rest


def _unit(lexed: list) -> tuple:
    if not lexed:
        raise QueryError("the query ends too soon")
    first, rest = lexed[0], lexed[1:]
    if first == "NOT":
        node, rest = _unit(rest)
        return Node("not", (node,)), rest
    if first == "(":
        node, rest = _either(rest)
        if not rest or rest[0] != ")":
            raise QueryError("a bracket is not closed")
        return node, rest[1:]
    if not isinstance(first, Term):
        raise QueryError(f"unexpected {first}")
    return first, rest


def terms_of(node: Term | Node) -> list[Term]:
    return [node] if isinstance(node, Term) else [t for p in node.parts for t in terms_of(p)]


@dataclass(frozen=True)
class FullTextIndex:
    """postings: (doc_id, field, term, tf, positions, lengths); lengths: (doc_id, n_<field> per field, its number of terms); totals: (records, the same columns summed), one row."""

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame
    fields: tuple[str, ...]


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "<.*?>", " ")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def postings(docs: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(doc_id, field, term, tf, positions, lengths) in the order of the terms; tags are stripped, texts without a term have no rows."""
    terms = docs.select(F.col(key).alias("doc_id"), *[F.coalesce(_terms(F.col(f)), F.array().cast("array<string>")).alias(f"t_{f}") for f in fields])
    each = terms.select("doc_id", F.struct(*[F.size(f"t_{f}").alias(f"n_{f}") for f in fields]).alias("lengths"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"t_{f}").alias("terms")) for f in fields])).alias("x"))
    words = each.select("doc_id", "lengths", "x.field", F.posexplode("x.terms").alias("at", "term"))
    found = words.groupBy("doc_id", "field", "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"), F.any_value("lengths").alias("lengths"))
    return found.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")


def lengths(docs: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(doc_id, ...): the number of terms in each field of every record, 0 for none."""
    return docs.select(F.col(key).alias("doc_id"), *[F.coalesce(F.size(_terms(F.col(f))), F.lit(0)).alias(f"n_{f}") for f in fields])


def totals(sizes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: how many records there are, and how many terms in each of their fields; sizes: `lengths`."""
    return sizes.agg(F.count("*").alias("records"), *[F.coalesce(F.sum(f"n_{f}"), F.lit(0)).alias(f"n_{f}") for f in fields])


def build_index(docs: DataFrame, key: str, fields: Sequence[str]) -> FullTextIndex:
    """The index of a frame, not written anywhere."""
    sizes = lengths(docs, key, fields)
    return FullTextIndex(postings(docs, key, fields), sizes, totals(sizes, fields), tuple(fields))


def _term_condition(t: Term) -> Column:
    last = t.words[-1]
    cond = F.startswith("term", F.lit(last)) if t.prefix else F.col("term") == last
    if len(t.words) > 1:
        cond = F.col("term").isin(*t.words[:-1]) | cond
    return cond & (F.col("field") == t.field) if t.field else cond


def _any_term(terms: Sequence[Term]) -> Column:
    """Whether a posting is one of some terms; single words as one list, which the files can be searched by."""
    plain = [t.words[0] for t in terms if len(t.words) == 1 and not t.prefix and not t.field]
    conds = [_term_condition(t) for t in terms if len(t.words) > 1 or t.prefix or t.field]
    return reduce(lambda a, b: a | b, [*([F.col("term").isin(*plain)] if plain else []), *conds], F.lit(False))


def _truth(node: Term | Node, of: Callable[[Term], bool]) -> bool:
    if isinstance(node, Term):
        return of(node)
    parts = [_truth(p, of) for p in node.parts]
    return not parts[0] if node.kind == "not" else all(parts) if node.kind == "and" else any(parts)


def matches(index: FullTextIndex, query: Term | Node, fields: Sequence[str] | None = None) -> DataFrame:
    """(doc_id) of the records that match in one of the fields (all by default).

    One pass over the postings of the query's terms. Only a query that holds
    where none of its terms stands (a bare NOT) looks at the other records.
    """
    fields = tuple(fields or index.fields)
    terms = terms_of(query)
    hits = index.postings.where(F.col("field").isin(*fields) & _any_term(terms))
    columns = []
    for i, t in enumerate(terms):
        at_home = (F.col("field") == t.field) if t.field else F.lit(True)
        for j, word in enumerate(t.words):
            cond = at_home & (F.startswith("term", F.lit(word)) if t.prefix and j == len(t.words) - 1 else F.col("term") == word)
            # places matter in phrases only
            columns.append((F.flatten(F.collect_list(F.when(cond, F.col("positions")))) if len(t.words) > 1 else F.bool_or(cond)).alias(f"p{i}_{j}"))
    per_field = hits.groupBy("doc_id", "field").agg(*columns)
    if _truth(query, lambda t: False):
        with_text = index.lengths.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("n")) for f in fields])).alias("x")).where("x.n > 0").select("doc_id", "x.field")
        per_field = with_text.join(per_field, ["doc_id", "field"], "left")
    numbers = {id(t): i for i, t in enumerate(terms)}

    def condition(node: Term | Node) -> Column:
        if isinstance(node, Term):
            i = numbers[id(node)]
            begins = F.col(f"p{i}_0")
            if len(node.words) == 1:
                return F.coalesce(begins, F.lit(False))
            for j in range(1, len(node.words)):
                begins = F.array_intersect(begins, _shifted(f"p{i}_{j}", j))
            return F.coalesce(F.size(begins) > 0, F.lit(False))
        parts = [condition(p) for p in node.parts]
        if node.kind == "not":
            return ~parts[0]
        return reduce((lambda a, b: a & b) if node.kind == "and" else (lambda a, b: a | b), parts)

    return per_field.where(condition(query)).select("doc_id").distinct()


def _shifted(column: str, by: int) -> Column:
    return F.transform(F.col(column), lambda x: x - by)


def ranked(index: FullTextIndex, query: Term | Node, fields: Sequence[str] | None = None, limit: int = 20, but: Column | None = None) -> DataFrame:
    """(doc_id, score, rank) of the best matches, best first, ties by id; `but`: doc_ids to leave out.

    The score is BM25 over the query's positive words with an IDF that is never
    negative.
    """
    fields = tuple(fields or index.fields)
    found = matches(index, query, fields)
    if but is not None:
        found = found.where(F.col("doc_id") != but)
    summed = lambda prefix: reduce(lambda a, b: a + b, [F.col(f"{prefix}n_{f}") for f in fields])
    total, average = index.totals.select("records").scalar(), index.totals.select(summed("") / F.col("records")).scalar()
    hits = index.postings.where(F.col("field").isin(*fields) & _any_term(_positive(query)))
    per = hits.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.any_value(summed("lengths.")).alias("length"))
    df = per.groupBy("term").agg(F.count("*").alias("df"))
    scored = per.join(df, "term").join(found, "doc_id", "left_semi")
    weight = F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    points = F.sum(weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / average)))
    every = found.join(scored.groupBy("doc_id").agg(F.round(points, 6).alias("score")), "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = every.orderBy(F.col("score").desc(), "doc_id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id")))


def search(docs: DataFrame, key: str, fields: Sequence[str], query: str, limit: int = 20, index: FullTextIndex | None = None) -> DataFrame:
    """The best matches: all columns of docs plus `score` and `rank`; without an index the frame is indexed first."""
    best = ranked(index or build_index(docs, key, fields), parse(query), fields, limit)
    return docs.join(best.withColumnRenamed("doc_id", key), key)


def _positive(node: Term | Node) -> list[Term]:
    if isinstance(node, Term):
        return [node]
    return [] if node.kind == "not" else [t for p in node.parts for t in _positive(p)]
