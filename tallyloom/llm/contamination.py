"""Held-out test items that leak into corpus documents, by greedy string tiling.

Both sides become words: runs of letters and digits in lower case, with tags,
character entities and invisible characters gone. Every window of `min_match`
words has a running Karp-Rabin value; document windows whose value is among the
items' windows are the seeds (checked word by word, so equal values never
decide). For each document and item that share a seed, the longest common run
is marked, then the longest that overlaps no marked word, and so on; the tiles
found cover passages in any order, and their sum over the item's length is the
item's coverage.

Up to BLOCK_WORDS words of items are an index that is sent to the executors, and
one pass over the corpus does it all: words outside the items' vocabulary cut a
document into short stretches at once. A larger set, of any size, is met by a
hash join: of each document's windows of half the length the least value of
every stretch travels (winnowing; a common run of `min_match` words always holds
one of them), only with pairs that share one are texts compared. Both ways read
the corpus without a bound on items, and give the same rows.

A text that repeats itself has as many seeds as the product of both lengths; a
document with more than HEAVY seeds a word is tiled without them (`tiles_linear`):
the longest common run is found by bisection over the windows' values, in memory
that grows with the texts alone.

Defined results: null and empty texts, items shorter than min_match and an
empty side give no rows; repeated rows of a document are one document; all
occurrences count, whole texts are read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_MATCH = 12
BLOCK_WORDS = 2_000_000
#: Seeds a word of a document beyond which it is tiled without listing them.
HEAVY = 8
BASE = np.uint64(0x9E3779B97F4A7C15)

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
#: Tags inside a line join what they part; all others part it.
_INLINE = re.compile(r"</?(?:a|abbr|b|big|cite|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strike|strong|sub|sup|tt|u|var|wbr)(?:\s[^<>]*)?/?>", re.IGNORECASE)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_MACRO = re.compile(r"\{/?(?:color|quote|panel|noformat|code|anchor|bgcolor|font)(?::[^{}]*)?\}", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")


def _without_comments(text: str) -> str:
    """HTML comments replaced by a blank; one that is never closed stays."""
    first, *rest = text.split("<!--")
    return first + "".join(" " + r.partition("-->")[2] if "-->" in r else r for r in rest)


def words_of(text: str | None) -> list[str]:
    """The words of a text as the comparison sees them."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        if "<!--" in text:
            text = _without_comments(text)
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "{" in text:
        text = _MACRO.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text))
    return _WORD.findall(text.lower())


def rolling(codes: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin value of every window of `length` codes, modulo 2**64."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * BASE + codes[k : k + n]
    return out


class ItemIndex:
    """Windows of a block of items by their value."""

    def __init__(self, items: list[tuple[object, str]], min_match: int) -> None:
        self.min_match = min_match
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[object, np.ndarray]] = []
        hashes, numbers, places = [], [], []
        for item_id, text in items:
            words = words_of(text)
            if len(words) < min_match:
                continue
            codes = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            values = rolling(codes, min_match)
            hashes.append(values)
            numbers.append(np.full(len(values), len(self.items)))
            places.append(np.arange(len(values)))
            self.items.append((item_id, codes))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        values = join(hashes, np.uint64)
        order = np.argsort(values, kind="stable")
        self.values, self.numbers, self.places = values[order], join(numbers, np.int64)[order], join(places, np.int64)[order]

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document place, first entry, entries) of the windows whose value is among the items'."""
        length = self.min_match
        empty = np.zeros(0, np.int64)
        if not len(self.values) or len(codes) < length:
            return empty, empty, empty
        known = np.concatenate(([0], np.cumsum(codes != 0)))
        full = np.flatnonzero(known[length:] - known[:-length] == length)
        if not len(full):
            return empty, empty, empty
        values = np.zeros(len(full), np.uint64)
        for k in range(length):
            values = values * BASE + codes[full + k]
        first = np.searchsorted(self.values, values, "left")
        count = np.searchsorted(self.values, values, "right") - first
        return full[count > 0], first[count > 0], count[count > 0]

    def seeds(self, full: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document place, item number, item place) of all entries of some hits."""
        at = np.repeat(full, count)
        which = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return at, self.numbers[which], self.places[which]

    def numbers_of(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The items that some hits belong to, each value looked up once."""
        once, where = np.unique(first, return_index=True)
        return np.unique(np.concatenate([self.numbers[f : f + n] for f, n in zip(once, count[where], strict=True)])) if len(once) else once


def tiles(doc: np.ndarray, item: np.ndarray, at: np.ndarray, place: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seeds: (document place, item place, length), longest first, ties by place."""
    equal = np.ones(len(at), bool)
    for k in range(min_match):
        equal &= doc[at + k] == item[place + k]
    at, place, out = at[equal], place[equal], []
    while len(at):
        # seeds that follow each other on a diagonal are one run
        order = np.lexsort((at, at - place))
        a, p = at[order], place[order]
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 1) | (np.diff(a - p) != 0))))
        lengths = np.diff(np.concatenate((starts, [len(a)]))) + min_match - 1
        best = min(range(len(starts)), key=lambda i: (-lengths[i], a[starts[i]], p[starts[i]])) if len(starts) < 50 else int(np.lexsort((p[starts], a[starts], -lengths))[0])
        i, j, n = int(a[starts[best]]), int(p[starts[best]]), int(lengths[best])
        out.append((i, j, n))
        free = ((at + min_match <= i) | (at >= i + n)) & ((place + min_match <= j) | (place >= j + n))
        at, place = at[free], place[free]
    return out


_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(0, n - 1), base, np.uint64))))[:n]


class _Side:
    """Words of one text with the marks of those in tiles; code 0 is no word of the other side."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.free = codes, codes != 0
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * _powers(BASE, len(codes)), dtype=np.uint64)))
        self.back = _powers(_INVERSE, len(codes))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, value) of the windows without a mark."""
        known = np.concatenate(([0], np.cumsum(self.free)))
        at = np.flatnonzero(known[length:] - known[:-length] == length) if len(self.codes) >= length else np.zeros(0, np.int64)
        return at, (self.sums[at + length] - self.sums[at]) * self.back[at]


def tiles_linear(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """What `tiles` gives from all seeds, in memory linear in the texts; doc and item share one vocabulary."""
    a, b, out = _Side(np.where(np.isin(doc, item), doc, 0).astype(np.uint64)), _Side(item.astype(np.uint64)), []

    def common(length: int) -> tuple[int, int] | None:
        """The first common window of a length, compared word by word."""
        at, values = a.windows(length)
        place, wanted = b.windows(length)
        order = np.argsort(wanted, kind="stable")
        wanted, place = wanted[order], place[order]
        first = np.searchsorted(wanted, values, "left")
        there = np.flatnonzero((first < len(wanted)) & (wanted[np.minimum(first, len(wanted) - 1)] == values)) if len(wanted) else []
        for k in there:
            for j in place[first[k] : np.searchsorted(wanted, values[k], "right")]:
                if (a.codes[at[k] : at[k] + length] == b.codes[j : j + length]).all():
                    return int(at[k]), int(j)
        return None

    while True:
        low, high, found = min_match, min(len(doc), len(item)), common(min_match)
        if not found:
            return out
        while low < high:
            middle = (low + high + 1) // 2
            hit = common(middle)
            if hit:
                low, found = middle, hit
            else:
                high = middle - 1
        i, j = found
        out.append((i, j, low))
        a.free[i : i + low] = False
        b.free[j : j + low] = False


COLUMNS = ["doc_id", "item_id", "tile_count", "longest_run", "covered_words", "item_words"]
_FIGURES = "tile_count int, longest_run int, covered_words int, item_words int"

_INDEXES: dict[tuple, ItemIndex] = {}


def _index(key: tuple, items: list[tuple[object, str]], min_match: int) -> ItemIndex:
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = ItemIndex(items, min_match)
    return _INDEXES[key]


def _leaks_of_block(documents: DataFrame, items: list[tuple[object, str]], item_kind: str, min_match: int) -> DataFrame:
    kind = documents.schema["doc_id"].dataType.simpleString()
    key = (hash(tuple(items)), len(items), min_match)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _index(key, items, min_match)
        known = index.vocabulary.get
        for batch in batches:
            ids, codes, ends = [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(text)
                if len(words) >= min_match:
                    codes.extend([known(w, 0) for w in words])
                    codes.append(0)  # no window reaches over a document's end
                    ids.append(doc_id)
                    ends.append(len(codes))
            every, bounds = np.array(codes, np.uint64), np.array(ends, np.int64)
            full, first, count = index.hits(every)
            doc = np.searchsorted(bounds, full, "right")
            sizes = np.diff(np.concatenate(([0], bounds)))
            heavy = np.bincount(doc, count, len(ids)) > HEAVY * sizes
            light = ~heavy[doc]
            at, number, place = index.seeds(full[light], first[light], count[light])
            rows = []
            of = np.searchsorted(bounds, at, "right")
            order = np.lexsort((number, of))
            # where a document and item differ from those before; with the end, the bounds of each pair's seeds
            changes = np.flatnonzero((np.diff(of[order]) != 0) | (np.diff(number[order]) != 0)) + 1
            cuts = [0, *changes.tolist(), len(order)] if len(order) else [0]
            for s, e in zip(cuts, cuts[1:]):
                take = order[s:e]
                item_id, item = index.items[number[take[0]]]
                rows += _row(ids[of[take[0]]], item_id, tiles(every, item, at[take], place[take], min_match), len(item))
            for d in np.flatnonzero(heavy):
                own = doc == d
                codes_of = every[bounds[d] - sizes[d] : bounds[d]]
                for n in index.numbers_of(first[own], count[own]):
                    item_id, item = index.items[n]
                    rows += _row(ids[d], item_id, tiles_linear(codes_of, item, min_match), len(item))
            yield pd.DataFrame(rows, columns=COLUMNS)

    return documents.mapInPandas(found, f"doc_id {kind}, item_id {item_kind}, {_FIGURES}")


def _row(doc_id: object, item_id: object, got: list[tuple[int, int, int]], words: int) -> list[tuple]:
    return [(doc_id, item_id, len(got), got[0][2], sum(n for _, _, n in got), words)] if got else []


def winnowed(words: list[str], min_match: int) -> np.ndarray:
    """Values of windows of half the length, of which every run of min_match words holds at least one."""
    length = max(1, min_match // 2)
    if len(words) < min_match:
        return np.zeros(0, np.uint64)
    values = _hashed_windows(words, length)
    stretch = np.lib.stride_tricks.sliding_window_view(values, min_match - length + 1)
    return np.unique(stretch.min(1))


def _hashed_windows(words: list[str], length: int) -> np.ndarray:
    return rolling(pd.util.hash_array(np.array(words, dtype=object), categorize=True), length)


def _leaks_by_join(documents: DataFrame, items: DataFrame, min_match: int) -> DataFrame:
    """For items of any number: pairs by a join on window values, then tiled one by one."""
    docs = documents.withColumn("d", F.xxhash64("doc_id", "text"))
    held = items.select(F.col("i").alias("item_id"), F.col("t").alias("item_text"), F.xxhash64("i", "t").alias("h"))

    def values(key: str, of: Callable[[list[str]], np.ndarray]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                got = [of(words_of(t)) for t in batch.iloc[:, 1]]
                yield pd.DataFrame({key: np.repeat(batch.iloc[:, 0].to_numpy(), [len(g) for g in got]), "v": np.concatenate([*got, np.zeros(0, np.uint64)]).view(np.int64)})

        return each

    length = max(1, min_match // 2)
    of_docs = docs.select("d", "text").mapInPandas(values("d", lambda w: winnowed(w, min_match)), "d long, v long")
    of_items = held.select("h", "item_text").mapInPandas(values("h", lambda w: np.unique(_hashed_windows(w, length)) if len(w) >= min_match else np.zeros(0, np.uint64)), "h long, v long")
    pairs = of_docs.join(of_items, "v").select("d", "h").distinct()
    both = pairs.join(held, "h").join(docs, "d").select("doc_id", "text", "item_id", "item_text")
    kinds = [both.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")]

    def tiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, item_id, item_text in batch.itertuples(index=False):
                vocabulary: dict[str, int] = {}
                item = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(item_text)], np.uint64)
                doc = np.array([vocabulary.get(w, 0) for w in words_of(text)], np.uint64)
                rows += _row(doc_id, item_id, tiles_linear(doc, item, min_match), len(item))
            yield pd.DataFrame(rows, columns=COLUMNS)

    return both.mapInPandas(tiled, f"doc_id {kinds[0]}, item_id {kinds[1]}, {_FIGURES}")


def find_leaks(documents: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, item_text: Column, min_match: int = MIN_MATCH, min_coverage: float = 0.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, tile_count, longest_run, covered_words, item_words, coverage).

    One row per document and item with at least one tile of min_match words and
    at least min_coverage of the item's words in tiles. A smaller min_match with
    a coverage threshold catches passages whose parts were reordered.
    """
    held_out = items.select(item_id.alias("i"), item_text.alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    size = held_out.agg(F.coalesce(F.sum(F.size(F.split("t", r"\s+"))), F.lit(0)).alias("n")).first().n
    docs = documents.select(doc_id.alias("doc_id"), text.alias("text")).where("text IS NOT NULL AND text <> ''")
    if size > block_words:
        found = _leaks_by_join(docs, held_out, min_match)
    else:
        rows = held_out.orderBy("i", "t").collect()
        found = _leaks_of_block(docs, [(r.i, r.t) for r in rows], held_out.schema["i"].dataType.simpleString(), min_match)
    found = found.withColumn("coverage", F.col("covered_words") / F.col("item_words"))
    return found.where(F.col("coverage") >= min_coverage).distinct()
