"""Reading level of documents from the levels of their sentences.

Every prose sentence is classified as easy, middle or hard by a regularised
softmax model over hashed character trigrams and hashed word forms, and nothing
else: a sentence's score is the sum of the weights of its trigrams and words, so
what its vocabulary and its mere mass of words say about it is learned, not
given. A document's sentence-level distributions are then aggregated (means of
probabilities and of log-odds) and mapped to band probabilities by a second
regularised model, whose temperature is set on documents that neither model was
fitted on; the difficulty between 0 and 1 is read from those calibrated
probabilities.

The models are fitted when the operator is called, on the SAMPLE_DOCUMENTS
documents that come first by a hash of the id, of at most SAMPLE_CHARACTERS
characters, and on SAMPLE_SENTENCES of their sentences (the bounds are
parameters). Labels are the band's definition applied to single sentences and to
whole documents. By the hash one half of the sample fits the sentence model, a
quarter the document model, a quarter sets temperature and thresholds.
Everything else - extraction, classification, aggregation - runs over all
documents and whole texts.

`reading_bands` lists what the models hold possible and the definition confirms:
a document is a candidate of a band if its probability reaches that band's
threshold, which lies MARGIN times below the lowest one that a labelled document
of the held-out part got (and never above CANDIDATE); candidates, and only
they, are held against the definition. A band with fewer than LEAST_LABELLED
labelled documents in the sample has threshold 0: every document is its
candidate, as no model can be trusted with it.

Defined results: a null or empty text and a text without prose have no level
(no row); repeated rows are rated alike; an empty table gives no rows; without a
sentence in the sample all levels are equally likely and every document with
prose is a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.prose import measures, sentences

EASY_WORDS, EASY_LETTERS = 9, 4.4
HARD_WORDS, HARD_LETTERS = 24, 5.6
SAMPLE_DOCUMENTS, SAMPLE_SENTENCES, SAMPLE_CHARACTERS = 2000, 6000, 200_000
CANDIDATE, MARGIN, LEAST_LABELLED = 0.02, 20.0, 10
BITS = 13
#: Weights are summed over a sentence and divided by this, so that a step is of the same size for all.
SCALE = 16.0
#: Characters of text rated at once; bounds a task's memory whatever the size of a batch.
CHUNK = 2_000_000
LEVELS = ("easy", "middle", "hard")


def band_of(n: int, words: int, letters: int) -> str | None:
    """The band by its definition; None for others and without prose."""
    if not n or not words:
        return None
    if words <= EASY_WORDS * n and letters <= EASY_LETTERS * words:
        return "easy"
    if words >= HARD_WORDS * n and letters >= HARD_LETTERS * words:
        return "hard"
    return None


def _level(found: list[str]) -> int:
    return {"easy": 0, None: 1, "hard": 2}[band_of(*measures(found))]


@dataclass
class Features:
    """Hashed features of many sentences, each run of them belonging to one sentence."""

    chars: np.ndarray
    char_at: np.ndarray
    words: np.ndarray
    word_at: np.ndarray


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def features(texts: list[str]) -> Features:
    """Byte trigrams (the last two reach over the sentence's end) and word forms: first and last three bytes with the length."""
    data = np.frombuffer(("\n".join(texts) + "\n\n\n").lower().encode(), np.uint8)
    b = data.astype(np.uint32)
    trigram = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int32)
    data = data[:-2]
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    blank = _BLANK[data]
    first = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    last = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
    form = np.full(len(first), 17, np.uint32)
    for at in (first, first + 1, first + 2, last - 1, np.maximum(last - 2, first), np.maximum(last - 3, first)):
        form = form * np.uint32(31) + b[at]
    form = (form * np.uint32(2654435761) + (last - first).astype(np.uint32) * np.uint32(40503)) >> np.uint32(32 - BITS)
    return Features(trigram, starts, form.astype(np.int32), np.searchsorted(first, starts))


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


@dataclass
class LevelModel:
    chars: np.ndarray
    words: np.ndarray
    bias: np.ndarray
    documents: np.ndarray
    temperature: float = 1.0
    #: Least probability of the easy and of the hard band that makes a candidate.
    thresholds: tuple[float, float] = (0.0, 0.0)

    def scores(self, f: Features) -> np.ndarray:
        """Log-odds of each level for each sentence, up to a constant."""
        z = np.tile(self.bias.astype(np.float32), (len(f.char_at), 1))
        for k in range(3):
            z[:, k] += np.add.reduceat(self.chars[:, k][f.chars], f.char_at) / SCALE
            # a sentence holds a word, so no run is empty
            z[:, k] += np.add.reduceat(self.words[:, k][f.words], f.word_at) / SCALE
        return z

    def bands(self, distribution: np.ndarray) -> np.ndarray:
        return softmax(distribution @ self.documents / self.temperature)


def aggregate(z: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
    """One row per document: means of its sentences' level probabilities and log-odds."""
    n = np.diff(np.concatenate((doc_at, [len(z)])))[:, None]
    means = np.add.reduceat(softmax(z), doc_at) / n
    odds = np.add.reduceat(np.clip(z - z[:, 1:2], -30, 30)[:, [0, 2]], doc_at) / n
    return np.concatenate((np.ones_like(means[:, :1]), means, odds / 10), 1)


def difficulty(p: np.ndarray) -> np.ndarray:
    """0 where easy is certain, 1 where hard is."""
    return p[:, 1] * 0.5 + p[:, 2]


def _balanced(y: np.ndarray) -> np.ndarray:
    counts = np.bincount(y, minlength=3)
    return (len(y) / (3 * np.maximum(counts, 1)))[y].astype(np.float32)


class _Adam:
    """Steps of a size that doesn't depend on the scale of the gradient."""

    def __init__(self, weights: list[np.ndarray], rate: float) -> None:
        self.weights, self.rate, self.t = weights, rate, 0
        self.first = [np.zeros_like(w) for w in weights]
        self.second = [np.zeros_like(w) for w in weights]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for w, g, m, v in zip(self.weights, gradients, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def _fit_sentences(some: list[str], l2: float, steps: int) -> LevelModel:
    size = 1 << BITS
    model = LevelModel(np.zeros((size, 3), np.float32), np.zeros((size, 3), np.float32), np.zeros(3, np.float32), np.zeros((6, 3)))
    if not some:
        return model
    f = features(some)
    y = np.array([_level([s]) for s in some])
    target, weight = np.eye(3, dtype=np.float32)[y], _balanced(y)[:, None]
    lengths = lambda at, n: np.diff(np.concatenate((at, [n])))
    of_char = np.repeat(np.arange(len(some)), lengths(f.char_at, len(f.chars)))
    of_word = np.repeat(np.arange(len(some)), lengths(f.word_at, len(f.words)))
    adam = _Adam([model.chars, model.words, model.bias], 0.05)
    for _ in range(steps):
        left = (softmax(model.scores(f)) - target) * weight / len(y)
        grad = lambda ids, of: np.stack([np.bincount(ids, left[of, k], size) for k in range(3)], 1).astype(np.float32) / SCALE  # noqa: B023, E731
        adam.step([grad(f.chars, of_char) + l2 * model.chars, grad(f.words, of_word) + l2 * model.words, left.sum(0)])
    return model


def _fit_documents(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 600) -> np.ndarray:
    w = np.zeros((x.shape[1], 3))
    weight, target, adam = _balanced(y)[:, None], np.eye(3)[y], None
    adam = _Adam([w], 0.05)
    for _ in range(steps):
        adam.step([x.T @ ((softmax(x @ w) - target) * weight) / len(y) + l2 * w])
    return w


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature under which the held-out labels are likeliest."""
    options = np.geomspace(0.25, 8, 41)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in options]
    return float(options[int(np.argmin(loss))])


def distributions(model: LevelModel, docs: list[list[str]]) -> np.ndarray:
    """The aggregated sentence levels of documents, each given as its sentences (at least one)."""
    at = np.cumsum([0, *[len(d) for d in docs[:-1]]])
    return aggregate(model.scores(features([s for d in docs for s in d])), at)


def fit(texts: list[str], max_sentences: int = SAMPLE_SENTENCES, l2: float = 1e-5, steps: int = 60) -> LevelModel:
    """Sentence and document models from the given documents; those at the places 2 and 3 of every four are held out."""
    docs = [s for s in map(sentences, texts) if s]
    parts = [docs[0::4] + docs[1::4], docs[2::4], docs[3::4]]
    flat = [s for d in parts[0] for s in d]
    step = max(1, -(-len(flat) // max_sentences))
    model = _fit_sentences(flat[::step], l2, steps)
    if not parts[1] or not parts[2]:
        return model
    labels = [np.array([_level(d) for d in part]) for part in parts]
    model.documents = _fit_documents(distributions(model, parts[1]), labels[1])
    held_out = distributions(model, parts[2])
    model.temperature = _temperature(held_out @ model.documents, labels[2])
    p = model.bands(held_out)
    known = np.bincount(np.concatenate(labels), minlength=3)
    lowest = lambda k: min(CANDIDATE, p[labels[2] == k, k].min(initial=1.0) / MARGIN) if known[k] >= LEAST_LABELLED and (labels[2] == k).any() and (labels[1] == k).any() else 0.0
    model.thresholds = (lowest(0), lowest(2))
    return model


def sample_texts(documents: DataFrame, doc_id: Column, text: Column, bound: int = SAMPLE_DOCUMENTS, characters: int = SAMPLE_CHARACTERS) -> list[str]:
    """The `bound` texts that come first by a hash of the id, so the same ones in every run; only texts of some length, up to `characters`."""
    rows = documents.select(doc_id.alias("i"), text.alias("t")).where(F.length("t").between(1, characters))
    place = F.xxhash64(F.lit(3), "i")
    # cut by the hash to about twice the bound first, or every partition would send its own `bound` texts;
    # all rows are counted, which reads no text
    share = min(1.0, 2 * bound / max(1, documents.count()))
    near = rows if share == 1.0 else rows.where(place < F.lit(int(-(2**63) + share * 2**64)))
    return [r.t for r in near.orderBy(place, "i", "t").limit(bound).collect()]


def _chunks(ids: pd.Series, texts: pd.Series) -> Iterator[tuple[list, list[list[str]]]]:
    """(ids, sentences) of the documents with prose, about CHUNK characters at a time."""
    kept, docs, size = [], [], 0
    for doc_id, text in zip(ids, texts, strict=True):
        found = sentences(text)
        if found:
            kept.append(doc_id)
            docs.append(found)
            size += len(text)
        if size >= CHUNK:
            yield kept, docs
            kept, docs, size = [], [], 0
    if docs:
        yield kept, docs


def reading_levels(documents: DataFrame, doc_id: Column, text: Column, model: LevelModel | None = None, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(doc_id, sentences, difficulty, p_easy, p_hard, reading_band) as the models rate them, one row per row with prose."""
    source, model, kind = _prepared(documents, doc_id, text, model, sample)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, docs in _chunks(batch["doc_id"], batch["text"]):
                p = model.bands(distributions(model, docs))
                yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=batch["doc_id"].dtype), "sentences": [len(d) for d in docs], "difficulty": difficulty(p), "p_easy": p[:, 0], "p_hard": p[:, 2], "reading_band": [LEVELS[k] for k in p.argmax(1)]})

    return source.mapInPandas(rate, f"doc_id {kind}, sentences long, difficulty double, p_easy double, p_hard double, reading_band string")


def reading_bands(documents: DataFrame, doc_id: Column, text: Column, model: LevelModel | None = None, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(doc_id, reading_band) of the easy and hard documents: the models' candidates that the definition confirms."""
    source, model, kind = _prepared(documents, doc_id, text, model, sample)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, docs in _chunks(batch["doc_id"], batch["text"]):
                possible = model.bands(distributions(model, docs))[:, [0, 2]] >= model.thresholds
                bands = [band_of(*measures(d)) if c.any() else None for d, c in zip(docs, possible, strict=True)]
                # a document that is the candidate of one band only is not listed in the other
                kept = [i for i, (b, c) in enumerate(zip(bands, possible, strict=True)) if b == "easy" and c[0] or b == "hard" and c[1]]
                yield pd.DataFrame({"doc_id": pd.Series([ids[i] for i in kept], dtype=batch["doc_id"].dtype), "reading_band": pd.Series([bands[i] for i in kept], dtype=object)})

    return source.mapInPandas(rate, f"doc_id {kind}, reading_band string").distinct()


def _prepared(documents: DataFrame, doc_id: Column, text: Column, model: LevelModel | None, sample: int) -> tuple[DataFrame, LevelModel, str]:
    source = documents.select(doc_id.alias("doc_id"), text.alias("text")).where("text IS NOT NULL AND text <> ''")
    return source, model or fit(sample_texts(documents, doc_id, text, sample)), source.schema["doc_id"].dataType.simpleString()
