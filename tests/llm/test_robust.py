"""Texts that nobody writes: the text functions stay within linear time and never fail."""

from __future__ import annotations

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import personal_data as P
from tallyloom.llm import prose
from tallyloom.llm.contamination import words_of

PIECES = st.sampled_from(["<b>", "</b>", "<!--", "-->", "{code}", "```\n", "&amp;", "&#64;", "­", "é", "@", " at ", " dot ", "ssn ", "12 ", "Oak St", "rue ", "+44 ", "Kestrow", ", ", "Orlind ", ".", "\n", "\n\n", "|", "h2. ", "> ", "'", "ß", "\U0001f600", "a.b"])
TEXTS = st.lists(st.one_of(PIECES, st.text(max_size=6)), max_size=40).map("".join)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_functions_never_fail(text):
    spans = P.find_entities(text, ("Orlind",), ("Kestrow", "Van Hoersel"))
    assert all(0 <= s < e <= len(text) for s, e, _, _ in spans)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    plain, places = P.normal_form(text)
    assert places is None or len(places) == len(plain) + 1 and places == sorted(places)
    n, words, letters = prose.measures(prose.sentences(text))
    assert n <= max(1, words) or words >= 0 and letters >= 0
    assert all(w == w.lower() and w.isalnum() for w in words_of(text))


@pytest.mark.parametrize("unit", ["a", "a ", "1 ", "a@", " at ", "<table>", "<!--", "{code}", "```\n", "&", "12 oak ", "kestrow, ", "ssn ", ".", "\n", "| a ", "[a](", "é", "</p", "{", "'", "12 Oak St ", "x@y.example "])
def test_long_texts_take_linear_time(unit):
    text = unit * (200_000 // len(unit))
    began = time.perf_counter()
    P.find_entities(text, ("Orlind",), ("Kestrow",))
    prose.sentences(text)
    words_of(text)
    assert time.perf_counter() - began < 20
