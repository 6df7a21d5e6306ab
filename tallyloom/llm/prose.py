"""The prose of a document as sentences: no code, tables, log lines, headings, links.

Works on Markdown, tracker markup and HTML in one pass of line and block rules.
A full stop ends no sentence after an abbreviation or an initial, inside a
number, or before a word in lower case.
"""

from __future__ import annotations

import html
import re
from functools import cache

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_OPENING = re.compile(
    r"\{(code|noformat)(?::[^{}]*)?\}|^[ \t]*(```|~~~)[^\n]*$|<(pre|code|table|script|style|h[1-6]|title|nav)\b[^<>]*>|(<!--)",
    re.MULTILINE | re.IGNORECASE,
)
_MARKED = re.compile(r"\{|```|~~~|<")
#: Lines that are no prose: headings, table rows, log lines, stack frames, rules, shell and HTTP lines, comments of code.
_LINES = re.compile(
    r"^[ \t]*(?:>[ \t]?)*(?:"
    r"h[1-6]\.[ \t][^\n]*"
    r"|#{1,6}[ \t][^\n]*"
    r"|\|[^\n]*"
    r"|[^\n|]*\|[ \t]*[^\n|]+\|[^\n]*"
    r"|\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d[^\n]*"
    r"|\[?\d\d:\d\d:\d\d[^\n]*"
    r"|(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b[:\s\]][^\n]*"
    r"|at [\w$.]+\([^\n]*"
    r"|[-=_*~]{3,}[ \t]*"
    r"|(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS) \S+[^\n]*"
    r"|[\w-]+: [\w.*+-]+/[\w.*+-]+[^\n]*"
    r"|[{}\[\]][^\n]*[{}\[\],;]?[ \t]*(?=\n|\Z)"
    r")$",
    re.MULTILINE,
)
_MAY_BE_LINE = re.compile(r"^[ \t>]*(?:h[1-6]\.|[#|\[{}\d=_*~]|---|TRACE|DEBUG|INFO|WARN|ERROR|FATAL|at |GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|[\w-]+: [\w.*+-]+/)|\|", re.MULTILINE)
_BREAKS = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|td|th|blockquote|section|article|hr|dl|dt|dd|body|html)\b[^<>]*>", re.IGNORECASE)
_TAGS = re.compile(r"</?[A-Za-z][^<>]*>")
_MACROS = re.compile(r"\{/?[a-zA-Z]+(?::[^{}]*)?\}")
_LINKS = re.compile(r"\[([^\[\]|]*)\|[^\[\]\s]*\]|!?\[([^\[\]]*)\]\([^()\s]*\)|<?\b(?:https?|ftp)://[^\s<>\"'“”]*|\[~[\w.-]+\]|\bmailto:\S+")
_BULLETS = re.compile(r"^[ \t]*(?:>[ \t]?)+|^[ \t]*(?:[*#+-]+|\d+[.)])[ \t]+", re.MULTILINE)
_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*|\x1e\s*")
#: Abbreviations whose full stop ends no sentence.
_ABBREVIATIONS = frozenset(
    "e.g i.e approx etc cf vs no nos fig figs sec sect ch vol ed eds resp incl excl ca al p pp art para par eq ref refs "
    "dr mr mrs ms prof st jr sr inc ltd co corp dept est min max avg ver rev op viz "
    "jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun "
    "z.b d.h u.a bzw ggf evtl usw vgl nr abs p.ex env sra srta ud uds pág núm".split()
)
#: A sentence may end here; what stands before and after the full stop decides.
_END = re.compile(r"(?<![.!?…])[.!?…]+[\"'”’)\]*_]*\s+")
_WORDLIKE = re.compile(r"\w")


@cache
def _closing(opened: str) -> re.Pattern:
    if opened in ("code macro", "noformat macro"):
        return re.compile(r"\{" + opened.split()[0] + r"\}", re.IGNORECASE)
    if opened in ("```", "~~~"):
        return re.compile(rf"^[ \t]*{opened}[^\n]*$", re.MULTILINE)
    return re.compile("-->") if opened == "<!--" else re.compile(rf"</{opened}\s*>", re.IGNORECASE)


def without_blocks(text: str) -> str:
    """The text with code, tables, headings and the like replaced by a paragraph break.

    A block that is never closed is no block. Each kind is searched to the end
    in vain at most once, so the time stays linear.
    """
    out, at, unclosed = [], 0, set()
    while m := _OPENING.search(text, at):
        kind = f"{m[1].lower()} macro" if m[1] else (m[2] or m[3] or m[4]).lower()
        end = None if kind in unclosed else _closing(kind).search(text, m.end())
        if end:
            out += (text[at : m.start()], "\n\x1e\n")
            at = end.end()
        else:
            unclosed.add(kind)
            out.append(text[at : m.end()])
            at = m.end()
    out.append(text[at:])
    return "".join(out)


def _opens(text: str, at: int) -> bool:
    """Whether what starts at `at` may begin a sentence: no lower-case letter."""
    while at < len(text) and not text[at].isalnum():
        at += 1
    return at >= len(text) or not text[at].islower()


def sentences_of_paragraph(text: str) -> list[str]:
    out, start = [], 0
    for m in _END.finditer(text):
        mark = m.group()[0]
        if mark in ".…":
            if not _opens(text, m.end()):
                continue
            if mark == "." and m.group()[1:2].isspace():
                before = text[max(start, m.start() - 12) : m.start()].split()
                last = before[-1].lstrip("([\"'“‘*_").lower() if before else ""
                if last in _ABBREVIATIONS and (last not in ("no", "min", "max", "art", "par", "mar", "sun", "sat", "mon", "ed", "co", "p") or text[m.end() : m.end() + 1].isdigit()) or len(last) == 1 and last.isalpha() and last not in "iay":
                    continue
        out.append(text[start : m.end()])
        start = m.end()
    if start < len(text):
        out.append(text[start:])
    return out


def prose_paragraphs(text: str) -> list[str]:
    """The paragraphs of prose, each as one line."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if _MARKED.search(text):
        text = without_blocks(text)
    if _MAY_BE_LINE.search(text):
        text = _LINES.sub("\x1e", text)
    if "<" in text:
        text = _TAGS.sub("", _BREAKS.sub("\x1e", text))
    if "{" in text:
        text = _MACROS.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "[" in text or "//" in text or "mailto:" in text:
        text = _LINKS.sub(lambda m: m[1] or m[2] or "", text)
    text = _BULLETS.sub("", text)
    return [" ".join(p.split()) for p in _PARAGRAPH.split(text) if p and not p.isspace()]


def sentences(text: str | None) -> list[str]:
    """The sentences of a text's prose; [] for null and for a text without prose."""
    if not text:
        return []
    out = []
    for paragraph in prose_paragraphs(text):
        out.extend(s for s in sentences_of_paragraph(paragraph) if _WORDLIKE.search(s))
    return out


def measures(found: list[str]) -> tuple[int, int, int]:
    """(sentences, words, letters); a word is a run between blanks with a letter or digit in it."""
    words = letters = 0
    for s in found:
        for w in s.split():
            if w.isalpha():
                words += 1
                letters += len(w)
            else:
                n = sum(map(str.isalpha, w))
                if n or any(map(str.isdigit, w)):
                    words += 1
                    letters += n
    return len(found), words, letters
