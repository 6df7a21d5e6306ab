from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import html_pages as H
from tallyloom.functions import review
from tallyloom.operators import page_words as W

PAGE = """<html><body><nav>menu</nav><h1>Title&amp;More</h1><table class="x colstu"><tr><td id="fmm"><a>Maturity</a>: 3</td><td id="ballot">Ballot Status: Trial</td><td id="wg">Owner wg Orders</td></tr></table>
<p>One<p>Two %41</p><script>bad()</script><img src="a.png"><figure><img src="b.png" alt="b"></figure><figure><img src="c.png" alt=" "></figure>
<footer>foot</footer>[%file newfooter%]<p>after</p></body></html>"""


def test_page():
    page = H.read_page(PAGE)
    assert (page.status, page.maturity, page.ballot, page.work_group) == ("Trial Use", 3, "Trial", "Orders")
    assert page.images == [("a.png", True, True), ("b.png", False, False), ("c.png", True, False)]
    lines = page.text.split("\n")
    assert lines[0] == "Title&More" and "Two A" in lines
    assert not {"menu", "bad()", "foot", "after"} & set(lines)
    assert H.read_page(None).text == "" and H.read_page("<p>x").text == "x" == H.read_page("<head><title>t</title><body>x").text
    assert H.read_page("<table><tr><td>x</td></tr></table>").status is None


def test_page_frames(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>none"), (3, None)], "k int, h string")
    parts = H.page_parts(df, "k", "h")
    assert [r.page_id for r in H.page_status(parts).collect()] == [1]
    assert sorted(r.source for r in H.page_images(parts).collect()) == ["a.png", "c.png"]
    assert df.select(H.page_text(F.col("h"))).count() == 3


def test_counters(spark):
    text = "It SHALL be. It shall not. SHALL  NOT ever; Should, should NOT. MAY may NOTHING"
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(*[c.alias(n) for n, c in review.conformance_columns(F.col("t")).items()]).first()
    assert (row.shall_conformant, row.shall_other, row.shall_not_conformant, row.shall_not_other) == (1, 0, 1, 1)
    assert (row.should_conformant, row.should_other, row.should_not_conformant, row.should_not_other) == (0, 1, 0, 1)
    assert (row.may_conformant, row.may_other) == (1, 0)


def test_markers_and_links(spark):
    df = spark.createDataFrame([("TODO then todo, Feedback and  to do; a...b but ... not; x[%stu-note%]y https://chat.example.org/x http://chat.example.org/y <b class='stu'>",)], "t string")
    row = df.select(review.markers(F.col("t"), (*review.INCOMPLETE, *review.READER_NOTES)).alias("m"), review.link_count(F.col("t"), "chat.example.org").alias("n"), review.trial_use_count(F.col("t")).alias("u")).first()
    # dots and brackets only between word characters, as word ends demand
    assert row.m == ["...", "[%stu-note%]", "Feedback", "to do", "TODO"]
    assert (row.n, row.u) == (1, 1)


def test_skip_reasons(spark):
    words = {
        "http://a.b": "url", "[base]/x": "base_path", "[type]/y": "type_path", "a@b.cd": "mail", "urn:ab:c": "urn", "xs:string": "schema_type", "fhir:Patient": "shape", "terminology.example.org/CodeSystem/x": "code_system",
        "x.png": "file", "2020-01-01": "date_time", "2019": "date_time", "0000": None, "2019-05-01T10:00:00Z": "date_time", "[%x%]": "markup", "%v": "symbol", "#f": "symbol", "1#f": "symbol", "(#f": None, "/p": "path", "1/p": None, "word": None, "": None,
    }
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.r for r in df.select("w", review.skip_reason(F.col("w")).alias("r")).collect()}
    assert got == words


def test_work_group_of_a_page():
    cell = lambda text: H.read_page(f'<table class="colsd"><tr><td id="wg">{text}</td></tr></table>').work_group
    assert [cell(t) for t in ("Work Group[%wg vocab%]", "[%WGT orders%] Work Group", "wg", "nobody", "")] == ["vocab", "orders", None, None, None]


def test_words_in_order(spark):
    frame = lambda *rows: spark.createDataFrame([(r,) if isinstance(r, str) else r for r in rows], "n string, c string, p int" if rows and not isinstance(rows[0], str) else "n string")
    rows = W.dictionary_rows
    known = W.vocabulary(
        [
            rows(frame(("Patient", "Type", 1), ("Patient", "Resource", 2)), "n", W.STRUCTURE, W.CURRENT, F.col("c"), F.col("p")),
            rows(frame("Patient.name"), "n", W.ELEMENT, W.CURRENT),
            rows(frame("_text"), "n", W.PARAMETER, W.CURRENT),
            rows(frame(("OldThing", "Resource", 1), ("Conformance", "Resource", 1)), "n", W.STRUCTURE, W.PUBLISHED, F.col("c"), F.col("p")),
            rows(frame("OldThing.part"), "n", W.ELEMENT, W.PUBLISHED),
            rows(frame(("teh", "the", 0),), "n", W.TYPO, "", F.col("c")),
            rows(frame("the", "good", "conformance"), "n", W.WORD),
        ]
    )
    text = 'the Patient .name R4 deprecated OldThing .part Conformance teh good/bad zzz patients http://x.y #f 12 "valuePatient" .name _text text .zzz R4'
    df = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ".name"), (4, "Patient good-OldThings .part"), (5, "")], "id int, t string")
    got = sorted((r.page_id, r.kind, r.word, r.note) for r in W.resolve_pages(df, "id", "t", known).collect())
    assert got == sorted(
        [
            (1, "prior", "", "2"),
            (1, "deprecated", "", "1"),
            (1, "removed", "OldThing", "Resource"),
            (1, "removed", ".part", "Element"),
            (1, "typo", "teh", "the"),
            (1, "unknown", "good/bad", ""),
            (1, "unknown", "zzz", ""),
            (1, "unknown", "text", ""),
            (1, "unknown", ".zzz", ""),
            (3, "unknown", ".name", ""),
            (4, "removed", "OldThings", "Resource"),
            # named by a part of its word, without the plural's s
            (4, "removed", ".part", "Element"),
        ]
    )
