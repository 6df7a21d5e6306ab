from __future__ import annotations

import tarfile

from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import metadata
from tallyloom.sources import files, tracker

ITEM = """<item><title>[P-{n}] A title</title><link>http://t/{n}</link><project id="7" key="P">Pee</project><description>d</description><key id="{n}">P-{n}</key>
<type id="1">Bug</type><status id="3">Open</status><assignee username="me">Me</assignee><created>Mon, 2 Jan 2023 10:00:00 +0100</created><updated>never</updated><watches>{w}</watches>{more}</item>"""
ONE = '<comments><comment id="5" author="x" created="Tue, 3 Jan 2023 00:00:00 +0000">hello</comment></comments>'
TWO = '<comments><comment id="6" author="x" created="bad">a</comment><comment id="7" author="y" created="2023-01-04T01:00:00Z">b</comment></comments><customfields><customfield id="f1" key="k"><customfieldname>Name</customfieldname><customfieldvalues><customfieldvalue>v1</customfieldvalue><customfieldvalue>v2</customfieldvalue></customfieldvalues></customfield></customfields>'


def test_export(spark, tmp_path):
    doc = lambda *items: "<rss><channel>" + "".join(items) + "</channel></rss>"
    (tmp_path / "a.xml").write_text(doc(ITEM.format(n=1, w=0, more=ONE)))
    (tmp_path / "b.xml").write_text(doc(ITEM.format(n=2, w=4, more=TWO), ITEM.format(n=3, w=1, more="")))
    (tmp_path / "empty.xml").write_text(doc())
    (tmp_path / "broken.xml").write_text("<rss><channel><item><title>x")
    items = tracker.read_items(spark, str(tmp_path))
    rows = {r.id: r for r in tracker.issues_of(items).collect()}
    assert sorted(rows) == [1, 2, 3]
    assert rows[1].title == "A title"
    assert (rows[1].watches, rows[2].watches) == (None, "4")
    assert (rows[1].resolution_name, rows[1].updated_at) == ("Unresolved", None)
    assert rows[1].created_at.isoformat().startswith("2023-01-02T09:00")
    said = {r.id: r for r in tracker.comments_of(items, F.lit("2000-01-01").cast("timestamp")).collect()}
    assert sorted(said) == [5, 6, 7]
    assert said[6].created_at.year == 2000
    assert [(r.field_name, r.field_value) for r in tracker.fields_of(items).collect()] == [("Name", "v1, v2")]


def test_words_and_typos(spark, tmp_path):
    (tmp_path / "w.txt").write_text("alpha\n# note\n! other\n\n beta \nalpha\n")
    assert sorted(r.word for r in files.read_words(spark, str(tmp_path)).collect()) == ["alpha", "beta"]
    (tmp_path / "w.txt").write_text("teh->the\nbad\na->b->c\n x -> y \n")
    assert sorted(tuple(r) for r in files.read_typos(spark, str(tmp_path)).collect()) == [("teh", "the"), ("x", "y")]


def test_archive(spark, tmp_path):
    (tmp_path / "m.txt").write_text("one\ntwo\n")
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "m.txt", "d/m.txt")
    assert [r.line for r in files.read_archive(spark, str(tmp_path / "a.tar.gz")).collect()] == ["one", "two"]


def test_groups(spark, tmp_path):
    (tmp_path / "g.csv").write_text("code,title,official_url,replaced_by\nOrders,Orders,http://g.example/orders,\nold,Old,,ORDERS\n,none,,\n")
    groups = files.read_groups(spark, str(tmp_path / "g.csv"))
    assert sorted(map(tuple, groups.collect()), key=str) == [("old", "Old", None, "orders"), ("orders", "Orders", "http://g.example/orders", None)]
    df = spark.createDataFrame([(1, " ORDERS"), (2, "Old"), (3, "unknown"), (4, None)], "id int, g string")
    got = {r.id: (r.code, r.title) for r in metadata.with_group(df, F.col("g"), groups, "fallback").collect()}
    assert got == {1: ("orders", "Orders"), 2: ("orders", "Orders"), 3: ("fallback", None), 4: ("fallback", None)}


def test_archives_in_batches(spark, tmp_path):
    (tmp_path / "m.txt").write_text("\n".join(str(i) for i in range(25)))
    (tmp_path / "n.md").write_text("no")
    for name in ("a", "b"):
        with tarfile.open(tmp_path / f"{name}.tar.gz", "w:gz") as tar:
            tar.add(tmp_path / "m.txt", f"{name}/m.txt")
            tar.add(tmp_path / "n.md", "n.md")
    got = files.read_archive(spark, str(tmp_path / "*.tar.gz"), batch=10).groupBy("file").count().collect()
    assert sorted(map(tuple, got)) == [("a/m.txt", 25), ("b/m.txt", 25)]


def test_ini(spark, tmp_path):
    text = "[other]\na=1\n[Pages]\n; c\n# c\n\nx.html = X = 1\n=none\nflag\n[end]\nb=2\n"
    (tmp_path / "p.ini").write_text(text)
    assert [(r.key, r.value) for r in files.read_ini(spark, str(tmp_path / "p.ini"), "pages").orderBy("place").collect()] == [("x.html", "X = 1")]


def test_sheet_and_pages(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"Artifact Name": "A", "Track": "N"}, {"Artifact Name": "B"}]')
    rows = files.read_sheet(spark, str(tmp_path / "s.json"), {"Artifact Name": "name", "Track": "track"}).collect()
    assert [(r.name, r.track) for r in rows] == [("A", "N"), ("B", None)]
    (tmp_path / "x.html").write_text("<p>é</p>")
    assert [tuple(r) for r in files.read_pages(spark, str(tmp_path)).collect()] == [("x.html", "<p>é</p>")]


def test_download_helpers(spark):
    df = spark.createDataFrame([(" <rss/>", True, 10), ("error", False, 5), ("", False, 0), (None, False, None)], "c string, ok boolean, size long")
    assert [r[0] for r in df.select(tracker.usable_download(F.col("c"))).collect()] == [True, False, False, False]
    m = tracker.manifest(df).first()
    assert (m.attempts, m.succeeded, m.failed, m.success_percent, m.bytes) == (4, 1, 3, 25.0, 15)
    assert tracker.manifest(df.limit(0)).first().bytes == 0


def test_text_functions(spark):
    df = spark.createDataFrame([(None,), ("[P-1] x",), ("[P-1 x",), ("plain",)], "t string")
    assert [r[0] for r in df.select(T.title_without_key(F.col("t"), F.lit("P"))).collect()] == [None, "x", "[P-1 x", "plain"]
    urls = spark.createDataFrame([("https://a.example/x/page.one.html?q=1#f",), ("page.html",), ("https://a.example/",)], "u string")
    assert [r[0] for r in urls.select(T.url_stem(F.col("u"))).collect()] == ["page.one", "page.html", ""]
    words = spark.createDataFrame([("$Expand",), ("Patient.name",), ("123",), ("<b>",), ("Ωmega",)], "w string")
    w = F.col("w")
    got = [tuple(r) for r in words.select(T.sanitize(w), T.first_letter(w), T.prefix_symbol(w)).collect()]
    assert got == [("expand", "E", "$"), ("patientname", "P", ""), ("123", "", ""), ("b", "b", "<"), ("ωmega", "Ω", "")]
    sizes = spark.createDataFrame([(512.0,), (1536.0,), (3.5 * 1024**3,), (2.0 * 1024**4,)], "s double")
    assert [r[0] for r in sizes.select(T.file_size(F.col("s"))).collect()] == ["512.0 B", "1.5 KB", "3.5 GB", "2.0 TB"]
    codes = spark.createDataFrame([(None,), ("old",), ("ok",), ("odd",)], "c string")
    assert [r[0] for r in codes.select(T.replaced_code(F.col("c"), {"old": "new"}, ["ok"], "dflt")).collect()] == ["dflt", "new", "ok", "dflt"]
