from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators.multivalue import Source, infer_all, infer_delimiters, known_names, score_delimiters, split_values

NAMES = ("Read; Write; Delete", 'The "Core" Set', "Provider's Index", "Search (chained, reverse)", "Data Types", "Data Types - Metadata", "Lab Order | Panel", "Coverage & Claims")
ALL = ("newline", "tab", "semicolon", "pipe", "comma", "blank")


def split(spark, cells, known=(), delimiters=None):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id int, cell string")
    rows = split_values(df, Source("t", "cell", tuple(known)), F.col("id"), F.col("cell"), delimiters).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.row_id, r.item_no)):
        assert (r.table_name, r.field_name) == ("t", "cell")
        out.setdefault(r.row_id, []).append((r.item_no, r.item_text))
    return [[t for _, t in out.get(i, [])] for i in range(len(cells))]


def test_cells(spark):
    cells = {
        "A-1, B-2": ["A-1", "B-2"],
        " A-1 ": ["A-1"],
        "A-1,, B-2 ,": ["A-1", "B-2"],
        "'A-1' | “B-2”\r\nC-3": ["A-1", "B-2", "C-3"],
        "https://x.example/browse/A-1?focused=1;B-2": ["https://x.example/browse/A-1?focused=1", "B-2"],
        '["Alpha", "Beta"]': ["Alpha", "Beta"],
        "Read; Write; Delete, Data Types - Metadata; Data Types": ["Read; Write; Delete", "Data Types - Metadata", "Data Types"],
        r"Read\; Write\; Delete|Lab Order \| Panel": ["Read; Write; Delete", "Lab Order | Panel"],
        '"The ""Core"" Set",The "Core" Set': ['The "Core" Set', 'The "Core" Set'],
        "'Provider's Index';Provider's Index": ["Provider's Index", "Provider's Index"],
        "Coverage &amp; Claims; search (chained, reverse)": ["Coverage & Claims", "search (chained, reverse)"],
        "": [],
        " , ;": [],
        None: [],
    }
    assert split(spark, list(cells), NAMES, ALL) == list(cells.values())


def test_inference_rejects_cutting_delimiters(spark):
    cells = ["A/B", "C/D/E", "F", "G / H"]
    df = spark.createDataFrame([(c,) for c in cells], "cell string")
    assert "slash" in infer_delimiters(df, Source("t", "cell"))
    dates = spark.createDataFrame([("2020/01/02, 2020/01/03",), ("2021/05/06",)], "cell string")
    assert "slash" not in infer_delimiters(dates, Source("t", "cell"))
    assert "comma" in infer_delimiters(dates, Source("t", "cell"))


def test_scores_cover_all_cells(spark):
    df = spark.createDataFrame([("A, B",), ("C, D",), ("E,",), ("F",)], "cell string")
    rows = {r.delimiter: r for r in score_delimiters(df, Source("t", "cell")).collect()}
    assert rows["comma"].cells == 3
    assert rows["blank"].consistency == 1.0
    assert abs(rows["comma"].consistency - 2 / 3) < 1e-9
    assert rows["comma"].regularity == 1.0


def test_empty_table_and_repeats(spark):
    assert split(spark, []) == []
    df = spark.createDataFrame([(1, "A,B", 9), (1, "A,B", 9)], "id int, cell string, item_no int")
    assert split_values(df, Source("t", "cell"), F.col("id"), F.col("cell"), ALL).count() == 4


def test_long_cell(spark):
    assert [len(x) for x in split(spark, ["A-1, " * 20_000], (), ALL)] == [20_000]


def test_odd_long_cells(spark):
    word, quoted, escaped = "x" * 300_000, '"' + "y, " * 100_000 + '"', "a" + r"\," * 900
    got = split(spark, [f"{word};{quoted};z", escaped, "'" * 50_000, '"' * 50_001, "\\" * 50_001, " " * 200_000 + "q" + " " * 200_000 + ";r"], (), ALL)
    assert [len(v) for v in got[0]] == [300_000, 300_000 - 1, 1]
    assert got[1] == ["a" + "," * 900]
    assert got[5] == ["q", "r"]


def test_entities_in_general(spark):
    cells = {
        "Caf&eacute;;B&#x27;s; A&#38;B": ["Café", "B's", "A&B"],
        "x&#0059;y": ["x", "y"],
        "a &amp;amp b": ["a &amp b"],
        "&#128512;,&#150;": ["😀", "–"],
        "q&#160;r&nbsp;s, &notanentity z &#xD800;x": ["q r s", "&notanentity z \ufffdx"],
    }
    assert split(spark, list(cells), (), ("comma", "semicolon")) == list(cells.values())


def test_values_beyond_the_bound(spark):
    quoted, single, escaped = '"' + 'a "", b' * 3000 + '"', "'" + "it's, " * 3000 + "x'", "a" + r"\," * 5000
    pathological = "'a;" * 20_000
    got = split(spark, [f"{quoted};c", f"{single}, d", escaped, pathological, '"Read; Write; Delete", e, ' + "''," * 600, "'" + "it's, " * 700 + "x', y"], NAMES, ALL)
    assert got[0] == ['a ", b' * 3000, "c"]
    assert got[1] == [("it's, " * 3000 + "x"), "d"]
    assert got[2] == ["a" + "," * 5000]
    assert got[3] == ["'a"] * 20_000
    assert got[4][:2] == ["Read; Write; Delete", "e"]
    assert got[5] == ["it's, " * 700 + "x", "y"]
    # the scoring reads such a value as one, too
    df = spark.createDataFrame([(quoted,), ("x;y",), ("z",)], "cell string")
    assert {r.delimiter: r.cells for r in score_delimiters(df, Source("t", "cell")).collect()} == {"semicolon": 1}


def test_rare_cuts_choose_no_delimiter(spark):
    """A slash that stands in a thousand cells but cuts one of them separates nothing."""
    cells = [f"w{i}/" for i in range(999)] + ["a/b", "c, d", "e"]
    df = spark.createDataFrame([(c,) for c in cells], "cell string")
    assert "slash" not in infer_delimiters(df, Source("t", "cell"))
    assert "comma" in infer_delimiters(df, Source("t", "cell"))


def test_evidence_names_the_deciding_pass(spark):
    dates = spark.createDataFrame([("2020/01/02, 2020/01/03",), ("2021/05/06",)], "cell string")
    words = spark.createDataFrame([("a;b",), ("c",)], "cell string")
    chosen, evidence = infer_all([(dates, Source("t", "d")), (words, Source("t", "w"))])
    assert "comma" in chosen[0] and "slash" not in chosen[0] and chosen[1] == ("semicolon",)
    last = {e.source.field: max(x.pass_no for x in evidence if x.source == e.source) for e in evidence}
    assert last == {"d": 2, "w": 1}
    assert all(not e.chosen for e in evidence if e.pass_no < last[e.source.field])


def test_dictionaries_of_any_size(spark):
    names = [*NAMES, *(f"Name {i}; of many" for i in range(30_000))]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert set(known_names(df.limit(3), "n")) == {"known"} and set(known_names(df, "n")) == {"names"}
    cells = ["Read; Write; Delete, Data Types - Metadata; Data Types", r"Read\; Write\; Delete|Lab Order \| Panel", "Name 29999; of many;x, name 7;  OF many", "'Provider's Index';Provider's Index", "q;r", None, "", "q;r"]
    rows = spark.createDataFrame(list(enumerate(cells)), "id int, cell string")
    both = []
    for source in (Source("t", "cell", **known_names(df, "n")), Source("t", "cell", (*NAMES, "Name 29999; of many", "Name 7; of many"))):
        assert infer_delimiters(rows.select("cell").where("cell <> ''"), source) == infer_delimiters(rows.select("cell").where("cell <> ''"), Source("t", "cell", (*NAMES, "Name 29999; of many", "Name 7; of many")))
        both.append(sorted((r.row_id, r.item_no, r.item_text) for r in split_values(rows, source, F.col("id"), F.col("cell"), ALL).collect()))
    assert both[0] == both[1]
    assert [t for i, _, t in both[0] if i == 2] == ["Name 29999; of many", "x", "name 7;  OF many"]
