from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import personal_data as P

SECRET = b"of the tests"
GIVEN, FAMILY = ("Béatrix", "Zelda-Ann", "Orlind"), ("O'Terrick", "Van Hoersel", "Ashgrove-Lunt", "Kestrow")
PEOPLE = P.Directory(GIVEN, FAMILY)


def surrogate(kind, key, written, attempt):
    return P.surrogate(kind, key, written, attempt, SECRET)


def found(text):
    return [(t, k) for _, _, t, k in P.find_entities(text, GIVEN, FAMILY)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail a.b+c@x.example.org.", [("email", "abcxexampleorg")]),
        ("a-b (at) mail [dot] example now", [("email", "abmailexample")]),
        ("zed at mail dot example and", [("email", "zedmailexample")]),
        ("x&#64;y.example", [("email", "xyexample")]),
        ("<q@y.example>", [("email", "qyexample")]),
        ("clone git@code.example.org:spec/a.git", []),
        ("path Patient.name@4.0 and @param x, look at Claim.intent", []),
        ("+44 (0)20 7946 0267", [("phone", "4402079460267")]),
        ("call 001 274 555‑0113 now", [("phone", "0012745550113")]),
        ("tel:020&nbsp;7946&nbsp;0459", [("phone", "02079460459")]),
        ("(461)555-0150 ext. 12", [("phone", "4615550150")]),
        ("3245550131", [("phone", "3245550131")]),
        ("instance Claim/3245550131, OID 2.16.999.1.81679.4.6", []),
        ("Slot 555-0100, shard 696-7459, build 2094-07-17, concept 3245550131", []),
        ("SSN# 901 23 1898", [("id_number", "901231898")]),
        ("soc sec: 977-08-4753", [("id_number", "977084753")]),
        ("NINO: QQ-17-96-61-C, mrn=5488-5462", [("id_number", "qq179661c"), ("id_number", "54885462")]),
        ("passport no.\nx3063728", [("id_number", "x3063728")]),
        ("The SSN slice and the MRN type", []),
        ("at 12 Old Ferry Rd. now", [("address", "12oldferryrd")]),
        ("at 43\nNorth Quay Ave", [("address", "43northquayave")]),
        ("62 bis, chemin du Lavoir", [("address", "62bischemindulavoir")]),
        ("5 avenue du Vieux Pont Then", [("address", "5avenueduvieuxpont")]),
        ("Mühlenstraße 45 / Am Alten Tor 390", [("address", "mühlenstraße45"), ("address", "amaltentor390")]),
        ("It gives 3 Way bindings and 2 Court forms on the 4 Lane chart.", []),
        ("Dr. Béatrix Kestrow", [("person", "béatrixkestrow")]),
        ("Béatrix van hoersel", [("person", "béatrixvanhoersel")]),
        ("O’Terrick, Zelda‑Ann M. said", [("person", "zeldaannmoterrick")]),
        ("@ORLIND ASHGROVE-LUNT can", [("person", "orlindashgrovelunt")]),
        ("by S. Kestrow and I", [("person", "skestrow")]),
        ("The Kestrow profile, [~okestrow]", []),
        ("Nurse Xara Newname came", [("person", "xaranewname")]),
        ("", []),
    ],
)
def test_findings(text, want):
    assert found(text) == want


def test_places_in_the_written_text():
    text = "So­me Béatrix&nbsp;Kestrow​, ok & x‑y@z.example!"
    spans = [text[s:e] for s, e, _, _ in P.find_entities(text, GIVEN, FAMILY)]
    assert spans == ["Béatrix&nbsp;Kestrow", "x‑y@z.example"] or spans == ["Béatrix&nbsp;Kestrow​", "x‑y@z.example"]


def test_frames(spark):
    rows = [(1, "mail a@b.example or Orlind Kestrow"), (1, "mail a@b.example or Orlind Kestrow"), (2, None), (3, ""), (4, "no data"), (5, "word " * 50_000 + "a@b.example")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "row_id int, text string, pii_key string")
    got = P.detect(df, F.col("row_id"), F.col("text"), PEOPLE).collect()
    assert sorted((r.row_id, r.pii_type) for r in got) == [(1, "email"), (1, "email"), (1, "person"), (1, "person"), (5, "email")]
    masked = [r.masked_text for r in P.mask(df, F.col("row_id"), F.col("text"), PEOPLE).orderBy("row_id").collect()]
    assert masked[:5] == ["mail [EMAIL] or [PERSON]"] * 2 + [None, "", "no data"]
    assert masked[5].endswith("word [EMAIL]")
    assert P.detect(df.limit(0), F.col("row_id"), F.col("text"), P.Directory()).count() == 0


def test_surrogates_are_distinct_and_stable(spark):
    people = [(i, f"Orlind {c}. Kestrow and {c.lower()}@x.example and 12{i} Old Ferry Rd and 20{i}-555-0101") for i, c in enumerate("ABCDEFGH")]
    df = spark.createDataFrame(people * 2, "i int, t string")
    rows = P.pseudonymise(df, F.col("i"), F.col("t"), PEOPLE, SECRET).collect()
    by_key = {}
    for r in rows:
        by_key.setdefault((r.pii_type, r.pii_key), set()).add(r.surrogate)
    assert all(len(v) == 1 for v in by_key.values())
    assert len({(k[0], *v) for k, v in by_key.items()}) == len(by_key)
    again = {(r.pii_type, r.pii_key): r.surrogate for r in P.pseudonymise(df, F.col("i"), F.col("t"), PEOPLE, SECRET).collect()}
    assert {k: {v} for k, v in again.items()} == by_key
    assert not {k[1] for k in by_key} & {P.entity_key(s) for v in by_key.values() for s in v}


MENTION = "pii_type string, pii_key string, entity_key string, given_key string, initials boolean, gender string, written string"


def mentions(spark, rows):
    return spark.createDataFrame([(k, i, i, g, False, None, w) for k, i, g, w in rows], MENTION)


def test_surrogates_left_over_are_numbered(spark):
    rows = P.surrogates(mentions(spark, [("person", f"k{i}", "k", "A. B") for i in range(600)]), SECRET, rounds=1).collect()
    assert len(rows) == 600 == len({r.surrogate for r in rows})


def test_dense_numbers_stay_distinct_and_in_format(spark):
    every = spark.range(90_000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("n"))
    df = every.select(F.lit("id_number").alias("pii_type"), F.col("n").alias("pii_key"), F.col("n").alias("entity_key"), F.lit("").alias("given_key"), F.lit(False).alias("initials"), F.lit(None).cast("string").alias("gender"), F.col("n").alias("written"))
    out = P.surrogates(df, SECRET)
    got = out.agg(F.count("*").alias("n"), F.count_distinct("surrogate").alias("d"), F.count_if(F.col("surrogate").rlike("^[0-9]{5}$")).alias("f"), F.count_if(F.col("surrogate") == F.col("written")).alias("same")).first()
    assert tuple(got) == (90_000, 90_000, 90_000, 0)


def test_permutation():
    for size in (1, 2, 3, 10, 97, 1000):
        p = P.Permutation(SECRET, "t", size)
        assert sorted(map(p.forward, range(size))) == list(range(size))
        assert all(p.backward(p.forward(x)) == x for x in range(size))
        assert sorted(map(p.moved, range(size))) == list(range(size))
        assert size == 1 or all(p.moved(x) != x for x in range(size))
    assert P.Permutation(b"other", "t", 1000).forward(5) != P.Permutation(SECRET, "t", 1000).forward(5) or P.Permutation(b"other", "t", 1000).forward(6) != P.Permutation(SECRET, "t", 1000).forward(6)


def test_accents_hyphens_and_family_ends():
    for attempt in range(10):
        new = surrogate("person", "k", "José Ñáñez", attempt)
        marks = [sum(map(P.unicodedata.combining, P.unicodedata.normalize("NFD", w))) > 0 for w in new.split()]
        assert marks == [True, True]
        given, family = surrogate("person", "k", "Zelda-Ann O'Terrick", attempt).split()
        assert given.count("-") == 1 and family[1] == "'"
        assert surrogate("person", "k", "Мария Петрова", attempt).endswith("ова")


@pytest.mark.parametrize("written", ["12 Oak Street", "3 De Rd", "7 Ivy Ln", "5 rue de l'Oie", "Am Alten Tor 390", "9 Via Sq"])
def test_no_word_of_a_street_name_leaks(written):
    new = surrogate("address", "k", written, 0)
    for word in ("Oak", "Ivy", "Oie", "Alten", "Via"):
        assert word not in new
    assert new.split()[-1] == written.split()[-1] or written.startswith(("5", "Am"))
    assert new != written


def test_gender_follows_titles(spark):
    df = spark.createDataFrame([(1, "Mr Alexis Kestrow and Mrs. Orlind Kestrow came"), (2, "Orlind Kestrow")], "i int, t string")
    people = P.Directory(("Alexis", "Orlind"), FAMILY)
    rows = {r.pii_key: r.surrogate.split()[0] for r in P.pseudonymise(df, F.col("i"), F.col("t"), people, SECRET).collect()}
    assert rows["orlindkestrow"].endswith("a") and not rows["alexiskestrow"].endswith("a")


def test_coreference(spark):
    texts = [
        "Orlind Kestrow wrote; O. Kestrow agreed. Mail orlind.kestrow@lab.example or okestrow@lab.example.",
        "Only O. Kestrow here, and B. Kestrow.",
        "Béatrix Kestrow and Bob Kestrow met B. Kestrow; beatrix_kestrow@other.example",
        "Bob Kestrow, alias B. Kestrow, and zz@lab.example",
    ]
    people = P.Directory((*GIVEN, "Bob"), FAMILY)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = P.pseudonymise(df, F.col("i"), F.col("t"), people, SECRET).collect()
    of = lambda i, key: next(r for r in rows if r.row_id == i and r.pii_key == key)
    orlind, bob, bea = (of(i, k).surrogate for i, k in ((0, "orlindkestrow"), (2, "bobkestrow"), (2, "béatrixkestrow")))
    assert len({orlind, bob, bea}) == 3
    for i in (0, 1):
        assert of(i, "okestrow").entity_key == "orlindkestrow"
        assert of(i, "okestrow").shown == f"{orlind[0]}. {orlind.split()[1]}"
    # two persons fit in all texts, one in the last; where two fit it stays its own
    assert of(3, "bkestrow").entity_key == "bobkestrow"
    assert of(1, "bkestrow").entity_key == of(2, "bkestrow").entity_key == "bkestrow"
    given, family = P.folded(orlind.split()[0]), P.folded(orlind.split()[1])
    assert of(0, "orlindkestrowlabexample").shown.startswith(f"{given}.{family}@")
    assert of(0, "okestrowlabexample").shown.startswith(f"{given[0]}{family}@")
    assert of(2, "beatrixkestrowotherexample").shown.startswith(f"{P.folded(bea.split()[0])}_{P.folded(bea.split()[1])}@")
    domain = lambda r: r.shown.split("@")[1]
    assert domain(of(0, "okestrowlabexample")) == domain(of(3, "zzlabexample")) != domain(of(2, "beatrixkestrowotherexample"))


def test_secret_decides(spark):
    assert surrogate("phone", "k", "+44 20 7946 0267", 0) != P.surrogate("phone", "k", "+44 20 7946 0267", 0, b"another")
    assert surrogate("person", "k", "Vesna Kestrow", 0) != P.surrogate("person", "k", "Vesna Kestrow", 0, b"another")


def test_long_runs_before_a_number():
    assert found("concept" + " " * 60 + "3245550131") == found("rowId: 3245550131") == found("ID=3245550131") == []
    assert found("Orlind Kestrow 3245550131") == [("person", "orlindkestrow"), ("phone", "3245550131")]
    assert found("Orlind Kestrow\n3245550131") == [("person", "orlindkestrow"), ("phone", "3245550131")]
    assert found("in der " + "Donau" * 12 + "straße 45")[0][1] == "donau" * 12 + "straße45"


def test_surrogate_keeps_the_form():
    assert surrogate("person", "k", "VESNA KESTROW", 0).isupper()
    assert surrogate("person", "k", "vesna kestrow", 0).islower()
    assert surrogate("person", "k", "Kestrow, Vesna", 0).count(",") == 1
    assert surrogate("person", "k", "Vesna Kestrow", 0).split()[0].endswith("a")
    assert surrogate("phone", "k", "+44 20 7946 0267", 0).startswith("+44 ")
    number = surrogate("id_number", "k", "QQ-17-96-61-C", 0)
    assert [c.isdigit() for c in number] == [c.isdigit() for c in "QQ-17-96-61-C"]
    assert surrogate("address", "k", "12 Old Ferry Rd", 0).endswith("Rd")
    assert surrogate("address", "k", "Birkenallee 9", 0).split()[0].endswith("allee")
    assert surrogate("address", "k", "62 bis, chemin du Lavoir", 0).split()[2] == "chemin"


@pytest.mark.parametrize("written", ["a.kestrow+fhx@lab.example.org", "BEA-K@MAIL.EXAMPLE", "bea7 (at) lab [dot] example [dot] org", "x at y dot example", "q @ y.example"])
def test_surrogate_email_is_one(written):
    new = surrogate("email", "k", written, 0)
    assert [t for _, _, t, _ in P.find_entities(new, (), ())] == ["email"]
    assert new.isupper() == written.isupper() and ("(at)" in new) == ("(at)" in written) and ("+" in new) == ("+" in written)
    assert "kestrow" not in new and new != surrogate("email", "other", written, 0)


@pytest.mark.parametrize(
    ("kind", "written", "script"),
    [("person", "Мария Петров", "CYRILLIC"), ("person", "Νίκος Ψαρός", "GREEK"), ("person", "王小明 李", "CJK"), ("person", "김 민수", "HANGUL"), ("email", "мария@x.example", "CYRILLIC"), ("address", "12 Ленина Rd", "CYRILLIC")],
)
def test_surrogate_keeps_the_script(kind, written, script):
    import unicodedata

    new = surrogate(kind, "k", written, 0)
    place = next(i for i, c in enumerate(new) if c.isalpha())
    assert unicodedata.name(new[place]).startswith(script)
    assert P.entity_key(new) != P.entity_key(written)


def test_gender_of_given_names_only():
    for attempt in range(30):
        assert surrogate("person", "k", "Maria Rossi", attempt).split()[0].endswith("a")
        assert not surrogate("person", "k", "Orlind Rossi", attempt).endswith("a")
        assert surrogate("person", "k", "Rossi, Maria", attempt).endswith("a")
        assert surrogate("person", "k", "Мария Петров", attempt).split()[0].endswith("а")


def test_mentions_keep_their_own_form(spark):
    texts = ["By ORLIND KESTROW.", "By Orlind Kestrow.", "By Kestrow, Orlind.", "By orlind\nkestrow.", "Q.Q@MAIL.EXAMPLE", "q.q (at) mail [dot] example", "SSN 901 23 1898", "SSN 901-23-1898", "12 Old Ferry RD now", "12, old ferry rd now", "(461) 555-0150", "461.555.0150"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = {r.row_id: r for r in P.pseudonymise(df, F.col("i"), F.col("t"), PEOPLE, SECRET).collect()}
    shown = [rows[i].shown for i in range(len(texts))]
    given, family = shown[1].split()
    assert shown[:4] == [f"{given} {family}".upper(), f"{given} {family}", f"{family}, {given}", f"{given}\n{family}".lower()]
    assert shown[4].isupper() and shown[5].islower() and " (at) " in shown[5] and " [dot] " in shown[5]
    assert shown[9].startswith(shown[8][:2] + ", ") and shown[9].islower() and shown[8].endswith("RD")
    for a, b in ((4, 5), (6, 7), (8, 9), (10, 11)):
        assert rows[a].surrogate == rows[b].surrogate
    plain = lambda t: P.entity_key(t.replace("(at)", "").replace("[dot]", ""))
    assert all(plain(shown[a]) == plain(shown[b]) for a, b in ((4, 5), (6, 7), (8, 9), (10, 11)))
    for i in (6, 7, 10, 11):
        assert [c for c in shown[i] if not c.isdigit()] == [c for c in rows[i].written if not c.isdigit()]


def test_directory(spark):
    df = spark.createDataFrame([("Anna Berg",), ("Anna Van Dal",), (None,), ("Solo",), ("",)], "n string")
    assert P.directory(df, F.col("n")) == P.Directory(("Anna",), ("Berg", "Van Dal"))
    assert P.directory(df, F.col("n"), limit=1).names is not None


def test_directory_of_any_size(spark):
    """Sixty thousand names are joined with the texts' words, with the same findings as from a pattern."""
    texts = ["By Béatrix van Hoersel and Zelda-Ann O’Terrick.", "By ORLIND KESTROW", "Kestrow, Orlind; S. Kestrow", "Orlind Kestrow (copy)", "Orlind Kestrow (copy)", "no name", None, "", "Ñame&nbsp;Kestrow, Be\u0301atrix Kestrow"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    many = spark.range(60_000).select(F.concat(F.lit("Gi"), F.col("id"), F.lit(" Fa"), F.col("id")).alias("n"))
    people = many.unionByName(spark.createDataFrame([(f"{g} {f}",) for g in GIVEN for f in FAMILY], "n string"))
    large = P.directory(people, F.col("n"))
    assert large.names is not None
    rows = lambda who: sorted((r.row_id, r.start_at, r.pii_type, r.pii_key) for r in P.detect(df, F.col("i"), F.col("t"), who).collect())
    assert rows(large) == rows(PEOPLE) and len(rows(large)) == 8
    masked = lambda who: {r.row_id: r.masked_text for r in P.mask(df, F.col("i"), F.col("t"), who).collect()}
    assert masked(large) == masked(PEOPLE)


def test_replace_spans(spark):
    df = spark.createDataFrame([("abcdef", [(1, 2, "X"), (3, 5, "YY")]), (None, [(0, 1, "Z")]), ("q", None)], "t string, s array<struct<start_at: int, end_at: int, new: string>>")
    assert [r[0] for r in df.select(P.replace_spans(F.col("t"), F.col("s"))).collect()] == ["aXcYYf", None, "q"]


def test_nothing_to_find(spark):
    none = spark.createDataFrame([(1, None), (2, ""), (3, "no data at all")], "i int, t string")
    assert P.pseudonymise(none, F.col("i"), F.col("t"), P.Directory(), SECRET).count() == 0
    assert P.pseudonymise(none.limit(0), F.col("i"), F.col("t"), PEOPLE, SECRET).count() == 0


def test_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "O. Kestrow"), (1, "Orlind Kestrow"), (None, "O. Kestrow")], "i int, t string")
    rows = P.pseudonymise(df, F.col("i"), F.col("t"), PEOPLE, SECRET).collect()
    assert len(rows) == 3 and {r.entity_key for r in rows} == {"orlindkestrow"}


@pytest.mark.parametrize("written", ["(461)555-0150", "221.555.0167", "+1 274 555 0113", "+44 20 7946 0267", "020 7946 0459", "3245550131", "07700 900435", "(02) 5550 4628"])
def test_surrogate_number_is_a_number_of_its_kind(written):
    for attempt in range(5):
        new = surrogate("phone", "k", written, attempt)
        assert [t for _, _, t, _ in P.find_entities(f"call {new} now", (), ())] == ["phone"]
        assert [c for c in new if not c.isdigit()] == [c for c in written if not c.isdigit()] and new != written
