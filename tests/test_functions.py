import pytest
from pyspark.sql import functions as F

from heddle.functions import links as L
from heddle.functions import text as T
from heddle.functions import titles
from heddle.operators import quality

HEX = "ab" * 20
CANONICAL = [
    ("  HTTP://Shop.Sample/Page?Key=B&key=a\n", "http://shop.sample/Page?Key=B&key=a"),
    ("https://shop.sample:00443/p", "https://shop.sample/p"),
    ("http://shop.sample:0080", "http://shop.sample"),
    ("http://shop.sample:443/p", "http://shop.sample:443/p"),
    ("https://SHOP.sample/p#part", "https://shop.sample/p"),
    ("https://shop.sample/%2e%2E/a%20b", "https://shop.sample/%2e%2E/a%20b"),
    ("http://[2606:4700::9]:80/x", "http://[2606:4700::9]/x"),
    ("https://shop.sample/ж", "https://shop.sample/%D0%B6"),
    (f"magnet:?dn=x&xt=urn:btih:{HEX}", f"magnet:?dn=x&xt=urn:btih:{HEX}"),
]
REJECTED = [
    (" ", "empty"), (None, "empty"), ("http://shop.sample/a\x7fb", "control_character"), ("mailto:someone", "unsupported_scheme"), ("http:///p", "missing_host"), ("http://me@shop.sample", "credentials"),
    ("http://shop.sample:/p", "invalid_port"), ("http://shop.sample:8o/p", "invalid_port"), ("http://shop.sample:99999/p", "invalid_port"), ("http://shop.sample/%4", "invalid_url"), ("http://127.8.8.8/p", "local_target"),
    ("http://172.20.1.1", "local_target"), ("http://169.254.7.7", "local_target"), ("http://printer.localhost", "local_target"), ("http://[fd00::2]/", "local_target"), ("magnet:?xt=urn:btih:abc", "invalid_magnet"),
]


def test_links(spark):
    rows = CANONICAL + REJECTED
    df = L.with_link(spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, raw string"), "raw", "x").select("i", "x")
    got = {r["i"]: r["x"] for r in df.collect()}
    for i, (raw, want) in enumerate(rows):
        assert (got[i]["canonical"] if i < len(CANONICAL) else got[i]["rejection"]) == want, raw
        assert (got[i]["canonical"] is None) == (got[i]["rejection"] is not None)


def test_canonical_is_stable(spark):
    df = spark.createDataFrame([(c,) for _, c in CANONICAL], "raw string")
    assert L.with_link(df, "raw").filter(~F.col("link.canonical").eqNullSafe(F.col("raw"))).count() == 0


def one(spark, value, *f):
    return spark.range(1).select(*[g(F.lit(value)) for g in f]).first()


@pytest.mark.parametrize(("raw", "build", "search"), [("Ёж  и ёлка, C#!", "ёж и елка c#", "еж и елка, c#!"), ("x http://y.sample/z w", "x w", "x http://y.sample/z w"), (" \t", "", ""), (None, None, None)])
def test_normalizers(spark, raw, build, search):
    assert tuple(one(spark, raw, lambda c: T.normalize(c.cast("string")), lambda c: T.search_text(c.cast("string")))) == (build, search)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("- • — Drawing", "Drawing"), ("''’[A] b", "[A] b"), ("' [A] b", "' [A] b"), ('"[A] b', '"[A] b'), ("'quoted'", "'quoted'"), ("-Dash", "-Dash"), ("- ", "-"), ("  x ", "x"), ("• x", "• x"), ("•  x", "x")],
)
def test_clean_title(spark, raw, want):
    assert one(spark, raw, T.clean_title)[0] == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Ann Lee] Knots | bows", ("Ann Lee", "Knots | bows")), ("Ann] Knots] more", ("Ann", "Knots] more")), ("Ann [x] Knots", None), ("] Knots", None), ("Ann] ", None), ("[Ann| Knots", ("Ann", "Knots")), ("[Ann|] Knots]", ("Ann", "Knots]")),
        ("[Ann] | Knots", ("Ann]", "Knots")), ("[Ann| ] Knots", ("Ann", "] Knots")), ("[|Knots", None), ("[Ann] Knots", None), ("Knots", None), ("Ann]\nKnots\nbows", ("Ann", "Knots\nbows")),
    ],
)
def test_malformed_author(spark, raw, want):
    got = one(spark, raw, T.malformed_author)[0]
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("title", "author", "raw", "year", "want"),
    [
        ("09.11", "Fair  07.11", "[Club] Fair 07.11 ― 09.11\ntext", None, ("Club", "Fair 07.11 ― 09.11")),
        ("09.11", "Fair 07.11", "[[Club]] Fair 07.11 ― 09.11 (2021)", 2021, ("Club", "Fair 07.11 ― 09.11")),
        ("09.11", "Fair 07.11", "[ ][Club] [x] Fair 07.11―09.11", None, ("Club", "Fair 07.11 ― 09.11")),
        ("09.11", "Fair 07.11", "[Club] Fair 07.11 - 09.11", None, None), ("09.11", "Fair", "[Club] Fair ― 09.11", None, None), ("9.11", "Fair 07.11", "[Club] Fair 07.11 ― 09.11", None, None),
        ("09.11", None, "[Club] Fair 07.11 ― 09.11", None, None), ("09.11", "Fair 07.11", "Fair 07.11 ― 09.11", None, None), ("09.11", "Fair 07.11", "[] Fair 07.11 ― 09.11", None, None), ("Fair", "Fair 07.11", "[Club] Fair 07.11 ― Fair", None, None),
    ],
)
def test_date_range_heading(spark, title, author, raw, year, want):
    row = spark.createDataFrame([(title, author, raw, year)], "t string, a string, r string, y int").select(T.date_range_heading("t", "a", "r", "y").alias("m")).first()
    assert (tuple(row["m"]) if row["m"] else None) == want


@pytest.mark.parametrize(("raw", "want"), [("see  u\t now", "see now"), ("u", "u"), ("u v", "v"), ("v u", "v"), ("v u u w", "v w"), ("u u", "u"), ("a  b", "a  b"), ("a  b u", "a  b"), ("xu", "xu"), ("", "")])
def test_without_words(spark, raw, want):
    assert one(spark, raw, lambda c: T.without_words(c, F.array(F.lit("u"))))[0] == want


def test_titles_and_keys(spark):
    row = spark.createDataFrame([("Weaving (2019", 2019)], "t string, y int").select(T.identity_title(T.clean_title("t"), "y").alias("t"), T.identity_title("t", F.lit(2018)).alias("u"), T.nfc(F.lit("é")).alias("n"), T.stable_id(T.identity_key("t", F.lit(None))).alias("k")).first()
    assert (row["t"], row["u"], row["n"], len(row["k"])) == ("Weaving", "Weaving (2019", "é", 39)


TITLES = [
    ("Pletenie korzin dlya doma", "Плетение корзин для дома"),
    ("Rezba po derevu s nulya", "Резба по дереву с нуля"),
    ("Chudesnyiy sad s nulya", "Чудесный сад с нуля"),
    ("12.[Masterskaya] Shitye dlya doma", "[Masterskaya] Шитые для дома"),
    ("Onlayn-vstrecha «Zimniy sad»", "Онлайн-встреча «Зимний сад»"),
    ("Ukrashenie ob'ekta dlya sada", "Украшение обьекта для сада"),
    ("Verstka na page.html s nulya", "Верстка на page.html с нуля"),
    ("host.sample", "host.sample"),
    ("Lektsiya dlya http://host.sample/za-chto s nulya", "Лекция для http://host.sample/za-chto с нуля"),
    ("Lektsiya dlya me@host.sample s nulya", "Лекция для me@host.sample с нуля"),
    ("Lektsiya dlya arhiv_77_RAW_disk s nulya", "Лекция для arhiv_77_RAW_disk с нуля"),
    ("Lektsiya dlya sezon7 s nulya", "Лекция для sezon7 с нуля"),
    ("Lektsiya dlya MAX s nulya", "Лекция для MAX с нуля"),
    ("Lektsiya dlya PowerTool s nulya", "Лекция для PowerTool с нуля"),
    ("Lektsiya dlya [Some Words] s nulya", "Лекция для [Some Words] с нуля"),
    ("Lektsiya dlya (Some Words) s nulya", "Лекция для (Some Words) с нуля"),
    ("Садовник ЛЮКС", "Садовник ЛЮКС"),
    ("Growing roses", "Growing roses"),
    ("Salt &amp; pepper", "Salt & pepper"),
    ("Two  blanks\tand more", "Two  blanks\tand more"),
    ("Red__Green  Blue", "Red Green  Blue"),
    ("Red_Green_Blue", "Red Green Blue"),
    ("http://host.sample/a_b", "http://host.sample/a_b"),
    ("Read disk_88_RAW now", "Read disk_88_RAW now"),
    ("Disk_88_RAW", "Disk 88 RAW"),
    ("""«"3.[Klub]_Sad&nbsp;dlya​ doma""", "[Klub] Сад для дома"),
    ('"[Klub] sad"', '"[Klub] sad"'),
    ("«[Klub] sad»", "«[Klub] sad»"),
    ('"[Klub] sad', "[Klub] sad"),
    ("3.[] sad", "3.[] sad"),
    ("`[Klub] sad", "`[Klub] sad"),
    (None, None),
]


@pytest.mark.parametrize(("raw", "want"), TITLES)
def test_transliteration(raw, want):
    assert titles.normalize(raw) == want
    assert titles.normalize(want) == want


FORCED = titles.Rules(protected_exact=frozenset({"F#", "Vue"}), protected_ci=frozenset({"3d"}), force_tokens=frozenset({"rusmetka", "metking"}), force_phrases=("staryiy lad",))


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Simple rusmetka note", "Симпле русметка ноте"), ("Simple Staryiy lad note", "Симпле Старый лад ноте"), ("Simple [rusmetka] note", "Simple [rusmetka] note"), ("Simple http://a.sample/?rusmetka note", "Simple http://a.sample/?rusmetka note"),
        ("Simple rusmetka.sample note", "Simple rusmetka.sample note"), ("Simple [staryiy lad] note", "Simple [staryiy lad] note"), ("Simple Metking note", "Симпле Меткинг ноте"), ("Simple RusMetka note", "Симпле Русметка ноте"),
    ],
)
def test_forced_titles(raw, want):
    assert titles.normalize(raw, FORCED) == want


def test_title_job(spark):
    df = spark.createDataFrame([(1, "Kniga dlya doma i sada s nulya"), (2, "x"), (3, None), (4, "5.[Клуб] сад")], "id int, title string")
    got = {r["id"]: (r["title"], r["title_changed"]) for r in titles.normalize_titles(df, "title").collect()}
    assert got == {1: ("Книга для дома и сада с нуля", True), 2: ("x", False), 3: (None, False), 4: ("[Клуб] сад", True)}


def test_rule_table(spark):
    good = [("protected_exact", "Vue"), ("protected_ci", "3d"), ("protected_substring", "soft"), ("force_token", "Metking"), ("force_phrase", "staryiy  lad")]
    schema = "kind string, value string"
    assert quality.title_rule_rules(spark.createDataFrame(good, schema)).count() == 0
    rules = titles.rules_of(spark.createDataFrame(good, schema), underscores=False)
    assert rules.force_phrases == ("staryiy lad",) and rules.force_tokens == {"metking"} and rules.protected_exact == {"Vue"} and not rules.underscores
    bad = [("odd", "x"), ("protected_ci", " y"), ("force_phrase", "single"), ("force_token", "two words"), ("force_token", "a_b"), ("force_token", "Microsoft"), ("protected_substring", "soft"), ("protected_ci", "vue"), ("protected_exact", "Vue"), ("protected_ci", "VUE"), ("force_token", "")]
    got = {r["rule"] for r in quality.title_rule_rules(spark.createDataFrame(bad, schema)).collect()}
    assert got == {"kind", "trimmed", "phrase_of_one_word", "title_word", "protected_word", "shadowed_by_protection", "exact_and_ci", "duplicate_value"}


def test_words_in_brackets_are_one_piece():
    from heddle.functions import titles

    pieces = titles._pieces("Kurs dlya [odin dva tri. (chetyre) pyat] s nulya", titles.Rules())
    assert "".join(p.text for p in pieces) == "Kurs dlya [odin dva tri. (chetyre) pyat] s nulya"
    assert [p.text for p in pieces if p.word and p.kept] == ["odin", " dva tri. ", "chetyre", " ", "pyat"]
    assert titles.normalize("Kurs dlya [odin dva\u00ad tri] s nulya") == "Курс для [odin dva tri] с нуля"
