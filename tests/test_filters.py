"""Row filters and line editors: what stays of small inputs, bounds on both sides, null and empty texts."""

import pytest

from siltstone.operators import filters as f

A, N = "a" * 10_000, None
CASES = [
    (lambda: f.LoremIpsumFilter(), ["Ferries leave the pier at noon.", "lorem ipsum, said the draft", "A page with LoReM IPSUM in the middle of it", "", N], [0, 3]),
    (lambda: f.CurlyBraceFilter(), ["no braces (at all)", "a set {1, 2}", "", N], [0, 2]),
    (lambda: f.MinLinesFilter(3), ["oak\nelm\nash", "oak\nelm", "oak\n \nelm", "", N], [0]),
    (lambda: f.LengthFilter(6, 2), ["to", "tom", "toms", "tombs", "tomato", "", N], [1, 2, 3]),
    (lambda: f.PunctuationFilter(0.5), ["Snow fell!\nRoads closed", "Snow fell\nRoads closed", "", N], [0]),
    (lambda: f.BadWordsFilter(["dratted", "old goat", "🖕"]), ["a kind remark", "that DRATTED kettle", "undratteds are fine", "you Old; Goat", "x🖕y", "", N], [0, 2, 5]),
    (lambda: f.GzipCompressionFilter(0.3, 0.9), ["Seven boats were moored along the grey canal wall. " * 3, A, "fog", "", N], [0]),
    (lambda: f.DigitRatioFilter(0.2), ["lighthouse", "door7", "room42", "", N], [0, 1]),
    (lambda: f.NonAlphaNumericFilter(0.25), ["tin roof", "fog&", "fog&&&", "", N], [0, 1]),
    (lambda: f.EllipsisFilter(0.5), ["And so on…\nThe end.", "And so on…\nRead more", "", N], [0]),
    (lambda: f.WordCountFilter(3, 4), ["red fox", "red fox ran", "red fox ran off", "red fox ran off again", "", N], [1, 2]),
    (lambda: f.RepeatedParagraphsFilter(0.7), ["Oak\n\nElm\n\nAsh", "Oak\n\nOak\n\nOak", "", N], [0]),
    (lambda: f.RepeatedLinesFilter(0.7), ["Oak\nElm\nAsh", "Oak\nElm\nAsh\nOak", "Oak\nElm\nOak", "", N], [0, 1]),
    (lambda: f.StopWordDensityFilter(0.5, ["of", "in"]), ["OF mice IN barns", "of grey mice barns", "offer inn", "", N], [0]),
    (lambda: f.StopWordFilter(2, ["of", "in"]), ["OF mice IN barns", "of grey mice barns", "offer inn", "in in barns", "", N], [0, 3]),
    (lambda: f.TableRatioFilter(0.5), ["rain\nwind", "| 3 | 4 |\nrain", "| 3 | 4 |\n3\t4\t5", "", N], [0, 1]),
    (lambda: f.AlphabeticWordsFilter(0.5), ["grey owl", "grey owl 77 8-9", "owl 77 8-9", "", N], [0, 1]),
    (lambda: f.BulletsFilter(0.5), ["salt\nrye", "● salt\nrye", "● salt\n◦ rye", "- salt\n- rye", "", N], [0, 1, 3]),
    (lambda: f.SymbolsToWordsFilter(0.25), ["rye oat hay flax", "# rye oat hay", "rye oat ... hay", "# rye ... oat", "# rye # oat", "… rye … oat", "", N], [0, 1, 2, 3]),
    (lambda: f.RepeatingTopNGramsFilter(2, 0.625), ["ox hen ram ewe", "ox ox ox", "ox hen ox hen", "ox", "", N], [0, 1]),
    (lambda: f.RepeatingDuplicateNGramsFilter(2, 8 / 11), ["ox ox ewe ram", "ox ox ox ox", "ox ox ox ox ox", "ox", "", N], [0, 1]),
    (lambda: f.RepeatedLinesByCharFilter(0.75), ["ox\ngoat", "ox\ngoat\nox", "ox\ngoat\ngoat", "", N], [0, 1]),
    (lambda: f.RepeatedParagraphsByCharFilter(0.75), ["ox\n\ngoat", "ox\n\ngoat\n\nox", "ox\n\ngoat\n\ngoat", "", N], [0, 1]),
    (lambda: f.MeanWordLengthFilter(3, 4), ["o ox", "elm ash", "  oak\tpine\n", "pine palm", "o!! x??", "blé thé", "chestnut sycamore", "", " \t\n", N], [1, 2, 3, 4, 5]),
    (lambda: f.BoilerPlateStringFilter(0.4), ["no notice", "oak\n\nelm\n\nash\n\nOur cookie policy\n\nsee the TERMS OF USE", "oak\n\nOur cookie policy\n\nsee the TERMS OF USE", "oak\n\nlorem ipsum", "", N], [0, 1]),
]


@pytest.mark.parametrize("make, texts, kept", CASES, ids=lambda x: None)
def test_row_filter(spark, make, texts, kept):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, measure string")
    assert sorted(r["id"] for r in make()(df).collect()) == kept


def test_defaults_are_those_of_the_sql(spark):
    from siltstone import catalog

    for name, (_, _, make, _) in catalog._MEASURES.items():
        if name in catalog._BOUNDS:
            g = make()
            assert (g.low, g.high, g.strict) == catalog._BOUNDS[name], name


EDITS = [
    (lambda: f.TerminalPunctuationLineFilter(), ["Snow fell.\nroads and rails\nAll closed?", "", N], ["Snow fell.\nAll closed?", "", N]),
    (lambda: f.MinWordsLineFilter(5), ["rye oat hay flax hemp\nrye oat\nox hen ram ewe cow cat"], ["rye oat hay flax hemp\nox hen ram ewe cow cat"]),
    (lambda: f.JavascriptLineFilter(), ["salt\nplease allow Javascript\nno javaSCRIPT here\nrye"], ["salt\nrye"]),
    (lambda: f.BoilerPlateLineFilter(), ["our Cookie Policy\nSnow fell.\nit uses cookies", "oak\n\nelm", "cookie policy\nterms of use"], ["Snow fell.", "oak\n\nelm", ""]),
]


@pytest.mark.parametrize("make, texts, want", EDITS)
def test_line_editor(spark, make, texts, want):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    assert [r["text"] for r in make()(df).orderBy("id").collect()] == want


def test_filters_are_idempotent_and_monotone(spark):
    texts = ["the ox and the hen " * k for k in range(1, 8)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    kept = []
    for least in (5, 10, 20):
        once = f.WordCountFilter(least)(df)
        ids = {r["id"] for r in once.collect()}
        assert ids == {r["id"] for r in f.WordCountFilter(least)(once).collect()}
        kept.append(ids)
    assert kept[2] <= kept[1] <= kept[0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, text string")
    assert f.WordCountFilter()(df).count() == 0 and f.GzipCompressionFilter()(df).count() == 0


def test_measures_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a b c")], "id int, text string")
    row = f.measure_all(df, [f.WordCountFilter(), f.LengthFilter()]).first()
    assert (row["m_WordCountFilter"], row["m_LengthFilter"]) == (3, 5)
