"""Extraction, reviews, listings and cases on small made cases."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from civicmill.functions import chronology, numbers
from civicmill.operators import civic_views, extract, publish, resolve, vector
from civicmill.streaming import incremental


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_places_with_surroundings(spark):
    rows = spark.createDataFrame([(1, "a 12 €\nb, puis 3,50 € et 0 €"), (2, ""), (3, None), (4, "€ 7€")], "id int, text string")
    got = {(r["id"], r["at"]): (r["value"], r["context"]) for r in extract.amounts_in_context(rows, "id", "text", 5, 4).collect()}
    assert got == {(1, 0): (12.0, "a 12 € b,"), (1, 1): (3.5, "puis 3,50 € et"), (4, 0): (7.0, "€ 7€")}


def test_themes_count_on_pages_with_a_name_only(spark):
    pages = spark.createDataFrame([(1, 1, "Le maire de Bourg parle d'eau"), (1, 2, "eau, eau"), (1, 3, None), (2, 1, "BOURG")], "id int, page int, text string")
    got = sorted(map(tuple, extract.mentions(pages, "id", "page", "text", "(?i)bourg", "(?i)eau", 6).collect()))
    assert got == [(1, 1, "THEME:eau", "rle d'eau"), (1, 1, "bourg", "re de Bourg parle"), (2, 1, "bourg", "BOURG")]


def test_votes(spark):
    cases = ["par 12 voix « pour » et 1 abstention et 2 contre", "9 voix Pour", "à l'unanimité", "rien", None, "3 voix pour et 2 contres, à l'unanimité"]
    got = one(spark, *[extract.vote(F.lit(c)).alias(f"c{i}") for i, c in enumerate(cases)])
    assert [v and tuple(v) for v in got] == [(12, 2, 1, False), (9, 0, 0, False), (None, 0, 0, True), None, None, (3, 2, 0, False)]


def test_event_dates(spark):
    day = F.lit(date(2024, 11, 20))
    cases = [("Marché du 5 décembre", None), ("Galette le 7 janvier", None), ("Fête du 3 mai 1950", "le 2 mai 2025"), (None, None), ("30 février", "")]
    got = one(spark, *[numbers.event_date(F.lit(t), F.lit(c), day).alias(f"c{i}") for i, (t, c) in enumerate(cases)])
    assert [tuple(g) for g in got] == [(date(2024, 12, 5), "texte"), (date(2025, 1, 7), "texte"), (date(2025, 5, 2), "texte"), (date(2024, 11, 20), "publication"), (date(2024, 11, 20), "publication")]


def test_cases(spark):
    best = one(spark, *[chronology.best_outcome(F.array(*map(F.lit, o))).alias(n) for n, o in {"a": ["hors_mandat", "contemporain"], "b": ["other"], "c": ["lien_sans_flux", "anterieur_mandat"]}.items()])
    assert best == ("contemporain", "indetermine", "anterieur_mandat")
    status = lambda *v: chronology.case_status(*map(F.lit, v))
    got = one(spark, *[status(*v).alias(f"c{i}") for i, v in enumerate([(False, True, "contemporain", True), (True, True, "hors_mandat", True), (True, False, "anterieur_mandat", False), (True, False, "anterieur_mandat", True), (True, False, "contemporain", True)])])
    assert got == ("lien_sans_versement", "deport_constate", "chronologie_incertaine", "hors_mandat", "deport_non_trouve")


def test_first_act_that_speaks_of_a_case(spark):
    cases = spark.createDataFrame([(1, ["dupont"], ["sport"], 2020), (2, ["dupont"], [], 2021), (3, ["martin"], ["eau"], None), (4, [], ["eau"], 2020)], "case_id int, who array<string>, about array<string>, year int")
    acts = spark.createDataFrame([(1, "2020-05-01", ["m", "dupont"], ["sport"]), (2, "2020-01-01", ["dupont"], ["eau"]), (3, None, ["dupont"], ["x"]), (4, "1999-01-01", ["martin"], ["eau"]), (5, "1998-01-01", ["martin"], ["sol"])], "act_id int, date string, who array<string>, about array<string>")
    assert sorted(map(tuple, resolve.first_overlap(cases, acts).collect())) == [(1, 1), (2, 3), (3, 4)]


def test_contained_names(spark):
    names, texts = ["ab", "c", "dupont", "", None, "zzzz", "aaa"], ["dupont abc", "cab", "aaaa dupon", "", None]
    got = resolve.contained_pairs(spark.createDataFrame(list(enumerate(names)), "name_id int, name string"), spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"))
    assert sorted(map(tuple, got.collect())) == [(i, j) for i, n in enumerate(names) for j, t in enumerate(texts) if n and t and n in t]


def test_reviews(spark):
    facts = spark.createDataFrame([(1, 5.0, "probable"), (2, 5.0, "probable"), (3, None, "probable"), (4, 1.0, None)], "id int, amount double, confidence string")
    notes = spark.createDataFrame([(1, "rejected", None, None, None), (2, "confirmed", "verified", " vu ", {"amount": "7"}), (3, "confirmed", None, "", {"amount": "x"})], "object_id int, review_status string, confidence string, note string, corrections map<string,string>")
    got = sorted(map(tuple, publish.reviewed(facts, notes, ["amount"]).collect()))
    assert got == [(2, 7.0, "verified", ["amount"], "vu"), (3, None, "probable", None, None), (4, 1.0, None, None, None)]


def test_listing_stops_at_a_page_without_news(spark):
    rows = [("s", 1, "a"), ("s", 1, "b"), ("s", 2, "b"), ("s", 2, "c"), ("s", 3, "a"), ("s", 4, "d"), ("t", 2, "x")]
    got = incremental.listed(spark.createDataFrame(rows, "source string, page int, key string"))
    assert sorted(map(tuple, got.collect())) == [("s", 1, "a"), ("s", 1, "b"), ("s", 2, "c")]


def test_packed_vectors(spark):
    rows = spark.createDataFrame([(1, [1.5, -2.0]), (2, []), (3, None)], "id int, v array<float>")
    got = rows.select("id", vector.packed("v").alias("b")).select("id", F.hex("b").alias("h"), vector.unpacked("b").alias("v"))
    assert sorted(map(tuple, got.collect())) == [(1, "0000C03F000000C0", [1.5, -2.0]), (2, "", []), (3, None, None)]


def test_entourage(spark):
    entities = spark.createDataFrame([(1, "person"), (2, "person"), (3, "association"), (4, "business"), (5, "business")], "id int, type string")
    relations = spark.createDataFrame([(1, 1, 3, "président"), (2, 4, 1, "gérant"), (3, 1, 5, "gérant"), (4, 2, 3, "dirigeant"), (5, 2, 3, "adjoint")], "id int, from_id int, to_id int, relation_type string")
    flows = spark.createDataFrame([(1, 4), (2, 4), (3, None)], "id int, to_id int")
    got = [(r["id"], [tuple(x) for x in r["roles"]]) for r in civic_views.entourage(entities, relations, flows).collect()]
    assert got == [(1, [(3, "président", "association"), (4, "gérant", "money")])]


def test_chunks_cover_the_text(spark):
    words = " ".join(str(i) for i in range(900))
    texts = [(1, words.replace(" 7", "\n7")), (2, "short"), (3, "x" * 500), (4, "")]
    rows = extract.chunked(spark.createDataFrame(texts, "id long, text string"), "id", "text", size=200, overlap=30).collect()
    for key, text in texts:
        parts = sorted((r["n"], r["start"], r["chunk"]) for r in rows if r["id"] == key)
        assert "".join(c[max(0, e - s) :] for (_, s, c), e in zip(parts, [0] + [s + len(c) for _, s, c in parts], strict=False)) == text
        assert all(text[s : s + len(c)] == c and len(c) <= 200 for _, s, c in parts)
        for (n, s, c), (m, t, _) in zip(parts, parts[1:], strict=False):
            assert (m, t) == (n + 1, s + len(c) - 30)
            late = text[s + 100 : s + 200].rfind("\n")
            assert len(c) == (100 + late if late > 0 else 200)


def test_redaction_of_whole_names_only(spark):
    names = ["Jean Petit", "Jean", "A. (B)"]
    cases = ["Jean Petit et JEAN", "Jeanne, l'Ajean", "chez A. (B), Jean.", "", None]
    got = one(spark, *[extract.redacted(F.lit(c).cast("string"), names).alias(f"c{i}") for i, c in enumerate(cases)])
    assert got == ("[…] et […]", "Jeanne, l'Ajean", "chez […], […].", "", None)


def test_text_of_a_page(spark):
    page = "<html><head><style>p{}</style><script>var a = '<p>';</script></head><body><!-- no --><p>Un&nbsp;&amp; deux</p><table><tr><td>a</td><td>b</td></tr></table></body></html>"
    lines = [x.split() for x in one(spark, extract.html_text(F.lit(page)).alias("t"))[0].splitlines() if x.strip()]
    assert lines == [["Un", "&", "deux"], ["a", "b"]]
