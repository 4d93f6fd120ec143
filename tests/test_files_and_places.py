"""File sources, places and labels on small made cases."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import functions as F

from civicmill.functions import places, text
from civicmill.operators import extract, merge, resolve
from civicmill.sources import files, sinks


def test_csv_in_the_encoding_that_fits(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("nom;cœur\nLéonard;12 €\n".encode("cp1252"))
    (tmp_path / "utf.csv").write_text("nom;voix\nZoé;3\n", encoding="utf-8")
    with gzip.open(tmp_path / "packed.csv.gz", "wb") as f:
        f.write("nom;voix\nÉlie;7\n".encode())
    got = [files.read_csv(spark, f"file://{tmp_path}/{n}", sep=";").first()["nom"] for n in ("latin.csv", "utf.csv", "packed.csv.gz")]
    assert got == ["Léonard", "Zoé", "Élie"]
    assert files.read_csv(spark, f"file://{tmp_path}/latin.csv", sep=";").first().asDict() == {"nom": "Léonard", "cœur": "12 €"}


def test_blocks_by_number(spark):
    wide = spark.createDataFrame([("a", "x", 1, None, None), ("b", "y", 2, "z", 3)], "bureau string, `Liste 1` string, `Voix 1` int, `Liste 10` string, `Voix 10` int")
    got = {tuple(r) for r in files.unpivot_blocks(wide, ["bureau"]).collect()}
    assert got == {("a", 1, "x", "1"), ("b", 1, "y", "2"), ("b", 10, "z", "3")}


def test_contracts_of_either_root(spark, tmp_path):
    rows = [{"id": "m1", "montant": 5.0}, {"id": "m2", "montant": None}]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    with gzip.open(tmp_path / "nested.json.gz", "wt") as f:
        json.dump({"marches": {"marche": rows}}, f, indent=1)
    for name in ("list.json", "nested.json.gz"):
        got = files.read_contracts(spark, f"file://{tmp_path}/{name}", "id string, montant double")
        assert sorted(map(tuple, got.collect())) == [("m1", 5.0), ("m2", None)]


def test_decisions_without_broken_lines(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"key": "a", "outcome": "yes"}\nnot json\n{"key": "b"}\n')
    got = files.read_decisions(spark, f"file://{tmp_path}/d.jsonl", "key string, outcome string")
    assert sorted(map(tuple, got.collect()), key=str) == [("a", "yes"), ("b", None)]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_parcels(spark):
    cases = [("C", "1213"), ("ab", "7"), ("C", "12b"), ("", "1"), (None, "1"), ("c ", " 12345 ")]
    got = one(spark, *[places.parcel_key(F.lit(s), F.lit(n)).alias(f"c{i}") for i, (s, n) in enumerate(cases)])
    assert got == ("0C1213", "AB0007", None, None, None, "0C12345")


def test_location_cascade(spark):
    commune, centre = (44.0, 3.0, 45.0, 4.0), (44.4, 3.4, 44.6, 3.6)
    cases = [("person", 44.5, 3.5, False), ("business", None, 3.5, False), ("business", 44.1, 3.1, True), ("place", 46.0, 3.5, False), ("service", 44.5, 3.5, False), ("business", 44.5, 3.5, False), ("business", 44.1, 3.1, False)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, kind string, lat double, lng double, home boolean")
    quality = places.location_quality(F.col("kind"), F.col("lat"), F.col("lng"), F.col("home"), commune, centre)
    got = [tuple(r) for r in rows.select("i", "kind", quality.alias("q")).select("q", places.location_shown(F.col("q"), F.col("kind")), places.coordinates_kept(F.col("q"), F.col("kind")), "i").orderBy("i").collect()]
    want = [("hidden_person", False, False), ("missing", False, True), ("hidden_home", False, False), ("outside", False, True), ("approx_center", True, True), ("approx_center", False, False), ("usable", True, True)]
    assert [g[:3] for g in got] == want


def test_shapes(spark):
    rows = spark.createDataFrame([([[0.0, 0.0], [2.0, 0.0], [1.0, 3.0]],), ([],)], "ring array<array<double>>")
    assert [tuple(r) for r in rows.select(*places.centroid(F.col("ring"))).collect()] == [(1.0, 1.0), (None, None)]
    box = rows.select(*[F.round(c, 6) for c in places.bounding_box(F.array("ring"))]).first()
    assert tuple(box) == (-0.01, -0.01, 3.01, 2.01)


def test_buyers_by_prefix_only(spark):
    names = ["CC Causses Aigoual — service eau", "Communauté de communes Causses-Aigoual", "Syndicat des Causses Aigoual", None]
    got = one(spark, *[text.buyer_of(F.lit(n), [("caussesaigoual", "cc")]).alias(f"c{i}") for i, n in enumerate(names)])
    assert got == ("cc", "cc", None, None)


def test_birth_names(spark):
    in_use, at_birth = text.birth_name(F.lit("Anne DURAND (LE GOFF) "))
    assert one(spark, in_use, at_birth, text.surnames(F.lit("Anne DURAND de LA Tour-B (LE GOFF)"))) == ("Anne DURAND", "LE GOFF", ["DURAND"])
    in_use, at_birth = text.birth_name(F.lit("Anne DURAND"))
    assert one(spark, in_use, at_birth) == (None, None)


def test_subsidies_first_per_year_and_name(spark):
    says = "décide d'attribuer à l'{} une subvention de {} €."
    acts = [(2, "2020-05-01", says.format("Amicale", "1 500") + " Puis " + says.format("amicale", "9")), (1, "2020-01-01", says.format("École  du Bois,", "250 000")), (3, "2021-01-01", says.format("Amicale", "20")), (4, None, says.format("Amicale", "30"))]
    rows = spark.createDataFrame(acts, "id long, date string, text string").withColumn("date", F.to_date("date"))
    got = {tuple(r) for r in extract.subsidies(rows, "id", "date", "text").select("year", "beneficiary", "amount", "id").collect()}
    assert got == {(2020, "Amicale", 1500, 2), (2021, "Amicale", 20, 3)}


def test_names_within_brute_force(spark):
    names, mentions = ["jean petit", "petit", "anne le goff", " ", None], ["Petit Jean maire", "le goff", "anne petit", "goff le anne anne", None]
    n, m = (spark.createDataFrame([(x,) for x in v], f"{c} string") for v, c in ((names, "n"), (mentions, "m")))
    want = {(a, b) for a in names if a and a.strip() for b in mentions if b and set(a.lower().split()) <= set(b.lower().split())}
    assert {tuple(r) for r in resolve.names_within(n, m, "n", "m").collect()} == want


def test_journal_of_an_empty_run(spark):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "source string")
    got = {tuple(r) for r in merge.journalled(rows("a", "b"), rows("a", "b", "b", "c"), "source").collect()}
    assert got == {("a", 1, 1, 0, "empty"), ("b", 1, 2, 1, "ok"), ("c", 0, 1, 1, "ok")}


def test_near_repeats_are_scanned_greedily(spark):
    from civicmill.operators.windows import without_near_repeats

    rows = [("a", "2020-01-01", 1), ("a", "2020-05-30", 2), ("a", "2020-10-27", 3), ("a", "2022-01-01", 4), ("b", None, 5), ("b", None, 6), ("c", None, 7), ("c", "2020-01-01", 8)]
    df = spark.createDataFrame(rows, "k string, d string, id int").withColumn("d", F.to_date("d"))
    assert sorted(r["id"] for r in without_near_repeats(df, ["k"], "d", 200, "id").collect()) == [1, 3, 4, 5, 8]


def test_search_counts_words_from_their_start(spark):
    from civicmill.operators.search import search

    docs = spark.createDataFrame([(1, "Théâtre the other. Re-the"), (2, "bathe are"), (3, None), (4, "RE the")], "id int, text string")
    assert sorted(r["id"] for r in search(docs, "id", "text", "the re").collect()) == [1, 4]


def test_seeds(spark, tmp_path):
    (tmp_path / "list.json").write_text('[\n {"id": 1,\n  "name": "é"},\n {"id": 2}\n]', encoding="utf-8")
    (tmp_path / "one.json").write_text('{\n "id": 3, "name": "x", "more": []\n}')
    (tmp_path / "broken.json").write_text('{"id": 4,')
    got = files.read_seeds(spark, f"file://{tmp_path}/*.json", "id int, name string")
    assert sorted(map(tuple, got.collect())) == [(1, "é"), (2, None), (3, "x")]


def test_written_json(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é", [1, 2]), (2, None, [])], "id int, name string, years array<int>")
    for _ in range(2):  # the second write replaces the first
        sinks.write_json(rows, f"file://{tmp_path}/out")
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text(encoding="utf-8").splitlines()]
    assert sorted(lines, key=lambda r: r["id"]) == [{"id": 1, "name": "é", "years": [1, 2]}, {"id": 2, "years": []}]


def test_bundles_go_to_the_bucket_of_their_id(spark, tmp_path):
    sinks.write_bundles(spark.createDataFrame([(1, "a"), (3, "b"), (2, "c")], "id int, name string"), f"file://{tmp_path}/out", buckets=2)
    got = {p.name: sorted(json.loads(x)["id"] for f in p.glob("part-*") for x in f.read_text().splitlines()) for p in (tmp_path / "out").glob("bucket=*")}
    assert got == {"bucket=0": [2], "bucket=1": [1, 3]}
