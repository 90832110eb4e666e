"""Literal cases of the text functions and the hand-worked score goldens."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from carsift.functions import formats, identity, parse, text
from carsift.functions.urls import canonical_url
from carsift.operators import keywords as kwd
from carsift.operators.alerts import alert_reason
from carsift.operators.scoring import score

CASES = {
    "price": (parse.parse_price, [("2 500 €", 2500), ("2500€", 2500), ("2.500 €", 2500), ("2,500€", 2500), ("2 500 €", 2500),
                                  ("Prix: 3 200 € négociable", 3200), (None, None), ("", None), ("gratuit", None), ("50 €", None), ("150 000 €", None), ("2500", 2500), ("400", None)]),
    "km": (parse.parse_km, [("150 000 km", 150000), ("150000km", 150000), ("150.000 km", 150000), ("85000 KM", 85000), ("beaucoup", None)]),
    "year": (lambda x: parse.parse_year(x, F.lit(2025)), [("année 2010", 2010), ("01/2012", 2012), ("2008-2012", 2012), ("1985", None), ("2030", None)]),
    "fuel": (parse.parse_carburant, [("Diesel", "diesel"), ("1.4 HDi 70ch", "diesel"), ("1.5 dCi", "diesel"), ("Essence", "essence"), ("1.2 VTi", "essence"), ("1.4", "unknown"), (None, "unknown"), ("chevaux", "electrique")]),
    "gearbox": (parse.parse_boite, [("Boîte manuelle", "manuelle"), ("BVA", "automatique"), ("5 vitesses", "unknown")]),
    "dept": (parse.parse_departement, [("75001 Paris", "75"), ("Créteil (94)", "94"), ("Paris", None)]),
    "seller": (parse.parse_seller_type, [("Particulier", "particulier"), ("Professionnel", "professionnel"), ("Garage Auto Plus", "professionnel"), ("Jean Dupont", "unknown"), ("Très propre", "professionnel")]),
    "price_fr": (lambda x: formats.format_price_fr(x.cast("int")), [("2500", "2 500 €"), (None, "N/C")]),
    "accents": (text.remove_accents, [("contrôle", "controle"), ("ÀÉÎõü", "AEIou"), ("é", "e")]),
    "keywords": (text.normalize_keywords, [("CT: OK", "ct ok"), ("prix-à-débattre", "prix a debattre"), ("  L'été !", "l ete")]),
    "brand": (parse.normalize_marque, [("vw", "Volkswagen"), ("CITROEN", "Citroën"), ("mercedes", "Mercedes-Benz"), ("alfa", "Alfa Romeo"), ("peugeot", "Peugeot"), (None, "")]),
    "url": (canonical_url, [("HTTPS://A.fr/x/?utm_source=a&b=1&b=2&searchId=9&e=&q=a%20b#f", "https://a.fr/x?b=1&b=2&searchId=9&q=a+b"), ("", ""), ("https://a.fr/?REF=1", "https://a.fr")]),
}


@pytest.mark.parametrize("name", CASES)
def test_literal_cases(spark, name):
    fn, cases = CASES[name]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", fn(F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases]


def test_titles(spark):
    cases = [("207 1.4 HDi 70ch", "Peugeot", "207"), ("Clio 3 1.5 dCi 85ch", "Renault", "Clio"), ("C3 1.4 HDi 70", "Citroën", "C3"),
             ("Sandero Stepway 1.5 dCi", "Dacia", "Sandero"), ("", "", ""), (None, "", ""), ("Renault Clio 3", "Renault", "Clio")]
    df = parse.with_title_parts(spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "i int, x string"), "x")
    got = {r.i: (r.t_marque, r.t_modele) for r in df.collect()}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]


def test_fingerprints(spark):
    lit = F.lit
    row = spark.range(1).select(
        identity.fingerprint(lit("autoscout24"), lit("123"), *[lit("")] * 2, *[lit(None).cast("int")] * 3, lit(""), lit("")).alias("f"),
        identity.fingerprint_soft(lit("Peugeot"), lit("207"), lit(2010), lit(163000), lit("75")).alias("s")).first()
    assert row.f == "8bef50d3cc8f52719cf6926033086a0f" and row.s == "bd896be8f80f873d"


@pytest.mark.parametrize("phrase,kind,expected", [
    ("ct vierge", "opp", "ct_ok"), ("ct: ok", "opp", "ct_ok"), ("vente urgente", "opp", "urgent_vente"), ("nego possible", "opp", "negociable"),
    ("contre-visite", "risk", "ct_refuse"), ("sans ct", "risk", "ct_a_faire"), ("ne démarre plus", "risk", "demarreur"), ("pour pièces", "risk", "a_reparer")])
def test_keyword_ids(spark, phrase, kind, expected):
    pad = kwd.scan_text(F.lit(phrase))
    hits, entries = (kwd.opportunity_hits(pad), kwd.opportunity_entries()) if kind == "opp" else (kwd.risk_hits(pad), kwd.risk_entries())
    assert expected in spark.range(1).select(kwd.pick(hits, [e["id"] for e in entries]).alias("x")).first().x


def test_no_hit_inside_words(spark):
    pad = kwd.scan_text(F.lit("suivie, fapx, chocolat"))
    row = spark.range(1).select(F.size(kwd.opportunity_hits(pad)).alias("o"), F.size(kwd.risk_hits(pad)).alias("r")).first()
    assert (row.o, row.r) == (0, 0)


AS_OF = dt.datetime(2026, 1, 1)
G1 = dict(marque="Peugeot", modele="207", titre="Peugeot 207 1.4 HDi 70ch Active", version="1.4 HDi 70ch", carburant="diesel", prix=1500, kilometrage=160000,
          published_at=AS_OF - dt.timedelta(hours=2), departement="75", seller_type="particulier", n_images=0, description="Prix négociable, CT ok, urgent")
G3 = dict(marque="Renault", modele="Clio", titre="Renault Clio 3", version="1.2 16v", carburant="unknown", prix=1200, kilometrage=120000, published_at=None,
          departement="69", seller_type="particulier", n_images=6, description="")
GOLD = [
    (G1, 77, "interessant", 800, 1800), (G1 | {"description": G1["description"] + ", Moteur HS"}, 25, "archive", 0, 0), (G3, 84, "urgent", 1800, 2800),
    (G3 | {"n_images": 0}, 79, "interessant", 1800, 2800), (G1 | {"description": "Epave pour pièces"}, 0, "archive", 0, 0),
    (G1 | {"marque": "BMW", "modele": "Serie 3", "titre": "BMW Serie 3"}, 0, "archive", 0, 0),
]


def test_score_goldens(spark):
    names = list(G1)
    schema = ", ".join(f"{n} {'int' if n in ('prix', 'kilometrage', 'n_images') else 'timestamp' if n == 'published_at' else 'string'}" for n in names)
    df = spark.createDataFrame([(i, *[g[n] for n in names]) for i, (g, *_) in enumerate(GOLD)], "i int, " + schema)
    got = {r.i: r for r in score(df, F.lit("2026-01-01 00:00:00").cast("timestamp")).collect()}
    for i, (_, total, level, low, high) in enumerate(GOLD):
        assert (got[i].total, got[i].alert_level, got[i].margin_min, got[i].margin_max) == (total, level, low, high), i
    assert got[0].keywords_opportunite == ["urgent", "negociable", "ct_ok", "urgent_vente"]
    assert got[3].keywords_risque == ["prix_a_verifier"]
    assert got[4].status == "exclue" and got[4].ignore_reason == "Exclusion: epave"


@pytest.mark.parametrize("old,prix,score_,reason", [
    ((2000, 60, True), 1900, 65, "already_notified"), ((2000, 60, True), 1899, 65, "price_dropped"), ((2000, 60, True), 1950, 70, "score_increased"),
    (None, 1, 60, "new"), (None, 1, 59, "score_too_low"), ((2000, 60, False), 1, 60, "score_threshold")])
def test_alert_decision(spark, old, prix, score_, reason):
    df = spark.createDataFrame([(old, prix, score_)], "e struct<prix:int,score_total:int,notified:boolean>, p int, s int")
    assert df.select(alert_reason(F.col("s"), F.col("p"), F.col("e")).alias("r")).first().r == reason
