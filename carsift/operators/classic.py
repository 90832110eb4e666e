"""The older scorer and the listing analyser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carsift.functions.formats import age_seconds, alert_level
from carsift.functions.parse import extract_contact_phone, extract_email
from carsift.functions.phrases import PhraseSet, pick
from carsift.functions.text import SPACE, blank_if_null, contains_any
from carsift.operators.identify import classic_target_ord
from carsift.operators.settle import settle
from carsift.sources.dictionaries import builtin


def _value(getter, cfg: dict) -> Column:
    return F.get(F.array(*[F.lit(getter(v)) for v in cfg["vehicles"]]), F.col("classic_ord"))


def _n_images(df: DataFrame) -> Column:
    return F.col("n_images") if "n_images" in df.columns else F.coalesce(F.size("images_urls"), F.lit(0))


def _motorisation(df: DataFrame) -> Column:
    return F.col("motorisation") if "motorisation" in df.columns else F.lit("")


def classic_text() -> Column:
    return F.lower(F.concat_ws(" ", blank_if_null("titre"), blank_if_null("description")))


def opportunity_words(text: Column, cfg: dict | None = None) -> Column:
    """Phrases of the list that occur in the text, in list order."""
    words = (cfg or builtin("classic"))["opportunity_words"]
    return pick(PhraseSet([[w] for w in words], False).hits(text), words)


def exclusion_words(text: Column, cfg: dict | None = None) -> Column:
    words = (cfg or builtin("classic"))["exclusion_words"]
    return pick(PhraseSet([[w] for w in words], False).hits(text), words)


def has_exclusion_word(text: Column, cfg: dict | None = None) -> Column:
    return F.size(exclusion_words(text, cfg)) > 0


def classic_score(df: DataFrame, as_of: Column, cfg: dict | None = None) -> DataFrame:
    """Adds score_rentabilite, its five parts, mots_cles_detectes, vehicule_cible_id, margins and niveau_alerte."""
    cfg = cfg or builtin("classic")
    c, n_images = F.col, _n_images(df)
    st = df.withColumns({
        "classic_ord": classic_target_ord(c("marque"), c("modele"), c("titre"), c("description"), _motorisation(df), cfg),
        "classic_text": classic_text(),
    })
    hit = c("classic_ord").isNotNull()
    prix, km = F.nullif(c("prix"), F.lit(0)), F.nullif(c("kilometrage"), F.lit(0))
    p_min, p_max, p_ideal = _value(lambda v: v["prix"][0], cfg), _value(lambda v: v["prix"][1], cfg), _value(lambda v: v["prix_ideal_max"], cfg)
    k_max, k_lo, k_hi = _value(lambda v: v["km"][1], cfg), _value(lambda v: v["km_ideal"][0], cfg), _value(lambda v: v["km_ideal"][1], cfg)
    minutes = age_seconds(c("published_at"), as_of) / F.lit(60)
    text = c("classic_text")
    stepway = (_value(lambda v: v["stepway"], cfg) & F.contains(text, F.lit("stepway")) & F.coalesce(prix <= p_ideal, F.lit(False)))
    twingo = F.contains(text, F.lit("twingo")) & (F.contains(text, F.lit("phase 2")) | F.coalesce(c("annee") >= 2012, F.lit(False)))
    st = st.withColumns({
        "v1_prix": F.when(prix.isNull(), 10).when((prix < p_min) | (prix <= p_ideal * 0.7), 40).when(prix <= p_ideal * 0.85, 35)
        .when(prix <= p_ideal, 30).when(prix <= p_max * 0.9, 20).when(prix <= p_max, 10).otherwise(0),
        "v1_km": F.when(km.isNull(), 10).when((km < k_lo) | (km <= k_hi), 30).when(km <= k_hi * 1.1, 25).when(km <= k_max * 0.9, 15)
        .when(km <= k_max, 5).otherwise(0),
        "v1_words": opportunity_words(text, cfg),
        "v1_fraicheur": F.when(minutes.isNull(), 5).when(minutes < 5, 10).when(minutes < 15, 8).when(minutes < 30, 7)
        .when(minutes < 60, 5).when(minutes < 120, 3).otherwise(0),
        "v1_bonus": F.when(blank_if_null("departement").isin(cfg["zones"]["priority"]), 5).otherwise(0)
        + F.when(stepway, 10).otherwise(0) + F.when(twingo, 5).otherwise(0) + F.when(c("seller_type") == "particulier", 3).otherwise(0)
        - F.when(blank_if_null("description") == "", 5).otherwise(0) - F.when(n_images == 0, 5).otherwise(0),
    })
    words_score = F.least(F.size("v1_words") * 5, F.lit(20))
    raw = c("v1_prix") + c("v1_km") + words_score + c("v1_fraicheur") + c("v1_bonus")
    raw = F.when(has_exclusion_word(text, cfg), F.greatest(F.lit(0), raw - 50)).otherwise(raw)
    cost = F.size("v1_words") * 100
    r_min, r_max = _value(lambda v: v["revente"][0], cfg), _value(lambda v: v["revente"][1], cfg)
    none = F.array().cast("array<string>")
    out = st.withColumns({
        "score_rentabilite": F.when(hit, F.greatest(F.lit(0), F.least(F.lit(100), raw))).otherwise(0),
        "mots_cles_detectes": F.when(hit, c("v1_words")).otherwise(none),
        "vehicule_classic": _value(lambda v: v["id"], cfg),
        "marge_estimee_min": F.when(hit & prix.isNotNull(), F.greatest(F.lit(0), r_min - prix - cost)),
        "marge_estimee_max": F.when(hit & prix.isNotNull(), F.greatest(F.lit(0), r_max - prix - F.floor(cost / 2).cast("int"))),
        "v1_mots": words_score,
    })
    out = settle(out.drop("classic_ord", "classic_text", "v1_words"), ["score_rentabilite", "vehicule_classic"])
    return out.withColumn("niveau_alerte", alert_level(c("score_rentabilite")))


def problems(text: Column, cfg: dict | None = None) -> Column:
    """array<struct<type, cost_min, cost_max>> of the parts and symptoms named in the lower-cased text."""
    a = (cfg or builtin("classic"))["analyser"]

    def rec(hit: Column, kind: str, cost: list[int]) -> Column:
        return F.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(cost[0]).alias("cost_min"), F.lit(cost[1]).alias("cost_max")))

    parts = list(a["part_costs"].items())
    table = F.array(*[F.struct(F.lit(p).alias("type"), F.lit(c[0]).alias("cost_min"), F.lit(c[1]).alias("cost_max")) for p, c in parts])
    named = F.transform(PhraseSet([[p] for p, _ in parts], False).hits(text), lambda i: F.get(table, i))
    spaced = lambda p: p.replace(r"[\s\-]", f"[{SPACE}\\-]").replace(r"\s", f"[{SPACE}]")
    symptoms = [rec(text.rlike(spaced(s["pattern"])), s["type"], s["cost"]) for s in a["symptom_costs"]]
    return F.concat(named, F.array_compact(F.array(*symptoms)))


def repair_range(found: Column) -> tuple[Column, Column]:
    zero = F.lit(0)
    return (F.aggregate(found, zero, lambda acc, p: acc + p["cost_min"]), F.aggregate(found, zero, lambda acc, p: acc + p["cost_max"]))


def listing_quality(n_images: Column, description: Column, km: Column, annee: Column, motorisation: Column) -> Column:
    n, length = n_images, F.length(blank_if_null(description))
    points = (
        F.lit(50)
        + F.when(n >= 10, 20).when(n >= 5, 15).when(n >= 3, 10).when(n >= 1, 5).otherwise(-10)
        + F.when(length >= 500, 15).when(length >= 200, 10).when(length >= 100, 5).otherwise(-5)
        + F.when(km != 0, 5).otherwise(0) + F.when(annee != 0, 5).otherwise(0) + F.when(motorisation != "", 5).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), points))


def warnings(text: Column, prix: Column, km: Column, annee: Column, this_year: Column, cfg: dict | None = None) -> Column:
    cfg = cfg or builtin("classic")
    words = F.transform(exclusion_words(text, cfg), lambda w: F.concat(F.lit("⚠️ Mot-clé exclusion: '"), w, F.lit("'")))
    pro = F.coalesce(*[F.when(F.contains(text, F.lit(w)), f"⚠️ Possible professionnel: '{w}'") for w in cfg["analyser"]["pro_words"]])
    known = (km != 0) & (annee != 0)
    per_year = km / F.nullif(this_year - annee + 1, F.lit(0))
    return F.concat(words, F.array_compact(F.array(
        F.when((prix != 0) & (prix < 1000), "⚠️ Prix très bas - vérifier authenticité"), pro,
        F.when(known & (per_year < 3000), "⚠️ Kilométrage anormalement bas").when(
            known & (per_year > 35000), "⚠️ Kilométrage très élevé pour l'âge"))))


def chances(text: Column, prix: Column, carburant: Column, departement: Column, cfg: dict | None = None) -> Column:
    cfg = cfg or builtin("classic")
    a = cfg["analyser"]
    words = F.transform(opportunity_words(text, cfg), lambda w: F.concat(F.lit("✅ Mot-clé opportunité: '"), w, F.lit("'")))
    return F.concat(words, F.array_compact(F.array(
        F.when(contains_any(text, a["urgency_words"]), "✅ Vente urgente - négociation possible"),
        F.when(F.contains(text, F.lit("stepway")) & (prix != 0) & (prix < 3500), "✅ Stepway à bon prix!"),
        F.when(contains_any(text, a["maintenance_words"]), "✅ Entretien récent mentionné"),
        F.when(contains_any(text, a["first_hand_words"]), "✅ Première main"),
        F.when(F.contains(F.lower(blank_if_null(carburant)), F.lit("diesel")) & departement.isin(a["zfe_departments"]),
               "✅ Diesel en zone ZFE - propriétaire motivé"))))


def analyse(df: DataFrame, this_year: Column) -> DataFrame:
    """Adds problemes, cout_min/max, telephone, email, qualite, alertes, opportunites."""
    c, motor = F.col, _motorisation(df)
    st = df.withColumn("classic_text", classic_text())
    st = st.withColumn("problemes", problems(c("classic_text")))
    low, high = repair_range(c("problemes"))
    return st.withColumns({
        "cout_min": low, "cout_max": high,
        "telephone": extract_contact_phone(blank_if_null("description")),
        "email": extract_email(blank_if_null("description")),
        "qualite": listing_quality(_n_images(df), c("description"), c("kilometrage"), c("annee"), motor),
        "alertes": warnings(c("classic_text"), c("prix"), c("kilometrage"), c("annee"), this_year),
        "opportunites": chances(c("classic_text"), c("prix"), c("carburant"), c("departement")),
    }).drop("classic_text")


def analysis_summary(score: Column) -> Column:
    """Text card over the columns added by `analyse`."""
    c = F.col

    def line(cond: Column | None, *parts) -> Column:
        text = F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
        return text if cond is None else F.when(cond, text)

    return F.concat_ws(
        "\n",
        line(None, "📊 ANALYSE: ", c("marque"), " ", c("modele")),
        line(None, "Score: ", score, "/100"),
        line(None, "Qualité annonce: ", c("qualite"), "/100"),
        line(F.size("problemes") > 0, "Problèmes: ", F.size("problemes"), " (", c("cout_min"), "€-", c("cout_max"), "€)"),
        line(F.size("opportunites") > 0, "Opportunités: ", F.size("opportunites")),
        line(F.size("alertes") > 0, "⚠️ Alertes: ", F.size("alertes")),
    )
