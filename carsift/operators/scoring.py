"""Listing scores 0-100 with an explained breakdown: the current profile ("v3") and its predecessor ("v2").

Each stage is one projection (target, keyword masks, parts, totals), so a scoring run is a single scan without shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carsift.functions.formats import age_seconds, alert_level, thousands
from carsift.functions.phrases import pick
from carsift.functions.phrases import total as total_of
from carsift.functions.text import blank_if_null, contains_any
from carsift.operators import keywords as kwd
from carsift.operators.identify import unsettled_target, vehicle_value
from carsift.operators.settle import settle
from carsift.sources.dictionaries import builtin

BREAKDOWN = ["prix_score", "prix_detail", "km_score", "km_detail", "freshness_score", "freshness_detail", "keywords_score",
             "keywords_detail", "bonus_score", "bonus_detail", "risk_penalty", "risk_detail", "total", "margin_min",
             "margin_max", "repair_cost_estimate"]
_TEXT_PARTS = [c for c in BREAKDOWN if c.endswith("_detail")]


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _share(points: int, share: float) -> int:
    return int(points * share)


def _n_images(df: DataFrame) -> Column:
    return F.col("n_images") if "n_images" in df.columns else F.coalesce(F.size("images_urls"), F.lit(0))


class _Vehicle:
    """Dictionary values of the matched vehicle as columns."""

    def __init__(self, targets: dict):
        def val(getter):
            return vehicle_value(F.col("veh_ord"), getter, targets)

        self.prix_min, self.prix_max = val(lambda v: v["prix"][0]), val(lambda v: v["prix"][1])
        self.km_min, self.km_max = val(lambda v: v["km"][0]), val(lambda v: v["km"][1])
        self.ideal_min, self.ideal_max = val(lambda v: v["km_ideal"][0]), val(lambda v: v["km_ideal"][1])
        self.resale_min, self.resale_max = val(lambda v: v["revente"][0]), val(lambda v: v["revente"][1])
        self.median = val(lambda v: v["marche_median"])


def _market(v: _Vehicle, estimate: Column | None, midpoint: bool) -> Column:
    options = [F.nullif(v.median, F.lit(0))] + ([F.nullif(estimate, F.lit(0))] if estimate is not None else [])
    options = [o.cast("double") for o in options]
    if midpoint:
        options.append((v.prix_min + v.prix_max) / 2)
    return F.coalesce(*options)


def price_parts(v: _Vehicle, weight: int, profile: str, has_images: Column, private: Column, no_risk: Column,
                estimate: Column | None = None) -> dict[str, Column]:
    prix = F.col("prix")
    market = _market(v, estimate, midpoint=profile == "v3")
    span = v.prix_max - v.prix_min
    discount = (1 - prix / market) * 100
    base = (F.lit(weight) * ((v.prix_max - prix) / F.nullif(span, F.lit(0)))).cast("int")
    floor_share, bonus_share = (0.85, 0.15) if profile == "v3" else (0.8, 0.2)
    cheap = F.coalesce(prix < market * floor_share, F.lit(False))
    low, high, bad_span = prix < v.prix_min, prix > v.prix_max, span <= 0
    legit = has_images & private & no_risk
    pct = discount.cast("int")
    in_range = F.when(cheap, F.least(F.lit(weight), base + _share(weight, bonus_share))).otherwise(base)
    if profile == "v3":
        low_score = F.when(legit, weight).otherwise(_share(weight, 0.9))
        low_detail = F.when(legit, _text("🔥 ", prix, "€ (-", pct, "% marché) - Très bonne affaire!")).otherwise(
            _text("⚠️ ", prix, "€ (-", pct, "% marché) - À VÉRIFIER (prix anormal)"))
    else:
        low_score = F.lit(_share(weight, 0.3))
        low_detail = _text("Prix très bas (", prix, "€ < ", v.prix_min, "€ min) - suspect")
    detail = F.when(cheap, _text(prix, "€ (-", pct, "% vs marché ", market.cast("int"), "€)")).otherwise(
        _text(prix, "€ (fourchette ", v.prix_min, "-", v.prix_max, "€)"))
    return {
        "prix_score": F.when(prix.isNull() | high, 0).when(low, low_score).when(bad_span, _share(weight, 0.5)).otherwise(in_range),
        "prix_detail": F.when(prix.isNull(), "Prix non renseigné")
        .when(high, _text("Prix trop élevé (", prix, "€ > ", v.prix_max, "€ max)")).when(low, low_detail)
        .when(bad_span, "Fourchette prix invalide").otherwise(detail),
        "needs_verification": F.coalesce(~high & low & ~legit, F.lit(False)) if profile == "v3" else F.lit(False),
        "discount_vs_market": F.when(prix.isNull() | high, 0.0).when(low | (~bad_span & cheap), discount).otherwise(0.0),
    }


def km_parts(v: _Vehicle, weight: int, profile: str) -> dict[str, Column]:
    km = F.col("kilometrage")
    up = F.when(v.ideal_min > v.km_min, (km - v.km_min) / F.nullif(v.ideal_min - v.km_min, F.lit(0))).otherwise(1.0)
    down = F.when(v.km_max > v.ideal_max, (v.km_max - km) / F.nullif(v.km_max - v.ideal_max, F.lit(0))).otherwise(0.0)
    low_share = 0.5 if profile == "v3" else 0.4
    label = _text(thousands(km), " km")
    if profile == "v3":
        low = _text(label, " < ", thousands(v.km_min), " km - bas (vérifier)")
        ideal, below, above = _text(label, " (idéal)"), label, _text(label, " (élevé)")
    else:
        low = _text(label, " < ", thousands(v.km_min), " km min - suspect")
        ideal = _text(label, " (idéal ", thousands(v.ideal_min), "-", thousands(v.ideal_max), ")")
        below, above = _text(label, " (sous idéal)"), _text(label, " (au-dessus idéal)")
    return {
        "km_score": F.when(km.isNull(), _share(weight, 0.3)).when(km < v.km_min, _share(weight, low_share)).when(km > v.km_max, 0)
        .when(km.between(v.ideal_min, v.ideal_max), weight)
        .when(km < v.ideal_min, (F.lit(weight) * (F.lit(0.7) + F.lit(0.3) * up)).cast("int"))
        .otherwise((F.lit(weight) * down * F.lit(0.7)).cast("int")),
        "km_detail": F.when(km.isNull(), "Km non renseigné").when(km < v.km_min, low)
        .when(km > v.km_max, _text(label, " > ", thousands(v.km_max), " km max"))
        .when(km.between(v.ideal_min, v.ideal_max), ideal).when(km < v.ideal_min, below).otherwise(above),
    }


def freshness_parts(hours: Column, weight: int, profile: str) -> dict[str, Column]:
    # upper bound in hours -> share of the points
    bands = ([(1, 1.0), (3, 0.95), (6, 0.85), (12, 0.7), (24, 0.5), (48, 0.3), (168, 0.15)] if profile == "v3"
             else [(1, 1.0), (6, 0.9), (24, 0.7), (48, 0.5), (168, 0.3)])
    score = F.when(hours.isNull(), _share(weight, 0.5))
    for limit, share in bands:
        score = score.when(hours < limit, _share(weight, share))
    whole_h, whole_d = hours.cast("int"), (hours / 24).cast("int")
    if profile == "v3":
        words = ("Date inconnue", F.lit("< 1h 🔥"), F.lit("1-2j"), _text(whole_d, "j"), F.lit("> 1 sem"))
    else:
        words = ("Date publication inconnue", F.lit("< 1h (très frais)"), F.lit("1-2 jours"), _text(whole_d, " jours"),
                 _text("> 1 semaine (", whole_d, " jours)"))
    detail = (F.when(hours.isNull(), words[0]).when(hours < 1, words[1]).when(hours < 24, _text(whole_h, "h"))
              .when(hours < 48, words[2]).when(hours < 168, words[3]).otherwise(words[4]))
    return {"freshness_score": score.otherwise(0), "freshness_detail": detail}


def bonus_parts(targets: dict, weight: int, profile: str, n_images: Column) -> dict[str, Column]:
    dept, seller = blank_if_null("departement"), F.col("seller_type")
    t1, t2, t3 = (dept.isin(targets["department_tiers"][t]) for t in (1, 2, 3))
    private, pro = seller == "particulier", seller == "professionnel"
    tier_points, private_points = ((5, 3, 1), 3) if profile == "v3" else ((3, 2, 1), 2)
    total = (F.when(t1, tier_points[0]).when(t2, tier_points[1]).when(t3, tier_points[2]).otherwise(0)
             + F.when(private, private_points).when(pro, -1).otherwise(0))
    if profile == "v3":
        labels = [F.when(t1, _text("📍 ", dept, " (proche)")).when(t2, _text("📍 ", dept)).when(t3, dept),
                  F.when(private, "Particulier").when(pro, "Pro"), F.when(n_images >= 5, _text(n_images, " photos"))]
        total = total + F.when(n_images >= 5, 1).otherwise(0)
    else:
        labels = [F.when(t1, _text("Dept ", dept, " (T1)")).when(t2, _text("Dept ", dept, " (T2)")).when(t3, _text("Dept ", dept, " (T3)")),
                  F.when(private, "Particulier").when(pro, "Pro (-1)")]
    text = F.lower(F.concat_ws(" ", blank_if_null("titre"), blank_if_null("version")))
    for i, v in enumerate(targets["vehicles"]):
        for name, value in v["bonus"].items():
            hit = (F.col("veh_ord") == i) & F.contains(text, F.lit(name.lower()))
            total = total + F.when(hit, min(2, value // 100)).otherwise(0)
            labels.append(F.when(hit, name))
    joined = F.concat_ws(", ", *labels)
    return {"bonus_score": F.greatest(F.lit(0), F.least(F.lit(weight), total)),
            "bonus_detail": F.when(joined == "", "Aucun").otherwise(joined)}


def margin_bonus(margin_min: Column, weight: int) -> Column:
    return (F.when(margin_min >= 1500, weight).when(margin_min >= 1000, _share(weight, 0.7))
            .when(margin_min >= 500, _share(weight, 0.4)).otherwise(0))


def margin_parts(v: _Vehicle, repair: Column, buffer: int) -> dict[str, Column]:
    prix = F.col("prix")

    def net(resale: Column) -> Column:
        return F.when(prix.isNull(), 0).otherwise(F.greatest(F.lit(0), resale - prix - repair - F.lit(buffer)))

    return {"margin_min": net(v.resale_min), "margin_max": net(v.resale_max),
            "breakdown_repair": F.when(prix.isNull(), 0).otherwise(repair)}


def _keyword_stage(df: DataFrame, profile: str, keywords: dict) -> DataFrame:
    """Adds opp_hits, risk_hits (dictionary positions) and excluded_by (NULL = not excluded)."""
    c = F.col
    if profile == "v3":
        df = df.withColumn("kw_text", kwd.scan_text(c("titre"), c("description"), c("version")))
        opp, risk = kwd.opportunity_hits(c("kw_text"), keywords), kwd.risk_hits(c("kw_text"), keywords)
        reason = F.concat(F.lit("Exclusion: "), kwd.exclusion_match(c("kw_text"), keywords))
    else:
        df = df.withColumn("kw_text", F.lower(F.concat_ws(" ", blank_if_null("titre"), blank_if_null("description"))))
        opp = kwd.substring_hits(c("kw_text"), keywords["opportunity"])
        risk = kwd.substring_hits(c("kw_text"), keywords["risk"])
        with_version = F.concat_ws(" ", c("kw_text"), F.lower(blank_if_null("version")))
        reason = F.concat(F.lit("Mot-clé exclu: "), kwd.first_substring(with_version, keywords["exclusions"]))
    return df.withColumns({"opp_hits": opp, "risk_hits": risk, "excluded_by": reason})


def score(df: DataFrame, as_of: Column, profile: str = "v3", targets: dict | None = None, keywords: dict | None = None, settled: bool = True) -> DataFrame:
    """Adds the breakdown columns, score_total, alert_level, margins, keyword ids, status and ignore_reason.

    Needs marque, modele, version, titre, description, carburant, prix, kilometrage, departement, seller_type,
    published_at and images_urls or n_images. `as_of` is the moment of scoring (may differ per row). A settled total may be
    filtered on, but is computed whatever is selected; unsettled, selecting some parts computes only those.
    """
    targets, keywords = targets or builtin("targets"), keywords or builtin("keywords")
    w, c = targets["weights"], F.col
    v, n_images = _Vehicle(targets), _n_images(df)
    estimate = c("prix_marche_estime") if "prix_marche_estime" in df.columns else None
    opp_entries = kwd.opportunity_entries(keywords) if profile == "v3" else keywords["opportunity"]
    risk_entries = kwd.risk_entries(keywords)

    # the hits stay outside, so that columns which do not need them leave them out
    st = settle(_keyword_stage(unsettled_target(df, targets), profile, keywords), ["veh_ord", "vehicule_cible_id", "excluded_by"])
    st = st.withColumns({
        "scored": c("veh_ord").isNotNull() & c("excluded_by").isNull(),
        "hours": age_seconds(c("published_at"), as_of) / F.lit(3600),
        "kw_bonus": total_of(c("opp_hits"), [e["bonus"] for e in opp_entries]),
        "kw_penalty": total_of(c("risk_hits"), [e["penalty"] for e in risk_entries]),
        "kw_cost": total_of(c("risk_hits"), [e["cost"] for e in risk_entries]),
    })
    opp_ids, risk_ids = pick(c("opp_hits"), [e["id"] for e in opp_entries]), pick(c("risk_hits"), [e["id"] for e in risk_entries])
    parts: dict[str, Column] = {}
    parts |= price_parts(v, w["prix"], profile, n_images > 0, c("seller_type") == "particulier", F.size("risk_hits") == 0, estimate)
    parts |= km_parts(v, w["km"], profile)
    parts |= freshness_parts(c("hours"), w["freshness"], profile)
    parts |= bonus_parts(targets, w["bonus"], profile, n_images)
    parts |= margin_parts(v, c("kw_cost"), targets["margin_buffer"] if profile == "v3" else 0)
    parts["keywords_score"] = F.least(F.lit(w["keywords"]), c("kw_bonus"))
    parts["opportunity_ids"] = opp_ids
    parts["risk_ids"] = risk_ids
    parts["severity"] = kwd.max_severity(c("risk_hits"), risk_entries, keywords)
    st = st.withColumns(parts)

    raw = c("prix_score") + c("km_score") + c("freshness_score") + c("keywords_score") + c("bonus_score") + c("kw_penalty")
    if profile == "v3":
        raw = raw + margin_bonus(c("margin_min"), w["margin"])
    total = F.greatest(F.lit(0), F.least(F.lit(100), raw))
    if profile == "v3":
        capped = (c("severity") == "critical") & (total >= 60) & (c("margin_min") < 1000)
        total = F.when(capped, 59).otherwise(total)
        listed = F.array_join("risk_ids", ", ")
        summary = _text(listed, " (~", c("kw_cost"), "€)")
        risk_detail = F.when(F.size("risk_hits") == 0, "Aucun risque détecté").when(
            c("severity") == "critical", F.concat(F.lit("⚠️ CRITIQUE: "), summary)).otherwise(summary)
        risks = F.when(c("needs_verification"), F.array_append("risk_ids", "prix_a_verifier")).otherwise(c("risk_ids"))
    else:
        texts = pick(c("risk_hits"), [f"{e['id']} ({e['penalty']}pts, ~{e['cost']}€)" for e in risk_entries])
        risk_detail = F.when(F.size("risk_hits") == 0, "Aucun risque détecté").otherwise(F.array_join(texts, ", "))
        risks = c("risk_ids")

    def scored(col: Column, default) -> Column:
        return F.when(c("scored"), col).otherwise(default)

    excluded = c("veh_ord").isNotNull() & c("excluded_by").isNotNull()
    kw_detail = F.when(F.size("opp_hits") == 0, "Aucun").otherwise(F.array_join("opportunity_ids", ", "))
    no_ids = F.array().cast("array<string>")
    final: dict[str, Column] = {
        name: scored(c(name), F.lit("") if name in _TEXT_PARTS else F.lit(0))
        for name in BREAKDOWN if name not in ("risk_penalty", "risk_detail", "keywords_detail", "total", "prix_detail", "repair_cost_estimate")
    }
    final |= {
        "prix_detail": F.when(c("veh_ord").isNull(), "Véhicule non ciblé").when(c("scored"), c("prix_detail")).otherwise(""),
        "keywords_detail": scored(kw_detail, ""),
        "risk_penalty": scored(c("kw_penalty"), 0),
        "risk_detail": F.when(excluded, F.concat(F.lit("EXCLU: "), c("excluded_by"))).when(c("scored"), risk_detail).otherwise(""),
        "total": scored(total, 0),
        "repair_cost_estimate": scored(c("breakdown_repair"), 0),
        "keywords_opportunite": scored(c("opportunity_ids"), no_ids),
        "keywords_risque": scored(risks, no_ids),
        "needs_verification": scored(c("needs_verification"), False),
        "discount_vs_market": scored(c("discount_vs_market"), 0.0),
        "status": F.when(excluded, "exclue").otherwise(c("status") if "status" in df.columns else F.lit("nouveau")),
        "ignore_reason": F.when(excluded, c("excluded_by")).otherwise(c("ignore_reason") if "ignore_reason" in df.columns else F.lit("")),
    }
    out = st.withColumns(final)
    out = (settle(out, ["total"]) if settled else out).withColumns({
        "score_total": c("total"), "alert_level": alert_level(c("total")),
        "margin_estimate_min": c("margin_min"), "margin_estimate_max": c("margin_max"),
    })
    helpers = ["veh_ord", "kw_text", "opp_hits", "risk_hits", "excluded_by", "scored", "hours", "kw_bonus", "kw_penalty",
               "kw_cost", "breakdown_repair", "opportunity_ids", "risk_ids", "severity"]
    return out.drop(*helpers)


def nest_breakdown(df: DataFrame) -> DataFrame:
    """Folds the sixteen breakdown columns into the struct column score_breakdown."""
    return df.withColumn("score_breakdown", F.struct(*BREAKDOWN)).drop(*[c for c in BREAKDOWN if c != "repair_cost_estimate"])


def light_score(df: DataFrame, as_of: Column) -> DataFrame:
    """score_light (floored at 0) and priority (uses the unfloored score) from index data only; 0 counts as missing."""
    words = builtin("parsing")["light_words"]
    prix, km = F.nullif(F.col("prix"), F.lit(0)), F.nullif(F.col("kilometrage"), F.lit(0))
    df = df.withColumns({
        "light_text": kwd.normalize_keywords(F.col("titre")),
        "light_hours": age_seconds(F.col("published_at"), as_of) / F.lit(3600),
    })
    hours, text = F.col("light_hours"), F.col("light_text")
    urgent = contains_any(text, words["urgency"])
    points = (
        F.when(prix < 2000, 25).when(prix < 3000, 20).when(prix < 4000, 10).otherwise(0)
        + F.when(km.between(80000, 150000), 20).when(km < 80000, 15).when(km <= 200000, 10).otherwise(0)
        + F.when(hours < 1, 15).when(hours < 6, 10).when(hours < 24, 5).otherwise(0)
        + F.when(urgent, 10).otherwise(0)
        + F.when(contains_any(text, words["negotiable"]), 5).otherwise(0)
        + F.when(contains_any(text, words["inspection"]), 8).otherwise(0)
        - F.when(contains_any(text, words["risk"]), 20).otherwise(0)
    )
    extra = (F.when(prix < 2000, 20).when(prix < 3000, 10).otherwise(0)
             + F.when(hours < 1, 30).when(hours < 6, 20).when(hours < 24, 10).otherwise(0) + F.when(urgent, 15).otherwise(0))
    df = df.withColumns({"score_light": F.greatest(F.lit(0), points), "priority": extra + points}).drop("light_text", "light_hours")
    return settle(df, ["score_light", "priority"])
