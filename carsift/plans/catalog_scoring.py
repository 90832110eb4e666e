"""Queries: target identification, keywords and every score (survey sections C5, C7, C8, D7-D9, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from carsift.functions.formats import alert_level
from carsift.functions.phrases import total
from carsift.operators import classic as cl
from carsift.operators import keywords as kwd
from carsift.operators.identify import with_target, with_target_by_dictionary
from carsift.operators.scoring import BREAKDOWN, light_score, nest_breakdown, score
from carsift.plans import reference_sql as R
from carsift.plans.registry import query
from carsift.sources import dictionaries as dic
from carsift.sources.listings import listings_from_orders

c = F.col
KEY = "arrival_seq"


def as_of_hours():
    return c("published_at") + F.make_interval(hours=c("age_hours"))


def as_of_minutes():
    return c("published_at") + F.make_interval(mins=c("age_hours"))


def scored(spark, folder, profile="v3"):
    return score(listings_from_orders(spark, folder), as_of_hours(), profile)


def parts(spark, folder, profile="v3"):
    """Scored listings for queries that select parts of the score and filter on none."""
    return score(listings_from_orders(spark, folder), as_of_hours(), profile, settled=False)


def flat(df, *cols):
    """Arrays as comma-joined text so that results compare across engines."""
    arrays = {n for n, t in df.dtypes if t.startswith("array<string")}
    return df.select(*[F.array_join(n, ", ").alias(n) if n in arrays else c(n) for n in cols])


def S(profile, cols, source="src"):
    return f"WITH {R.SRC}, {R.scored(profile, source)} SELECT {cols} FROM scored"


@query("C5_target_vehicle", f"WITH {R.SRC}, {R.dim_vehicle()} SELECT arrival_seq, coalesce(vid, '') AS vehicule_cible_id FROM (SELECT *, {R.vehicle_ord()} AS vo FROM src) LEFT JOIN dim_vehicle USING (vo)")
def _(spark, folder):
    return with_target(listings_from_orders(spark, folder)).select(KEY, "vehicule_cible_id")


@query("C5b_target_by_dictionary", f"WITH {R.SRC}, {R.dim_vehicle()} SELECT arrival_seq, coalesce(vid, '') AS vehicule_cible_id FROM (SELECT *, {R.vehicle_ord()} AS vo FROM src) LEFT JOIN dim_vehicle USING (vo)")
def _(spark, folder):
    return with_target_by_dictionary(
        listings_from_orders(spark, folder), dic.dim_vehicle(spark), dic.dim_vehicle_pattern(spark), dic.dim_vehicle_exclusion(spark)
    ).select(KEY, "vehicule_cible_id")


_CLASSIC = dic.builtin("classic")


def _classic_ord(motor="''"):
    text = f"lower(titre || ' ' || description || ' ' || {motor})"
    out = "CASE"
    for i, v in enumerate(_CLASSIC["vehicles"]):
        m, models = v["marque"].lower(), [x.lower() for x in v["modeles"]]
        out += (f" WHEN {R.any_word('lower(marque)', [m])[:-1]} OR {R.any_word('lower(titre)', [m])}) AND ({R.any_word('lower(modele)', models)} OR {R.any_word('lower(titre)', models)})"
                f" AND NOT {R.any_word(text, v['exclude'])} AND ({R.any_word(text, v['include'])} OR ({motor} = '' AND description = '')) THEN {i}")
    return out + " END"


_CDIM = ("cdim(co, cid, pmin, pmax, pideal, kmin, kmax, klo, khi, rmin, rmax, stepway) AS (VALUES " + ", ".join(
    f"({i}, {R.q(v['id'])}, {v['prix'][0]}, {v['prix'][1]}, {v['prix_ideal_max']}, {v['km'][0]}, {v['km'][1]}, {v['km_ideal'][0]}, {v['km_ideal'][1]}, {v['revente'][0]}, {v['revente'][1]}, {str(v['stepway']).lower()})"
    for i, v in enumerate(_CLASSIC["vehicles"])) + ")")


@query("C7_classic_vehicle", f"WITH {R.SRC}, {_CDIM} SELECT arrival_seq, cid AS vehicule_classic FROM (SELECT *, {_classic_ord()} AS co FROM src) LEFT JOIN cdim USING (co)")
def _(spark, folder):
    return cl.classic_score(listings_from_orders(spark, folder), as_of_minutes()).select(KEY, "vehicule_classic")


def _pad():
    return f"' ' || {R.norm('titre || chr(32) || description || chr(32) || version')} || ' ' AS pad"


def _c8_sql():
    kw = dic.builtin("keywords")

    def plain(e):
        ps = list(dict.fromkeys(R.fold(p) for p in e["patterns"]))
        return "CASE " + " ".join(f"WHEN contains(pad, {R.q(' ' + p + ' ')}) THEN {R.q(e['id'] + '=' + p)}" for p in ps) + " END"

    def rx(e):
        return "CASE " + " ".join(f"WHEN regexp_matches(pad, {R.q(p)}) THEN {R.q(e['id'] + '=')} || regexp_extract(pad, {R.q(p)})" for p in e["patterns"]) + " END"

    opp = R.joined([plain(e) for e in kw["opportunity"]] + [rx(e) for e in kw["opportunity_regex"]], "; ")
    risk = R.joined([plain(e) for e in kw["risk"]], "; ")
    return f"WITH {R.SRC} SELECT arrival_seq, {opp} AS opportunites, {risk} AS risques FROM (SELECT *, {_pad()} FROM src)"


@query("C8_keyword_matches", _c8_sql())
def _(spark, folder):
    df = listings_from_orders(spark, folder).withColumn("pad", kwd.scan_text(c("titre"), c("description"), c("version")))
    opp, risk = kwd.match_structs(c("pad"))

    def show(m):
        return F.array_join(F.transform(m, lambda x: F.concat_ws("=", x["keyword_id"], x["matched_text"])), "; ")

    return df.select(KEY, show(opp).alias("opportunites"), show(risk).alias("risques"))


def _kw_sums_sql():
    opp, risk = R.keyword_flags("v3")
    s = lambda ps, f: " + ".join(f"(CASE WHEN {x} THEN {e[f]} ELSE 0 END)" for e, x in ps)
    ids = lambda ps: R.joined([f"CASE WHEN {x} THEN {R.q(e['id'])} END" for e, x in ps])
    return (f"WITH {R.SRC} SELECT arrival_seq, {s(opp, 'bonus')} AS bonus_total, {s(risk, 'penalty')} AS penalty_total, {s(risk, 'cost')} AS cost_estimate, "
            f"{ids(opp)} AS opportunity_ids, {ids(risk)} AS risk_ids FROM (SELECT *, {_pad()} FROM src)")


def _hits(spark, folder):
    df = listings_from_orders(spark, folder).withColumn("pad", kwd.scan_text(c("titre"), c("description"), c("version")))
    return df.withColumns({"opp": kwd.opportunity_hits(c("pad")), "risk": kwd.risk_hits(c("pad"))})


@query("D7_keyword_sums", _kw_sums_sql())
def _(spark, folder):
    opp, risk = kwd.opportunity_entries(), kwd.risk_entries()
    df = _hits(spark, folder)
    return df.select(
        KEY, total(c("opp"), [e["bonus"] for e in opp]).alias("bonus_total"), total(c("risk"), [e["penalty"] for e in risk]).alias("penalty_total"),
        total(c("risk"), [e["cost"] for e in risk]).alias("cost_estimate"),
        F.array_join(kwd.pick(c("opp"), [e["id"] for e in opp]), ", ").alias("opportunity_ids"),
        F.array_join(kwd.pick(c("risk"), [e["id"] for e in risk]), ", ").alias("risk_ids"))


def _severity_sql():
    _, risk = R.keyword_flags("v3")
    rank = dic.builtin("keywords")["severity_rank"]
    order = sorted(range(len(risk)), key=lambda i: -rank.get(risk[i][0]["severity"], 0))
    case = "CASE " + " ".join(f"WHEN {risk[i][1]} THEN {R.q(risk[i][0]['severity'])}" for i in order) + " ELSE 'none' END"
    return f"WITH {R.SRC} SELECT arrival_seq, {case} AS severity FROM (SELECT *, {_pad()} FROM src)"


@query("D8_max_severity", _severity_sql())
def _(spark, folder):
    return _hits(spark, folder).select(KEY, kwd.max_severity(c("risk"), kwd.risk_entries()).alias("severity"))


@query("I1_score_v3", S("v3", "arrival_seq, vehicule_cible_id, score_total, alert_level, status, ignore_reason, " + ", ".join(BREAKDOWN) + ", keywords_opportunite, keywords_risque"))
def _(spark, folder):
    return flat(scored(spark, folder), KEY, "vehicule_cible_id", "score_total", "alert_level", "status", "ignore_reason", *BREAKDOWN,
                "keywords_opportunite", "keywords_risque")


@query("I2_price_v3", S("v3", "arrival_seq, prix_score, prix_detail, CASE WHEN ok THEN nv ELSE false END AS needs_verification"))
def _(spark, folder):
    return parts(spark, folder).select(KEY, "prix_score", "prix_detail", "needs_verification")


@query("I3_price_v2", S("v2", "arrival_seq, prix_score, prix_detail"))
def _(spark, folder):
    return parts(spark, folder, "v2").select(KEY, "prix_score", "prix_detail")


@query("I4_km_v3", S("v3", "arrival_seq, km_score, km_detail"))
def _(spark, folder):
    return parts(spark, folder).select(KEY, "km_score", "km_detail")


@query("I4b_km_v2", S("v2", "arrival_seq, km_score, km_detail"))
def _(spark, folder):
    return parts(spark, folder, "v2").select(KEY, "km_score", "km_detail")


@query("I5_freshness_v3", S("v3", "arrival_seq, freshness_score, freshness_detail"))
def _(spark, folder):
    return parts(spark, folder).select(KEY, "freshness_score", "freshness_detail")


@query("I6_freshness_v2", S("v2", "arrival_seq, freshness_score, freshness_detail"))
def _(spark, folder):
    return parts(spark, folder, "v2").select(KEY, "freshness_score", "freshness_detail")


@query("I7_keywords_v3", S("v3", "arrival_seq, keywords_score, keywords_detail"))
def _(spark, folder):
    return parts(spark, folder).select(KEY, "keywords_score", "keywords_detail")


@query("I8_keywords_v2", S("v2", "arrival_seq, keywords_score, keywords_detail"))
def _(spark, folder):
    return parts(spark, folder, "v2").select(KEY, "keywords_score", "keywords_detail")


@query("I9_bonus_v3", S("v3", "arrival_seq, bonus_score, bonus_detail"))
def _(spark, folder):
    return parts(spark, folder).select(KEY, "bonus_score", "bonus_detail")


@query("I10_bonus_v2", S("v2", "arrival_seq, bonus_score, bonus_detail"))
def _(spark, folder):
    return parts(spark, folder, "v2").select(KEY, "bonus_score", "bonus_detail")


@query("I11_risk_v3", S("v3", "arrival_seq, risk_penalty, risk_detail, keywords_risque"))
def _(spark, folder):
    return flat(parts(spark, folder), KEY, "risk_penalty", "risk_detail", "keywords_risque")


@query("I11b_risk_v2", S("v2", "arrival_seq, risk_penalty, risk_detail, keywords_risque"))
def _(spark, folder):
    return flat(parts(spark, folder, "v2"), KEY, "risk_penalty", "risk_detail", "keywords_risque")


@query("I12_exclusion_v3", S("v3", "arrival_seq, status, ignore_reason"))
def _(spark, folder):
    return parts(spark, folder).select(KEY, "status", "ignore_reason")


@query("I12b_exclusion_v2", S("v2", "arrival_seq, status, ignore_reason"))
def _(spark, folder):
    return parts(spark, folder, "v2").select(KEY, "status", "ignore_reason")


@query("I13_margin", S("v3", "arrival_seq, margin_min, margin_max, repair_cost_estimate"))
def _(spark, folder):
    return parts(spark, folder).select(KEY, "margin_min", "margin_max", "repair_cost_estimate")


@query("I14_margin_bonus", S("v3", "arrival_seq, CASE WHEN margin_min >= 1500 THEN 5 WHEN margin_min >= 1000 THEN 3 WHEN margin_min >= 500 THEN 2 ELSE 0 END AS margin_bonus"))
def _(spark, folder):
    from carsift.operators.scoring import margin_bonus

    return parts(spark, folder).select(KEY, margin_bonus(c("margin_min"), dic.builtin("targets")["weights"]["margin"]).alias("margin_bonus"))


@query("I15_score_v2", S("v2", "arrival_seq, vehicule_cible_id, score_total, alert_level, status, ignore_reason, " + ", ".join(BREAKDOWN) + ", keywords_opportunite, keywords_risque"))
def _(spark, folder):
    return flat(scored(spark, folder, "v2"), KEY, "vehicule_cible_id", "score_total", "alert_level", "status", "ignore_reason", *BREAKDOWN,
                "keywords_opportunite", "keywords_risque")


_kw = dic.builtin("keywords")


def _pattern_sql():
    entries = [e for e in kwd.opportunity_entries() + kwd.risk_entries() if "\\" not in e["patterns"][0]]
    pairs = [(e["id"], p) for e in entries for p in dict.fromkeys(R.fold(x) for x in e["patterns"]) if not set(p) & set("-'")]
    rows = ", ".join(f"({R.q(k)}, {R.q(p)})" for k, p in pairs)
    return (f"WITH {R.SRC}, pads AS (SELECT {_pad()}, arrival_seq FROM src), pats(keyword_id, pattern) AS (VALUES {rows}) "
            "SELECT keyword_id, pattern, count(pad) AS listings FROM pats LEFT JOIN pads ON contains(pad, ' ' || pattern || ' ') GROUP BY ALL")


@query("I16_pattern_table", _pattern_sql())
def _(spark, folder):
    """How often each dictionary pattern occurs in the listings: patterns joined to the words of every listing."""
    df = listings_from_orders(spark, folder).select(kwd.scan_text(c("titre"), c("description"), c("version")).alias("pad"))
    flat_patterns = [(e["id"], p) for e in kwd.opportunity_entries() + kwd.risk_entries() if "\\" not in e["patterns"][0] for p in kwd.plain(e["patterns"])]
    from carsift.functions.phrases import PhraseSet

    hits = df.select(F.explode(PhraseSet([[p] for _, p in flat_patterns], True).hits(c("pad"))).alias("i")).groupBy("i").count()
    dim = spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate(flat_patterns)], "i int, keyword_id string, pattern string")
    return dim.join(hits, "i", "left").select("keyword_id", "pattern", F.coalesce("count", F.lit(0)).alias("listings"))


def _light_sql():
    w = dic.builtin("parsing")["light_words"]
    any_ = lambda k: R.any_word("tn", w[k])
    pts = (f"(CASE WHEN p < 2000 THEN 25 WHEN p < 3000 THEN 20 WHEN p < 4000 THEN 10 ELSE 0 END) + "
           f"(CASE WHEN k BETWEEN 80000 AND 150000 THEN 20 WHEN k < 80000 THEN 15 WHEN k <= 200000 THEN 10 ELSE 0 END) + "
           f"(CASE WHEN age_hours < 1 THEN 15 WHEN age_hours < 6 THEN 10 WHEN age_hours < 24 THEN 5 ELSE 0 END) + "
           f"(CASE WHEN {any_('urgency')} THEN 10 ELSE 0 END) + (CASE WHEN {any_('negotiable')} THEN 5 ELSE 0 END) + "
           f"(CASE WHEN {any_('inspection')} THEN 8 ELSE 0 END) - (CASE WHEN {any_('risk')} THEN 20 ELSE 0 END)")
    extra = (f"(CASE WHEN p < 2000 THEN 20 WHEN p < 3000 THEN 10 ELSE 0 END) + (CASE WHEN age_hours < 1 THEN 30 WHEN age_hours < 6 THEN 20 WHEN age_hours < 24 THEN 10 ELSE 0 END) + "
             f"(CASE WHEN {any_('urgency')} THEN 15 ELSE 0 END)")
    return (f"light AS (SELECT *, greatest(0, pts) AS score_light, extra + pts AS priority FROM (SELECT *, {pts} AS pts, {extra} AS extra FROM "
            f"(SELECT * EXCLUDE (titre), titre || ' - ' || description AS titre, nullif(prix, 0) AS p, nullif(kilometrage, 0) AS k, {R.norm(chr(39).join(['titre || ', ' - ', ' || description']))} AS tn FROM src)))")


LIGHT_SQL = _light_sql()


def light(spark, folder):
    """Index rows: the title carries the words the seller put into it."""
    df = listings_from_orders(spark, folder).withColumn("titre", F.concat_ws(" - ", "titre", "description"))
    return light_score(df, as_of_hours())


@query("I17_light_score", f"WITH {R.SRC}, {LIGHT_SQL} SELECT arrival_seq, score_light, priority FROM light")
def _(spark, folder):
    return light(spark, folder).select(KEY, "score_light", "priority")


def classic_sql():
    text = "lower(titre || ' ' || description)"
    words = R.non_null([f"CASE WHEN contains(tx, {R.q(w)}) THEN {R.q(w)} END" for w in _CLASSIC["opportunity_words"]])
    pr = ", ".join(R.q(d) for d in _CLASSIC["zones"]["priority"])
    v1 = (f"v1a AS (SELECT *, {_classic_ord()} AS co, {text} AS tx, nullif(prix, 0) AS p, nullif(kilometrage, 0) AS k FROM src), "
          f"v1b AS (SELECT v1a.*, cdim.* EXCLUDE (co), {words} AS ws FROM v1a LEFT JOIN cdim ON v1a.co = cdim.co), "
          f"v1c AS (SELECT *, CASE WHEN p IS NULL THEN 10 WHEN p < pmin OR p <= pideal * 0.7e0 THEN 40 WHEN p <= pideal * 0.85e0 THEN 35 WHEN p <= pideal THEN 30 WHEN p <= pmax * 0.9e0 THEN 20 WHEN p <= pmax THEN 10 ELSE 0 END AS v1_prix, "
          f"CASE WHEN k IS NULL THEN 10 WHEN k < klo OR k <= khi THEN 30 WHEN k <= khi * 1.1e0 THEN 25 WHEN k <= kmax * 0.9e0 THEN 15 WHEN k <= kmax THEN 5 ELSE 0 END AS v1_km, "
          f"CAST(least(len(ws) * 5, 20) AS INT) AS v1_mots, CASE WHEN age_hours < 5 THEN 10 WHEN age_hours < 15 THEN 8 WHEN age_hours < 30 THEN 7 WHEN age_hours < 60 THEN 5 WHEN age_hours < 120 THEN 3 ELSE 0 END AS v1_fraicheur, "
          f"(CASE WHEN departement IN ({pr}) THEN 5 ELSE 0 END) + (CASE WHEN stepway AND contains(tx, 'stepway') AND p <= pideal THEN 10 ELSE 0 END) + "
          f"(CASE WHEN contains(tx, 'twingo') AND (contains(tx, 'phase 2') OR coalesce(annee >= 2012, false)) THEN 5 ELSE 0 END) + (CASE WHEN seller_type = 'particulier' THEN 3 ELSE 0 END) - "
          f"(CASE WHEN description = '' THEN 5 ELSE 0 END) - (CASE WHEN n_images = 0 THEN 5 ELSE 0 END) AS v1_bonus, {R.any_word('tx', _CLASSIC['exclusion_words'])} AS ex FROM v1b), "
          f"v1d AS (SELECT *, v1_prix + v1_km + v1_mots + v1_fraicheur + v1_bonus AS r0, CAST(len(ws) * 100 AS INT) AS cost FROM v1c), "
          f"v1 AS (SELECT *, CASE WHEN co IS NULL THEN 0 ELSE greatest(0, least(100, CASE WHEN ex THEN greatest(0, r0 - 50) ELSE r0 END)) END AS score_rentabilite, "
          f"CASE WHEN co IS NULL THEN '' ELSE coalesce(array_to_string(ws, ', '), '') END AS mots_cles_detectes, cid AS vehicule_classic, "
          f"CASE WHEN co IS NOT NULL AND p IS NOT NULL THEN greatest(0, rmin - p - cost) END AS marge_estimee_min, CASE WHEN co IS NOT NULL AND p IS NOT NULL THEN greatest(0, rmax - p - cost // 2) END AS marge_estimee_max FROM v1d)")
    return f"{_CDIM}, {v1}"


CLASSIC_SQL = classic_sql()


def classic(spark, folder):
    return cl.classic_score(listings_from_orders(spark, folder), as_of_minutes())


def V1(cols):
    return f"WITH {R.SRC}, {CLASSIC_SQL} SELECT {cols} FROM v1"


@query("I18_score_v1", V1("arrival_seq, vehicule_classic, score_rentabilite, mots_cles_detectes, CASE WHEN score_rentabilite >= 80 THEN 'urgent' WHEN score_rentabilite >= 60 THEN 'interessant' WHEN score_rentabilite >= 40 THEN 'surveiller' ELSE 'archive' END AS niveau_alerte"))
def _(spark, folder):
    return flat(classic(spark, folder), KEY, "vehicule_classic", "score_rentabilite", "mots_cles_detectes", "niveau_alerte")


@query("I19_price_v1", V1("arrival_seq, v1_prix") + " WHERE co IS NOT NULL")
def _(spark, folder):
    return classic(spark, folder).filter(c("vehicule_classic").isNotNull()).select(KEY, "v1_prix")


@query("I20_km_v1", V1("arrival_seq, v1_km") + " WHERE co IS NOT NULL")
def _(spark, folder):
    return classic(spark, folder).filter(c("vehicule_classic").isNotNull()).select(KEY, "v1_km")


@query("I21_freshness_v1", V1("arrival_seq, v1_fraicheur"))
def _(spark, folder):
    return classic(spark, folder).select(KEY, "v1_fraicheur")


@query("I22_bonus_v1", V1("arrival_seq, v1_bonus") + " WHERE co IS NOT NULL")
def _(spark, folder):
    return classic(spark, folder).filter(c("vehicule_classic").isNotNull()).select(KEY, "v1_bonus")


@query("I23_margin_v1", V1("arrival_seq, marge_estimee_min, marge_estimee_max"))
def _(spark, folder):
    return classic(spark, folder).select(KEY, "marge_estimee_min", "marge_estimee_max")


@query("I24_words_v1", V1("arrival_seq, array_to_string(ws, ', ') AS mots, ex AS exclu"))
def _(spark, folder):
    df = listings_from_orders(spark, folder).withColumn("tx", cl.classic_text())
    return df.select(KEY, F.array_join(cl.opportunity_words(c("tx")), ", ").alias("mots"), cl.has_exclusion_word(c("tx")).alias("exclu"))


_A = _CLASSIC["analyser"]
_YEAR = 2018


def _analyse_sql():
    def rec(cond, kind, cost):
        return f"CASE WHEN {cond} THEN {R.q(kind)} END", f"(CASE WHEN {cond} THEN {cost[0]} ELSE 0 END)", f"(CASE WHEN {cond} THEN {cost[1]} ELSE 0 END)"

    recs = [rec(f"contains(tx, {R.q(p)})", p, cost) for p, cost in _A["part_costs"].items()]
    recs += [rec(f"regexp_matches(tx, {R.q(s['pattern'])})", s["type"], s["cost"]) for s in _A["symptom_costs"]]
    warn = [f"CASE WHEN contains(tx, {R.q(w)}) THEN {R.q('⚠️ Mot-clé exclusion: ' + chr(39) + w + chr(39))} END" for w in _CLASSIC["exclusion_words"]]
    warn.append("CASE WHEN prix <> 0 AND prix < 1000 THEN '⚠️ Prix très bas - vérifier authenticité' END")
    warn.append("CASE " + " ".join(f"WHEN contains(tx, {R.q(w)}) THEN {R.q('⚠️ Possible professionnel: ' + chr(39) + w + chr(39))}" for w in _A["pro_words"]) + " END")
    per = f"kilometrage / CAST({_YEAR} - annee + 1 AS DOUBLE)"
    warn.append(f"CASE WHEN {per} < 3000 THEN '⚠️ Kilométrage anormalement bas' WHEN {per} > 35000 THEN '⚠️ Kilométrage très élevé pour l''âge' END")
    good = [f"CASE WHEN contains(tx, {R.q(w)}) THEN {R.q('✅ Mot-clé opportunité: ' + chr(39) + w + chr(39))} END" for w in _CLASSIC["opportunity_words"]]
    good.append(f"CASE WHEN {R.any_word('tx', _A['urgency_words'])} THEN '✅ Vente urgente - négociation possible' END")
    good.append("CASE WHEN contains(tx, 'stepway') AND prix < 3500 THEN '✅ Stepway à bon prix!' END")
    good.append(f"CASE WHEN {R.any_word('tx', _A['maintenance_words'])} THEN '✅ Entretien récent mentionné' END")
    good.append(f"CASE WHEN {R.any_word('tx', _A['first_hand_words'])} THEN '✅ Première main' END")
    zfe = ", ".join(R.q(d) for d in _A["zfe_departments"])
    good.append(f"CASE WHEN contains(lower(carburant), 'diesel') AND departement IN ({zfe}) THEN '✅ Diesel en zone ZFE - propriétaire motivé' END")
    quality = ("greatest(0, least(100, 50 + (CASE WHEN n_images >= 10 THEN 20 WHEN n_images >= 5 THEN 15 WHEN n_images >= 3 THEN 10 WHEN n_images >= 1 THEN 5 ELSE -10 END) + "
               "(CASE WHEN length(description) >= 500 THEN 15 WHEN length(description) >= 200 THEN 10 WHEN length(description) >= 100 THEN 5 ELSE -5 END) + "
               "(CASE WHEN kilometrage <> 0 THEN 5 ELSE 0 END) + (CASE WHEN annee <> 0 THEN 5 ELSE 0 END)))")
    return (f"an AS (SELECT *, {R.joined([r[0] for r in recs], '; ')} AS problemes, {' + '.join(r[1] for r in recs)} AS cout_min, {' + '.join(r[2] for r in recs)} AS cout_max, "
            f"{R.non_null(warn)} AS la, {R.non_null(good)} AS lo, {R.non_null([r[0] for r in recs])} AS lp, {quality} AS qualite FROM (SELECT *, lower(titre || ' ' || description) AS tx FROM src))")


ANALYSE_SQL = _analyse_sql()


def analysed(spark, folder):
    return cl.analyse(listings_from_orders(spark, folder), F.lit(_YEAR))


def AN(cols):
    return f"WITH {R.SRC}, {ANALYSE_SQL} SELECT {cols} FROM an"


@query("I25_problems", AN("arrival_seq, problemes"))
def _(spark, folder):
    return analysed(spark, folder).select(KEY, F.array_join(F.transform("problemes", lambda p: p["type"]), "; ").alias("problemes"))


@query("D9_repair_range", AN("arrival_seq, cout_min, cout_max"))
def _(spark, folder):
    return analysed(spark, folder).select(KEY, "cout_min", "cout_max")


@query("I26_listing_quality", AN("arrival_seq, qualite"))
def _(spark, folder):
    return analysed(spark, folder).select(KEY, "qualite")


@query("I27_warnings", AN("arrival_seq, array_to_string(la, '; ') AS alertes"))
def _(spark, folder):
    return analysed(spark, folder).select(KEY, F.array_join("alertes", "; ").alias("alertes"))


@query("I28_chances", AN("arrival_seq, array_to_string(lo, '; ') AS opportunites"))
def _(spark, folder):
    return analysed(spark, folder).select(KEY, F.array_join("opportunites", "; ").alias("opportunites"))


@query("I29_analysis_summary", AN("arrival_seq, '📊 ANALYSE: ' || marque || ' ' || modele || chr(10) || 'Score: 0/100' || chr(10) || 'Qualité annonce: ' || qualite || '/100' || "
       "(CASE WHEN len(lp) > 0 THEN chr(10) || 'Problèmes: ' || len(lp) || ' (' || cout_min || '€-' || cout_max || '€)' ELSE '' END) || "
       "(CASE WHEN len(lo) > 0 THEN chr(10) || 'Opportunités: ' || len(lo) ELSE '' END) || (CASE WHEN len(la) > 0 THEN chr(10) || '⚠️ Alertes: ' || len(la) ELSE '' END) AS resume"))
def _(spark, folder):
    return analysed(spark, folder).select(KEY, cl.analysis_summary(F.lit(0)).alias("resume"))


@query("I33_market_discount", S("v3", "arrival_seq, CASE WHEN NOT ok OR prix IS NULL OR prix > pmax THEN 0e0 WHEN prix < pmin OR prix < med * 0.85e0 THEN disc ELSE 0e0 END AS discount_vs_market"))
def _(spark, folder):
    return parts(spark, folder).select(KEY, F.round("discount_vs_market", 12).alias("discount_vs_market"))


@query("B14_alert_level", S("v3", "arrival_seq, alert_level"))
def _(spark, folder):
    return scored(spark, folder).select(KEY, alert_level(c("score_total")).alias("alert_level"))


@query("M2_nested_breakdown", S("v3", "arrival_seq, total AS bd_total, prix_score AS bd_prix, risk_detail AS bd_risk"))
def _(spark, folder):
    return nest_breakdown(scored(spark, folder)).select(
        KEY, c("score_breakdown.total").alias("bd_total"), c("score_breakdown.prix_score").alias("bd_prix"), c("score_breakdown.risk_detail").alias("bd_risk"))
