"""Queries: filters, joins, deduplication, statistics, order-dependent and table operators (survey sections A, B, C, D, E, F, G)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carsift.functions import identity as idf
from carsift.functions.urls import canonical_url
from carsift.operators import alerts, dedup, filters, market, merge, ordered, stats
from carsift.operators.scoring import score
from carsift.plans import reference_sql as R
from carsift.plans.catalog_scoring import CLASSIC_SQL, KEY, LIGHT_SQL, analysed, as_of_hours, classic, light, scored
from carsift.plans.catalog_text import FP_SQL, HASH_SQL, SOFT_SQL, reason_sql, title_ctes, with_fingerprint, with_reason, with_soft
from carsift.plans.registry import query
from carsift.session import checkpoint_dir
from carsift.sources import dictionaries as dic
from carsift.sources import feed, store
from carsift.sources.listings import fetch_log_from_events, listings_from_orders, read_table, spread

c = F.col
CUT = "1998-05-24 00:00:00"
NOW = "2001-11-05 00:00:00"
PARSING, CLASSIC = dic.builtin("parsing"), dic.builtin("classic")


def now():
    return F.lit(NOW).cast("timestamp")


def with_ids(df):
    return with_soft(with_fingerprint(df)).withColumn("url_canonique", canonical_url(c("url")))


def stored(spark, folder):
    """Listings as they stand in the listing table: scored, with ids, status and notification flag."""
    df = with_ids(scored(spark, folder))
    status = F.when(c("status") == "exclue", "exclue").when(c("n_images") == 0, "ignore").otherwise("nouveau")
    return df.withColumns({"status": status, "created_at": c("published_at"), "updated_at": c("published_at"), "notified": c("age_hours") < 110})


def before(df):
    return df.filter(c("published_at") < F.lit(CUT).cast("timestamp"))


def after(df):
    return df.filter(c("published_at") >= F.lit(CUT).cast("timestamp"))


def raw(spark, folder):
    return listings_from_orders(spark, folder)


def raw_ids(spark, folder):
    return with_ids(raw(spark, folder)).withColumn("created_at", c("published_at"))


IDS = f"ids AS (SELECT *, {FP_SQL} AS fingerprint, {SOFT_SQL} AS fingerprint_soft, {R.canonical_url('url')} AS url_canonique, published_at AS created_at FROM src)"
STORED = (f"{R.scored()}, stored AS (SELECT * REPLACE (CASE WHEN status = 'exclue' THEN 'exclue' WHEN n_images = 0 THEN 'ignore' ELSE 'nouveau' END AS status), {FP_SQL} AS fingerprint, "
          f"{SOFT_SQL} AS fingerprint_soft, {R.canonical_url('url')} AS url_canonique, published_at AS created_at, published_at AS updated_at, age_hours < 110 AS notified FROM scored)")
HIST = f"hist AS (SELECT * FROM ids WHERE published_at < TIMESTAMP '{CUT}'), batch AS (SELECT * FROM ids WHERE published_at >= TIMESTAMP '{CUT}')"
SHIST = f"hist AS (SELECT * FROM stored WHERE published_at < TIMESTAMP '{CUT}'), batch AS (SELECT * FROM stored WHERE published_at >= TIMESTAMP '{CUT}')"


def SQ(select, *ctes):
    return f"WITH {R.SRC}" + "".join(f", {x}" for x in ctes) + f" {select}"


# ---- B: filters and lookups -------------------------------------------------------------------------------------
@query("B1_listing_page", SQ("SELECT arrival_seq, score_total FROM stored WHERE source = 'autoscout24' AND status = 'nouveau' AND alert_level = 'interessant' AND score_total >= 60 AND NOT notified "
                             "ORDER BY score_total DESC, arrival_seq LIMIT 100 OFFSET 5", STORED))
def _(spark, folder):
    df = filters.filter_listings(stored(spark, folder), source="autoscout24", status="nouveau", alert_level="interessant", min_score=60, not_notified=True)
    return filters.page(df, "score_total DESC", 100, 5).select(KEY, "score_total")


@query("B2_classic_page", SQ("SELECT arrival_seq, score_rentabilite FROM v1 WHERE source = 'autoscout24' AND departement = '75' AND score_rentabilite >= 20 ORDER BY score_rentabilite DESC, arrival_seq LIMIT 100", CLASSIC_SQL))
def _(spark, folder):
    return filters.classic_page(filters.classic_filter(classic(spark, folder), source="autoscout24", departement="75", score_min=20)).select(KEY, "score_rentabilite")


@query("B3_pending_alerts", SQ("SELECT arrival_seq, score_total FROM stored WHERE NOT notified AND score_total >= 40", STORED))
def _(spark, folder):
    return filters.pending_alerts(stored(spark, folder)).select(KEY, "score_total")


@query("B4_lookup_by_key", SQ("SELECT arrival_seq FROM hist WHERE fingerprint IN (SELECT fingerprint FROM batch)", IDS, HIST))
def _(spark, folder):
    ids = raw_ids(spark, folder)
    return before(ids).join(after(ids).select("fingerprint").distinct(), "fingerprint", "left_semi").select(KEY)


@query("B5_exists", SQ("SELECT arrival_seq, fingerprint IN (SELECT fingerprint FROM hist) AS known_fingerprint, url IN (SELECT url FROM hist UNION SELECT url_canonique FROM hist) AS known_url FROM batch", IDS, HIST))
def _(spark, folder):
    ids = raw_ids(spark, folder)
    return filters.exists_flags(after(ids), before(ids)).select(KEY, "known_fingerprint", "known_url")


@query("B6_counts", SQ("SELECT source, status, count(*) AS n FROM stored GROUP BY ALL", STORED))
def _(spark, folder):
    return stored(spark, folder).groupBy("source", "status").agg(F.count("*").alias("n"))


def _range(col, lo, hi):
    return f"(coalesce({col}, 0) = 0 OR {col} BETWEEN {lo} AND {hi})"


def _criteria_sql(v, with_text):
    conds = [_range("prix", *v["prix"]), _range("kilometrage", *v["km"]), _range("annee", *v["annee"])]
    if with_text:
        if v["carburant"]:
            conds.append(f"(carburant = '' OR contains(lower(carburant), {R.q(v['carburant'])}))")
        conds.append(f"NOT {R.any_word('lower(titre || chr(32) || description)', v['exclude'])}")
    else:
        conds.append(f"NOT {R.any_word('lower(titre)', v['exclude'])}")
    return " AND ".join(conds)


def _per_vehicle(cond):
    return " UNION ALL ".join(f"SELECT arrival_seq, {R.q(v['id'])} AS vehicle_id FROM src WHERE {cond(v)}" for v in CLASSIC["vehicles"])


@query("B7_strict_criteria", SQ(_per_vehicle(lambda v: _criteria_sql(v, True))))
def _(spark, folder):
    return filters.matching_vehicles(raw(spark, folder), filters.strict_criteria).select(KEY, "vehicle_id")


@query("B8_title_criteria", SQ(_per_vehicle(lambda v: _criteria_sql(v, False))))
def _(spark, folder):
    return filters.matching_vehicles(raw(spark, folder), lambda v: filters.strict_criteria(v, with_text=False)).select(KEY, "vehicle_id")


@query("B9_tolerant_criteria", SQ(_per_vehicle(lambda v: f"(coalesce(prix, 0) = 0 OR (prix >= {v['prix'][0]} * 0.8e0 AND prix <= {v['prix'][1]} * 1.2e0)) AND (coalesce(kilometrage, 0) = 0 OR kilometrage <= {v['km'][1]} * 1.1e0)")))
def _(spark, folder):
    return filters.matching_vehicles(raw(spark, folder), filters.tolerant_criteria).select(KEY, "vehicle_id")


_ZONES = ", ".join(R.q(d) for d in CLASSIC["zones"]["priority"] + CLASSIC["zones"]["secondary"])


@query("B10_zone", SQ(f"SELECT arrival_seq FROM src WHERE departement = '' OR departement IN ({_ZONES})"))
def _(spark, folder):
    return raw(spark, folder).filter(filters.in_zone()).select(KEY)


def _search_sql(all_rows):
    parts = []
    for s in dic.builtin("searches")["searches"]:
        if not (s["enabled"] or all_rows):
            continue
        for src in s.get("sources") or [s["source"]]:
            conds = [f"source = {R.q(src)}", f"lower(marque) = {R.q(s['marque'].lower())}", f"contains(lower(titre), {R.q(s['modele'].lower())})", f"carburant = {R.q(s['carburant'])}", "seller_type = 'particulier'"]
            for col, k in (("prix", "prix"), ("kilometrage", "km"), ("annee", "annee")):
                conds += [f"{col} >= {s[k + '_min']}"] if s.get(k + "_min") else []
                conds += [f"{col} <= {s[k + '_max']}"] if s.get(k + "_max") else []
            parts.append(f"SELECT arrival_seq, {R.q(s['name'])} AS search FROM src WHERE {' AND '.join(conds)}")
    return " UNION ALL ".join(parts)


@query("B11_active_searches", SQ(_search_sql(False)))
def _(spark, folder):
    return filters.match_searches(raw(spark, folder)).select(KEY, "search")


@query("C6_listing_search_range", SQ(_search_sql(True)))
def _(spark, folder):
    return filters.match_searches(raw(spark, folder), every=True).select(KEY, "search")


@query("B12_score_threshold", SQ("SELECT arrival_seq, score_rentabilite FROM v1 WHERE score_rentabilite >= 40", CLASSIC_SQL))
def _(spark, folder):
    return classic(spark, folder).filter(c("score_rentabilite") >= 40).select(KEY, "score_rentabilite")


@query("B13_detail_selection", SQ("SELECT arrival_seq, score_light FROM light WHERE score_light >= 30", LIGHT_SQL))
def _(spark, folder):
    return light(spark, folder).filter(c("score_light") >= 30).select(KEY, "score_light")


@query("B15_enum_check", SQ("SELECT arrival_seq, CASE WHEN version NOT IN ('diesel', 'essence') AND marque = 'BMW' THEN 'carburant' ELSE '' END AS invalid FROM src"))
def _(spark, folder):
    df = raw(spark, folder).withColumn("carburant", F.when(c("marque") == "BMW", c("version")).otherwise(c("carburant")))
    return filters.enum_problems(df, ["source", "seller_type", "carburant"]).select(KEY, F.array_join("invalid", ", ").alias("invalid"))


@query("B16_searches_per_source", "WITH " + R.SRC + ", s(name, search_source) AS (VALUES " + ", ".join(
    f"({R.q(s['name'])}, {R.q(x)})" for s in dic.builtin("searches")["searches"] if s["enabled"] for x in (s.get("sources") or [s["source"]])) + ") SELECT name, search_source, count(arrival_seq) AS listings FROM s LEFT JOIN src ON source = search_source GROUP BY ALL")
def _(spark, folder):
    s = filters.active_searches(dic.dim_search(spark)).select("name", "search_source")
    per_source = raw(spark, folder).groupBy("source").agg(F.count("*").alias("listings"))
    return s.join(per_source, s.search_source == per_source.source, "left").select("name", "search_source", F.coalesce("listings", F.lit(0)).alias("listings"))


@query("B17_top_then_filter", SQ("SELECT * FROM (SELECT arrival_seq, score_rentabilite, prix FROM v1 ORDER BY score_rentabilite DESC, arrival_seq LIMIT 15) WHERE score_rentabilite >= 20 AND prix IS NOT NULL", CLASSIC_SQL))
def _(spark, folder):
    top = classic(spark, folder).orderBy(c("score_rentabilite").desc(), KEY).limit(15)
    return top.filter((c("score_rentabilite") >= 20) & c("prix").isNotNull()).select(KEY, "score_rentabilite", "prix")


@query("B18_blocked_pages", "SELECT page_id, CASE WHEN page_id % 9 = 0 THEN true WHEN (contains(lower(html), 'annonce') OR contains(lower(html), 'voiture') OR contains(lower(html), 'prix') OR contains(lower(html), '€') OR contains(lower(html), 'listing') OR contains(lower(html), 'vehicle')) AND length(html) > 10000 THEN false "
       "ELSE (contains(lower(html), 'captcha') OR contains(lower(html), 'access denied') OR contains(lower(html), 'blocked') OR contains(lower(html), 'too many requests') OR contains(lower(html), 'rate limit')) AND length(html) < 50000 END AS blocked FROM pages")
def _(spark, folder):
    p = spread(read_table(spark, folder, "pages").select("page_id", "html"))
    status = F.when(c("page_id") % 9 == 0, 429).otherwise(200)
    return p.select("page_id", filters.blocked(status, c("html")).alias("blocked"))


# ---- C, E, G: joins and deduplication ---------------------------------------------------------------------------
E1_SQL = ("once AS (SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY CASE WHEN source_listing_id IS NULL THEN CAST(arrival_seq AS VARCHAR) ELSE source || ':' || source_listing_id END ORDER BY arrival_seq) = 1), "
          "twice AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY url_canonique ORDER BY arrival_seq) = 1)")


@query("E1_dedup_in_batch", SQ("SELECT arrival_seq FROM twice", IDS, E1_SQL.format("ids")))
def _(spark, folder):
    return dedup.dedup_in_batch(raw(spark, folder)).select(KEY)


@query("E2_dedup_by_url", SQ("SELECT min(arrival_seq) AS arrival_seq FROM src GROUP BY url"))
def _(spark, folder):
    return dedup.first_per_key(raw(spark, folder).select("url", KEY), c("url"), [c(KEY)]).select(KEY)


@query("E3_dedup_by_content", SQ(f"SELECT min(arrival_seq) AS arrival_seq FROM src GROUP BY {HASH_SQL}"))
def _(spark, folder):
    h = idf.content_hash(*[c(x) for x in ("marque", "modele", "prix", "kilometrage", "departement")])
    return dedup.dedup_by_hash(raw(spark, folder), h).select(KEY)


@query("E4_first_vehicle", SQ(f"SELECT vo AS ord, count(*) AS n, min(arrival_seq) AS first_seq FROM (SELECT *, {R.vehicle_ord()} AS vo FROM src) WHERE vo IS NOT NULL GROUP BY ALL"))
def _(spark, folder):
    from carsift.operators.identify import with_target

    return with_target(raw(spark, folder)).filter(c("veh_ord").isNotNull()).groupBy(c("veh_ord").alias("ord")).agg(
        F.count("*").alias("n"), F.min(KEY).alias("first_seq"))


@query("C1_drop_known_ids", SQ("SELECT arrival_seq FROM batch b WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.source = b.source AND h.source_listing_id = b.source_listing_id)", IDS, HIST))
def _(spark, folder):
    df = raw(spark, folder)
    return dedup.drop_known_ids(after(df), before(df)).select(KEY)


@query("C2_drop_known_urls", SQ("SELECT arrival_seq FROM batch WHERE url_canonique NOT IN (SELECT url FROM hist UNION SELECT url_canonique FROM hist)", IDS, HIST))
def _(spark, folder):
    df = raw(spark, folder)
    return dedup.drop_known_urls(after(df), before(df)).select(KEY)


@query("C3_new_by_url", SQ("SELECT min(arrival_seq) AS arrival_seq FROM batch WHERE url NOT IN (SELECT url FROM hist) GROUP BY url", IDS, HIST))
def _(spark, folder):
    df = raw(spark, folder)
    return dedup.new_by_url(after(df), before(df)).select(KEY)


NEW_SQL = ("surv AS (SELECT * FROM (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY CASE WHEN source_listing_id IS NULL THEN CAST(arrival_seq AS VARCHAR) ELSE source || ':' || source_listing_id END ORDER BY arrival_seq) = 1) b "
           "WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.source = b.source AND h.source_listing_id = b.source_listing_id)), "
           "fresh AS (SELECT * FROM (SELECT * FROM surv QUALIFY row_number() OVER (PARTITION BY url_canonique ORDER BY arrival_seq) = 1) WHERE url_canonique NOT IN (SELECT url FROM hist UNION SELECT url_canonique FROM hist))")


@query("G2_new_listings", SQ("SELECT arrival_seq, source FROM fresh", IDS, HIST, NEW_SQL))
def _(spark, folder):
    df = raw(spark, folder)
    return dedup.new_listings(after(df), before(df)).select(KEY, "source")


NEAR_SQL = ("newest AS (SELECT b.arrival_seq AS bseq, h.fingerprint AS nfp, h.prix AS nprix, h.score_total AS nscore, h.notified AS nnot FROM batch b JOIN hist h ON h.fingerprint_soft = b.fingerprint_soft AND b.fingerprint_soft <> '' "
            "QUALIFY row_number() OVER (PARTITION BY b.arrival_seq ORDER BY h.created_at DESC, h.arrival_seq DESC) = 1)")


def near(spark, folder):
    t = stored(spark, folder)
    hist = before(t)
    return dedup.near_duplicates(after(t), dedup.first_per_key(hist, c("fingerprint"), [c("created_at").desc(), c(KEY).desc()]))


# the table holds one row per fingerprint; its newest state counts
UHIST = "uhist AS (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY created_at DESC, arrival_seq DESC) = 1)"
NEAR_SQL = NEAR_SQL.replace("JOIN hist h", "JOIN uhist h")


@query("C4_near_duplicates", SQ("SELECT b.arrival_seq, nfp AS near_fingerprint FROM batch b LEFT JOIN newest ON bseq = b.arrival_seq", STORED, SHIST, UHIST, NEAR_SQL))
def _(spark, folder):
    return near(spark, folder).select(KEY, c("near.fingerprint").alias("near_fingerprint"))


@query("E5_newest_near_duplicate", SQ("SELECT b.arrival_seq, nprix AS near_prix, nscore AS near_score FROM batch b JOIN newest ON bseq = b.arrival_seq", STORED, SHIST, UHIST, NEAR_SQL))
def _(spark, folder):
    return near(spark, folder).filter(c("near").isNotNull()).select(KEY, c("near.prix").alias("near_prix"), c("near.score_total").alias("near_score"))


EXIST_SQL = ("ex AS (SELECT b.*, CASE WHEN u.fingerprint IS NOT NULL THEN u.prix ELSE nprix END AS oprix, CASE WHEN u.fingerprint IS NOT NULL THEN u.score_total ELSE nscore END AS oscore, "
             "CASE WHEN u.fingerprint IS NOT NULL THEN u.notified ELSE nnot END AS onot, (u.fingerprint IS NOT NULL OR nfp IS NOT NULL) AS has FROM batch b "
             "LEFT JOIN (SELECT * FROM uhist WHERE source_listing_id IS NOT NULL) u ON u.source = b.source AND u.source_listing_id = b.source_listing_id LEFT JOIN newest ON bseq = b.arrival_seq)")
REASON = ("CASE WHEN NOT has THEN (CASE WHEN score_total >= 60 THEN 'new' ELSE 'score_too_low' END) WHEN onot THEN (CASE WHEN oprix <> 0 AND prix <> 0 AND prix < oprix * 0.95e0 THEN 'price_dropped' WHEN score_total >= oscore + 10 THEN 'score_increased' ELSE 'already_notified' END) "
          "WHEN score_total >= 60 THEN 'score_threshold' ELSE 'score_too_low' END")


def with_existing(spark, folder):
    """Previous state: the stored row with the same listing id, else the newest near duplicate."""
    t = stored(spark, folder)
    hist = dedup.first_per_key(before(t), c("fingerprint"), [c("created_at").desc(), c(KEY).desc()])
    by_id = hist.filter(c("source_listing_id").isNotNull()).select("source", "source_listing_id", F.struct("fingerprint", "prix", "score_total", "notified").alias("same"))
    j = dedup.near_duplicates(after(t), hist).join(by_id, ["source", "source_listing_id"], "left")
    return j.withColumn("existing", F.coalesce("same", "near"))


@query("C11_existing_state", SQ("SELECT arrival_seq, oprix AS old_prix, oscore AS old_score, has AS known FROM ex", STORED, SHIST, UHIST, NEAR_SQL, EXIST_SQL))
def _(spark, folder):
    return with_existing(spark, folder).select(KEY, c("existing.prix").alias("old_prix"), c("existing.score_total").alias("old_score"), c("existing").isNotNull().alias("known"))


@query("I30_alert_decision", SQ(f"SELECT arrival_seq, {REASON} AS notify_reason FROM ex", STORED, SHIST, UHIST, NEAR_SQL, EXIST_SQL))
def _(spark, folder):
    return alerts.with_decision(with_existing(spark, folder), c("existing")).select(KEY, "notify_reason")


@query("I31_update_message", SQ("SELECT arrival_seq, nullif(coalesce(array_to_string(list_filter([CASE WHEN oprix <> 0 AND prix <> 0 AND prix < oprix THEN '📉 Prix -' || (oprix - prix) || '€ (-' || CAST(trunc((oprix - prix) / CAST(oprix AS DOUBLE) * 100) AS INT) || '%)' END, "
       "CASE WHEN oscore <> 0 AND score_total > oscore THEN '📈 Score +' || (score_total - oscore) || 'pts' END], lambda x: x IS NOT NULL), ' | '), ''), '') AS message FROM ex WHERE has", STORED, SHIST, UHIST, NEAR_SQL, EXIST_SQL))
def _(spark, folder):
    e = with_existing(spark, folder).filter(c("existing").isNotNull())
    return e.select(KEY, alerts.update_message(c("prix"), c("score_total"), c("existing.prix"), c("existing.score_total")).alias("message"))


_CHAN = "CASE alert_level " + " ".join(f"WHEN {R.q(k)} THEN [{', '.join(R.q(x) for x in v)}]" for k, v in PARSING["alert_channels"].items()) + " ELSE [] END"
ROUTED = f"routed AS (SELECT *, unnest({_CHAN}) AS channel FROM scored)"


@query("I32_channel_routing", SQ("SELECT arrival_seq, channel, CASE WHEN channel = 'pushover' AND alert_level = 'urgent' THEN 1 ELSE 0 END AS channel_priority FROM routed", R.scored(), ROUTED))
def _(spark, folder):
    return alerts.route(scored(spark, folder)).select(KEY, "channel", "channel_priority")


@query("A30_notification_log", SQ(f"SELECT arrival_seq AS annonce_id, channel, 'sent' AS status, TIMESTAMP '{NOW}' AS sent_at FROM routed", R.scored(), ROUTED))
def _(spark, folder):
    return alerts.notification_log(scored(spark, folder), KEY, now()).select("annonce_id", "channel", "status", "sent_at")


@query("C14_orphan_notifications", SQ(f"SELECT channel, count(*) AS n FROM routed WHERE published_at >= TIMESTAMP '{CUT}' GROUP BY ALL", R.scored(), ROUTED))
def _(spark, folder):
    s = scored(spark, folder)
    # scoring keeps every listing, so the keys that exist need no scores
    return alerts.orphan_notifications(alerts.notification_log(s, KEY, now()), before(raw(spark, folder)), KEY).groupBy("channel").agg(F.count("*").alias("n"))


def _payload_sql():
    emoji = "CASE alert_level WHEN 'urgent' THEN '🔴' WHEN 'interessant' THEN '🟠' WHEN 'surveiller' THEN '🟡' ELSE '⚪' END"
    comp = R.joined([f"CASE WHEN {n} <> 0 THEN '{lab}' || {n} END" for lab, n in (("Prix:", "prix_score"), ("Km:", "km_score"), ("Fresh:", "freshness_score"), ("KW:", "keywords_score"), ("Risk:", "risk_penalty"))], " | ")
    t = R.thousands
    cap = lambda x: f"upper({x}[1:1]) || lower({x}[2:])"
    five = lambda x: f"array_to_string(string_split({x}, ', ')[1:5], ', ')"
    fields = R.joined([
        f"'💰 Prix=' || coalesce({t('prix')} || ' €', 'N/C')", f"'🛣️ Kilométrage=' || coalesce({t('kilometrage')} || ' km', 'N/C')", "'📅 Année=' || coalesce(CAST(annee AS VARCHAR), 'N/C')",
        "CASE WHEN departement <> '' THEN '📍 Localisation=' || departement END", f"CASE WHEN carburant <> 'unknown' THEN '⛽ Carburant=' || {cap('carburant')} END",
        f"CASE WHEN seller_type <> 'unknown' THEN '👤 Vendeur=' || {cap('seller_type')} END",
        f"CASE WHEN margin_min <> 0 OR margin_max <> 0 THEN '💵 Marge potentielle=' || {t('margin_min')} || ' - ' || {t('margin_max')} || ' €' || (CASE WHEN repair_cost_estimate <> 0 THEN chr(10) || '*(réparations: ~' || {t('repair_cost_estimate')} || '€)*' ELSE '' END) END",
        f"CASE WHEN keywords_opportunite <> '' THEN '✅ Opportunités=' || {five('keywords_opportunite')} END", f"CASE WHEN keywords_risque <> '' THEN '⚠️ Risques=' || {five('keywords_risque')} END"], "; ")
    return (f"SELECT arrival_seq, {emoji} || ' ' || marque || ' ' || modele || ' ' || substr(version, 1, 25) AS alert_title, "
            f"(CASE WHEN raison <> '' THEN '**🎯 ' || raison || '**' || chr(10) ELSE '' END) || 'Score: **' || score_total || '/100** (' || alert_level || ')' || (CASE WHEN {comp} <> '' THEN chr(10) || '*(' || {comp} || ')*' ELSE '' END) AS alert_description, "
            f"{fields} AS alert_fields, source || ' • Score ' || score_total || '/100' AS alert_footer FROM (SELECT *, {reason_sql()} AS raison FROM scored)")


@query("A31_alert_payload", SQ(_payload_sql(), R.scored()))
def _(spark, folder):
    p = alerts.payload(with_reason(scored(spark, folder)))
    fields = F.array_join(F.transform("alert_fields", lambda f: F.concat_ws("=", f["name"], f["value"])), "; ")
    return p.select(KEY, "alert_title", "alert_description", fields.alias("alert_fields"), "alert_footer")


@query("C9_merge_detail", SQ("SELECT arrival_seq, CASE WHEN has_detail THEN 'Détail: ' || version ELSE description END AS description, CASE WHEN has_detail AND n_images > 0 THEN n_images ELSE 0 END AS images, "
       "CASE WHEN has_detail THEN (CASE WHEN arrival_seq % 2 = 0 THEN 'professionnel' ELSE seller_type END) ELSE seller_type END AS seller_type, "
       "CASE WHEN has_detail AND arrival_seq % 3 = 0 THEN 'diesel' ELSE carburant END AS carburant, CASE WHEN has_detail THEN 'manuelle' ELSE 'unknown' END AS boite, version FROM src"))
def _(spark, folder):
    df = raw(spark, folder).withColumn("url", F.concat_ws("/", "url", KEY))
    base = df.withColumns({"seller_name": F.lit(""), "seller_phone": F.lit(""), "puissance_ch": F.lit(None).cast("int"), "boite": F.lit("unknown"),
                           "motorisation": F.lit(""), "images_urls": F.array().cast("array<string>")})
    details = df.filter("has_detail").select(
        "url", F.concat(F.lit("Détail: "), "version").alias("description"), F.array_repeat(F.lit("img"), c("n_images")).alias("images_urls"),
        F.when(c(KEY) % 2 == 0, "Garage Auto").otherwise("").alias("seller_type"), F.lit("").alias("seller_name"), F.lit("").alias("seller_phone"),
        F.when(c(KEY) % 3 == 0, "1.4 HDi").otherwise("").alias("carburant"), F.lit("Boîte manuelle").alias("boite"), F.lit(None).cast("int").alias("puissance_ch"),
        F.lit("x").alias("version"), F.lit("").alias("motorisation"))
    return merge.merge_detail(base, details).select(KEY, "description", F.size("images_urls").alias("images"), "seller_type", "carburant", "boite", "version")


_TIERS = " ".join(f"WHEN departement IN ({', '.join(R.q(d) for d in ds)}) THEN {t}" for t, ds in dic.builtin("targets")["department_tiers"].items())


@query("C10_department_tier", SQ(f"SELECT arrival_seq, CASE {_TIERS} END AS tier FROM src"))
def _(spark, folder):
    return raw(spark, folder).select(KEY, filters.department_tier().alias("tier"))


@query("C12_detail_sources", SQ("SELECT source, count(*) AS n FROM src WHERE source IN ('autoscout24', 'lacentrale', 'leboncoin', 'paruvendu') GROUP BY source"))
def _(spark, folder):
    """Listings whose detail page can be read, as the registry of sources says."""
    return raw(spark, folder).where(c("source").isin(feed.detail_sources())).groupBy("source").agg(F.count("*").alias("n"))


@query("C13_known_keys", SQ("SELECT arrival_seq FROM batch WHERE fingerprint IN (SELECT fingerprint FROM hist)", IDS, HIST))
def _(spark, folder):
    ids = raw_ids(spark, folder)
    return after(ids).join(before(ids).select("fingerprint").distinct(), "fingerprint", "left_semi").select(KEY)


@query("H32_index_to_listing", SQ("SELECT arrival_seq, CASE WHEN bm OR bo THEN (CASE WHEN marque0 = '' THEN t_marque ELSE marque0 END) ELSE marque0 END AS marque, CASE WHEN (bm OR bo) AND modele0 = '' THEN t_modele ELSE modele0 END AS modele, "
       "CASE WHEN (bm OR bo) THEN t_version ELSE '' END AS version, CASE WHEN departement <> '' THEN departement ELSE '94' END AS departement, carburant FROM titles",
       "lt AS (SELECT *, CASE WHEN arrival_seq % 2 = 0 THEN '' ELSE marque END AS marque0, modele AS modele0, arrival_seq % 2 = 0 OR marque = '' AS bm, modele = '' AS bo, titre AS title_text FROM src)" + title_ctes()))
def _(spark, folder):
    df = raw(spark, folder).withColumns({"marque": F.when(c(KEY) % 2 == 0, "").otherwise(c("marque")), "version": F.lit(""), "ville": F.lit("Créteil (94)"), "thumbnail_url": F.lit("")})
    return merge.index_to_listing(df).select(KEY, "marque", "modele", "version", "departement", "carburant")


@query("G1_union_sources", SQ("SELECT source, count(*) AS n FROM (SELECT source, arrival_seq FROM src UNION ALL SELECT source, event_id FROM fetches) GROUP BY source", R.EVENTS))
def _(spark, folder):
    a = raw(spark, folder).select("source", KEY, "prix")
    b = fetch_log_from_events(spark, folder).select("source", c("event_id").alias(KEY))
    return a.unionByName(b, allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"))


@query("G3_all_departments", SQ(f"SELECT d AS departement, count(arrival_seq) AS n FROM (SELECT unnest([{_ZONES}]) AS d) LEFT JOIN src ON departement = d GROUP BY d"))
def _(spark, folder):
    zones = spark.createDataFrame([(CLASSIC["zones"]["priority"], CLASSIC["zones"]["secondary"])], "p array<string>, s array<string>")
    every = zones.select(F.explode(F.array_union("p", "s")).alias("departement"))
    per = raw(spark, folder).groupBy("departement").agg(F.count("*").alias("n"))
    return every.join(per, "departement", "left").select("departement", F.coalesce("n", F.lit(0)).alias("n"))


@query("G4_recent_seen", SQ(f"SELECT arrival_seq FROM ids WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 480 HOUR", IDS))
def _(spark, folder):
    return dedup.seen_recently(raw_ids(spark, folder), now(), hours=480).select(KEY)


# ---- D: aggregates ----------------------------------------------------------------------------------------------
@query("D1_global_stats", SQ("SELECT count(*) AS total_annonces, count(*) FILTER (status = 'nouveau') AS nouveaux, count(*) FILTER (alert_level = 'urgent') AS urgents, count(*) FILTER (alert_level = 'interessant') AS interessants, "
       "count(*) FILTER (notified) AS notifiees, avg(score_total) AS score_moyen, avg(prix) AS prix_moyen, avg(kilometrage) AS km_moyen FROM stored WHERE status NOT IN ('ignore', 'exclue')", STORED))
def _(spark, folder):
    return stats.global_stats(stored(spark, folder))


@query("D2_stats_by_source", SQ(f"SELECT source, count(*) AS total, count(*) FILTER (CAST(created_at AS DATE) = DATE '{CUT[:10]}') AS aujourdhui, avg(score_total) AS score_moyen, max(score_total) AS score_max FROM stored GROUP BY source", STORED))
def _(spark, folder):
    return stats.stats_by_source(stored(spark, folder), F.lit(CUT[:10]).cast("date"))


_D3 = [("total", "total", "true")] + [("source", s, f"source = {R.q(s)}") for s in PARSING["enums"]["source"]] + [("statut", s, f"status = {R.q(s)}") for s in ("nouveau", "contacté", "acheté", "expiré", "ignoré")] + [("score", s, f"alert_level = {R.q(s)}") for s in PARSING["enums"]["alert_level"]]


@query("D3_classic_stats", SQ(" UNION ALL ".join(f"SELECT '{k}' AS kind, '{lab}' AS label, count(*) FILTER ({cond}) AS n FROM stored" for k, lab, cond in _D3), STORED))
def _(spark, folder):
    return stats.classic_stats(stored(spark, folder))


@query("D4_run_stats", SQ(f"SELECT (SELECT count(*) FROM batch) AS index_scanned, (SELECT count(*) FROM fresh) AS index_new, (SELECT count(*) FROM batch) - (SELECT count(*) FROM fresh) AS index_duplicates, count(*) AS detail_fetched, "
       f"count(*) FILTER (alert_level = 'urgent') AS urgent_count, count(*) FILTER (alert_level = 'interessant') AS interessant_count, count(*) FILTER (score_total >= 60) AS notified FROM scored",
       IDS, HIST, NEW_SQL, R.scored(source="fresh")))
def _(spark, folder):
    df = raw(spark, folder)
    batch = after(df)
    fresh = dedup.new_listings(batch, before(df))
    counts = batch.agg(F.count("*").alias("index_scanned")).join(fresh.agg(F.count("*").alias("index_new")))
    decided = score(fresh, as_of_hours()).withColumn("notify", c("score_total") >= 60)
    return stats.pipeline_stats(counts, decided)


@query("D5_source_totals", SQ("SELECT source, index_count, coalesce(new_count, 0) AS new_count FROM (SELECT source, count(*) AS index_count FROM batch GROUP BY source) LEFT JOIN (SELECT source, count(*) AS new_count FROM fresh GROUP BY source) USING (source)", IDS, HIST, NEW_SQL))
def _(spark, folder):
    df = raw(spark, folder)
    batch = after(df)
    per = batch.groupBy("source").agg(F.count("*").alias("index_count"))
    new = dedup.new_listings(batch, before(df)).groupBy("source").agg(F.count("*").alias("new_count"))
    return per.join(new, "source", "left").select("source", "index_count", F.coalesce("new_count", F.lit(0)).alias("new_count"))


@query("D6_market_prices", SQ("SELECT vehicule_cible_id, CAST(annee // 3 * 3 AS INT) || '-' || CAST(annee // 3 * 3 + 2 AS INT) AS annee_bucket, CAST(kilometrage // 50000 * 50000 AS INT) || '-' || CAST(kilometrage // 50000 * 50000 + 50000 AS INT) AS km_bucket, "
       "departement AS departement_bucket, count(*) AS count, min(prix) AS prix_min, max(prix) AS prix_max, CAST(median(prix) AS DOUBLE) AS prix_median, avg(prix) AS prix_moyenne FROM scored WHERE vehicule_cible_id <> '' AND prix IS NOT NULL AND annee IS NOT NULL AND kilometrage IS NOT NULL "
       "GROUP BY GROUPING SETS ((vehicule_cible_id, annee_bucket, km_bucket, departement), (vehicule_cible_id, annee_bucket, km_bucket))", R.scored()))
def _(spark, folder):
    from carsift.operators.identify import with_target

    return stats.market_prices(with_target(raw(spark, folder)))


# the listings of nine of ten batches were seen again a batch later, 100 cheaper
_REPRICED = "(SELECT * REPLACE (CASE WHEN arrival_seq % 10 < 9 THEN prix - 100 ELSE prix END AS prix) FROM scored)"


@query("D6b_market_prices_by_batches", SQ("SELECT vehicule_cible_id, CAST(annee // 3 * 3 AS INT) || '-' || CAST(annee // 3 * 3 + 2 AS INT) AS annee_bucket, CAST(kilometrage // 50000 * 50000 AS INT) || '-' || CAST(kilometrage // 50000 * 50000 + 50000 AS INT) AS km_bucket, "
       f"departement AS departement_bucket, count(*) AS count, min(prix) AS prix_min, max(prix) AS prix_max, CAST(median(prix) AS DOUBLE) AS prix_median, avg(prix) AS prix_moyenne FROM {_REPRICED} WHERE vehicule_cible_id <> '' AND prix IS NOT NULL AND annee IS NOT NULL AND kilometrage IS NOT NULL "
       "GROUP BY GROUPING SETS ((vehicule_cible_id, annee_bucket, km_bucket, departement), (vehicule_cible_id, annee_bucket, km_bucket))", R.scored()))
def _(spark, folder):
    """The statistics after ten batches that add new listings and reprice those of the batch before."""
    from carsift.operators.identify import with_target

    root = f"{checkpoint_dir(spark)}/prices-{uuid.uuid4().hex}"
    with_target(raw(spark, folder)).select("vehicule_cible_id", "annee", "kilometrage", "departement", "prix", (c(KEY) % 10).alias("seen")).write.parquet(f"{root}/listings")
    rows, log = spark.read.parquet(f"{root}/listings"), market.PriceLog(spark, f"{root}/log")
    cheaper = c("prix") - 100
    for batch in range(10):
        new, again = rows.filter(c("seen") == batch), rows.filter(c("seen") == batch - 1)
        log.apply(new.unionByName(again.withColumn("prix", cheaper)), again, batch)
    return log.prices()


@query("D10_run_report", SQ("SELECT count(*) AS total, count(*) FILTER (mots_cles_detectes <> '') AS avec_mots_cles, count(*) FILTER (score_rentabilite >= 50) AS score_50, count(*) FILTER (score_rentabilite >= 30) AS score_30 FROM v1", CLASSIC_SQL))
def _(spark, folder):
    return stats.run_report(classic(spark, folder))


@query("D11_seen_keys", SQ("SELECT count(DISTINCT url_canonique) AS urls, count(DISTINCT source || ':' || source_listing_id) AS listings FROM ids", IDS))
def _(spark, folder):
    ids = raw(spark, folder).withColumn("url_canonique", canonical_url(c("url")))
    urls = ids.select(c("url_canonique").alias("k"), F.lit("u").alias("kind"))
    keys = ids.filter(c("source_listing_id").isNotNull()).select(F.concat_ws(":", "source", "source_listing_id").alias("k"), F.lit("l").alias("kind"))
    seen = urls.union(keys).distinct()
    return seen.agg(F.count_if(c("kind") == "u").alias("urls"), F.count_if(c("kind") == "l").alias("listings"))


@query("D12_fetch_stats", f"WITH {R.EVENTS} SELECT source, count(*) AS requests, count(*) FILTER (status_code = 200) AS success, count(*) FILTER (status_code = 403) AS blocked, CAST(floor(avg(latency_ms)) AS BIGINT) AS avg_latency_ms FROM fetches GROUP BY source")
def _(spark, folder):
    return stats.fetch_stats(fetch_log_from_events(spark, folder))


@query("D13_digest", SQ("SELECT '📊 RÉCAPITULATIF - ' || (SELECT count(*) FROM v1) || ' annonces' || chr(10) || chr(10) || string_agg(e || ' ' || marque || ' ' || modele || ' - ' || coalesce(CAST(prix AS VARCHAR), 'None') || '€ - Score: ' || score_rentabilite, chr(10) ORDER BY score_rentabilite DESC, arrival_seq) "
       "|| chr(10) || chr(10) || '... et ' || ((SELECT count(*) FROM v1) - 10) || ' autres' AS message FROM (SELECT *, CASE WHEN score_rentabilite >= 80 THEN '🔴' WHEN score_rentabilite >= 60 THEN '🟠' WHEN score_rentabilite >= 40 THEN '🟡' ELSE '⚪' END AS e FROM v1 ORDER BY score_rentabilite DESC, arrival_seq LIMIT 10)", CLASSIC_SQL))
def _(spark, folder):
    from carsift.functions.formats import alert_emoji

    df = classic(spark, folder).select(alert_emoji(c("niveau_alerte")).alias("emoji"), "marque", "modele", "prix", c("score_rentabilite").alias("score"), KEY)
    return stats.digest(df, [c("score").desc(), c(KEY)])


@query("D14_page_count", SQ("SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) AS total_pages FROM stored WHERE status = 'nouveau'", STORED))
def _(spark, folder):
    return filters.page_count(stored(spark, folder).filter(c("status") == "nouveau"), 100)


# ---- E: order-dependent -----------------------------------------------------------------------------------------
@query("E6_compare_with_best", SQ("SELECT arrival_seq, diff_prix, diff_km, diff_score FROM (SELECT arrival_seq, coalesce(prix, 0) - coalesce(first_value(prix) OVER w, 0) AS diff_prix, coalesce(kilometrage, 0) - coalesce(first_value(kilometrage) OVER w, 0) AS diff_km, "
       "score_rentabilite - first_value(score_rentabilite) OVER w AS diff_score, row_number() OVER w AS rn FROM (SELECT *, " + SOFT_SQL + " AS fs FROM v1) WINDOW w AS (PARTITION BY fs ORDER BY score_rentabilite DESC, arrival_seq)) WHERE rn > 1", CLASSIC_SQL))
def _(spark, folder):
    return merge.compare_with_best(with_soft(classic(spark, folder)), "fingerprint_soft", "score_rentabilite").select(KEY, "diff_prix", "diff_km", "diff_score")


def day_number(ts="ts"):
    return F.unix_date(F.to_date(ts))


@query("E7_zero_streaks", f"WITH {R.EVENTS}, g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY event_id) AS isl FROM fetches) SELECT event_id, CASE WHEN failed THEN row_number() OVER (PARTITION BY source, isl, failed ORDER BY event_id) ELSE 0 END AS streak FROM g")
def _(spark, folder):
    """Runs without results per source (a failed fetch stands for a run with nothing found); alert from three on."""
    log = fetch_log_from_events(spark, folder).select("event_id", "source", "failed")
    return ordered.streaks(log, "source", "event_id", F.floor(c("event_id") / 4096), c("failed")).select("event_id", "streak")


@query("J9_zero_listing_alerts", f"WITH {R.EVENTS}, g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY event_id) AS isl FROM fetches), s AS (SELECT source, CASE WHEN failed THEN row_number() OVER (PARTITION BY source, isl, failed ORDER BY event_id) ELSE 0 END AS streak FROM g) SELECT source, count(*) FILTER (streak = 3) AS alertes, max(streak) AS plus_longue FROM s GROUP BY source")
def _(spark, folder):
    log = fetch_log_from_events(spark, folder).select("event_id", "source", "failed")
    s = ordered.streaks(log, "source", "event_id", F.floor(c("event_id") / 4096), c("failed"))
    return s.groupBy("source").agg(F.count_if(c("streak") == 3).alias("alertes"), F.max("streak").alias("plus_longue"))


@query("E8_price_and_score_changes", SQ("SELECT arrival_seq, prix - lag(prix) OVER w AS d_prix, score_total - lag(score_total) OVER w AS d_score, coalesce(lag(prix) OVER w <> 0 AND prix < lag(prix) OVER w * 0.95e0, false) AS dropped FROM stored WINDOW w AS (PARTITION BY fingerprint ORDER BY arrival_seq)", STORED))
def _(spark, folder):
    df = stored(spark, folder).select(KEY, "fingerprint", "prix", "score_total")
    out = ordered.lag_by_key(df, ["fingerprint"], KEY, F.floor(c(KEY) / F.lit(10**11)), ["prix", "score_total"])
    dropped = F.coalesce((c("prev_prix") != 0) & (c("prix") < c("prev_prix") * 0.95), F.lit(False))
    return out.select(KEY, (c("prix") - c("prev_prix")).alias("d_prix"), (c("score_total") - c("prev_score_total")).alias("d_score"), dropped.alias("dropped"))


@query("E10_top_ranks", SQ("SELECT CAST(row_number() OVER (ORDER BY score_rentabilite DESC, arrival_seq) AS INT) AS rang, arrival_seq, score_rentabilite FROM v1 ORDER BY rang LIMIT 20", CLASSIC_SQL))
def _(spark, folder):
    top = classic(spark, folder).orderBy(c("score_rentabilite").desc(), KEY).limit(20).select(KEY, "score_rentabilite")
    return top.withColumn("rang", F.row_number().over(W.orderBy(c("score_rentabilite").desc(), KEY)))


@query("E11_first_cards_per_source_day", SQ("SELECT arrival_seq, row_number() OVER (PARTITION BY source, published_at ORDER BY arrival_seq)::INTEGER AS card_no FROM src"))
def _(spark, folder):
    """Each card's place on its page; keeping the first N is a filter on it, which Spark turns into a group limit."""
    return raw(spark, folder).select(KEY, F.row_number().over(W.partitionBy("source", "published_at").orderBy(KEY)).alias("card_no"))


# ---- F: sort and top-k ------------------------------------------------------------------------------------------
@query("F1_sort_by_score", SQ("SELECT arrival_seq, score_total FROM scored ORDER BY score_total DESC, arrival_seq", R.scored()))
def _(spark, folder):
    return scored(spark, folder).select(KEY, "score_total").orderBy(c("score_total").desc(), KEY)


@query("F2_order_by_price", SQ("SELECT arrival_seq, prix FROM stored ORDER BY prix ASC NULLS FIRST, arrival_seq LIMIT 100", STORED))
def _(spark, folder):
    return filters.page(stored(spark, folder), "prix ASC", 100).select(KEY, "prix")


@query("F3_detail_queue", SQ("SELECT arrival_seq, priority, score_light FROM light WHERE score_light >= 30 ORDER BY priority DESC, arrival_seq LIMIT 10", LIGHT_SQL))
def _(spark, folder):
    runner, defaults = dic.builtin("searches")["runner"], dic.builtin("searches")["defaults"]
    q = light(spark, folder).filter(c("score_light") >= defaults["detail_threshold"])
    return q.orderBy(c("priority").desc(), KEY).limit(runner["max_detail_per_run"]).select(KEY, "priority", "score_light")


@query("F4_top_listings", SQ("SELECT arrival_seq, score_total FROM stored WHERE status NOT IN ('ignore', 'exclue') ORDER BY score_total DESC, arrival_seq LIMIT 10", STORED))
def _(spark, folder):
    return filters.ordered(stored(spark, folder).filter(~c("status").isin("ignore", "exclue"))).limit(10).select(KEY, "score_total")


@query("F5_second_page", SQ("SELECT arrival_seq, score_total FROM stored ORDER BY score_total DESC, arrival_seq LIMIT 50 OFFSET 50", STORED))
def _(spark, folder):
    return filters.page(stored(spark, folder), limit=50, offset=50).select(KEY, "score_total")


# ---- A: table operators -----------------------------------------------------------------------------------------
LAST = "last AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY arrival_seq DESC) = 1)"
_COLS = ["fingerprint", "arrival_seq", "prix", "score_total", "status", "created_at", "updated_at", "notified", "notified_at", "notify_channels", "ignore_reason"]


def table_and_changes(spark, folder):
    t = stored(spark, folder).withColumns({"notified_at": F.lit(None).cast("timestamp"), "notify_channels": F.array().cast("array<string>")}).select(*_COLS, "published_at")
    existing = dedup.first_per_key(before(t), c("fingerprint"), [c("created_at").desc(), c(KEY).desc()])
    return existing, store.last_per_fingerprint(after(t))


UPSERT = (f"ups AS (SELECT coalesce(o.fingerprint, n.fingerprint) AS fingerprint, coalesce(n.arrival_seq, o.arrival_seq) AS arrival_seq, CASE WHEN n.fingerprint IS NOT NULL THEN n.prix ELSE o.prix END AS prix, coalesce(n.score_total, o.score_total) AS score_total, "
          f"coalesce(n.status, o.status) AS status, coalesce(o.created_at, n.created_at) AS created_at, CASE WHEN n.fingerprint IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE o.updated_at END AS updated_at, coalesce(o.notified, false) OR coalesce(n.notified, false) AS notified, "
          f"o.fingerprint IS NULL AS is_new FROM uhist o FULL JOIN last n ON o.fingerprint = n.fingerprint)")


@query("A23_upsert", SQ("SELECT * FROM ups", STORED, SHIST, UHIST, LAST, UPSERT))
def _(spark, folder):
    existing, changes = table_and_changes(spark, folder)
    return store.upsert(existing, changes, now()).select("fingerprint", KEY, "prix", "score_total", "status", "created_at", "updated_at", "notified", "is_new")


@query("A24_classic_save", SQ("SELECT md5(coalesce(o.url, n.url)) AS id, coalesce(n.prix, CASE WHEN n.url IS NULL THEN o.prix END) AS prix, o.url IS NULL AS is_new FROM (SELECT * FROM ids WHERE published_at < TIMESTAMP '" + CUT + "' QUALIFY row_number() OVER (PARTITION BY url ORDER BY arrival_seq DESC) = 1) o "
       "FULL JOIN (SELECT * FROM ids WHERE published_at >= TIMESTAMP '" + CUT + "' QUALIFY row_number() OVER (PARTITION BY url ORDER BY arrival_seq DESC) = 1) n ON o.url = n.url", IDS))
def _(spark, folder):
    df = raw(spark, folder).select(KEY, "url", "prix", "published_at").withColumns({"id": idf.classic_id(c("url")), "created_at": c("published_at"), "updated_at": c("published_at")})
    last = lambda d: dedup.first_per_key(d, c("id"), [c(KEY).desc()])
    return store.upsert(last(before(df)), last(after(df)), now(), key="id").select("id", "prix", "is_new")


@query("A25_mutations", SQ(f"SELECT fingerprint, CASE WHEN score_total >= 60 THEN true ELSE notified END AS notified, CASE WHEN score_total >= 60 THEN TIMESTAMP '{NOW}' END AS notified_at, CASE WHEN prix > 4000 THEN 'ignore' ELSE status END AS status, "
       "CASE WHEN prix > 4000 THEN 'trop cher' ELSE ignore_reason END AS ignore_reason FROM uhist WHERE prix IS NOT NULL", STORED, SHIST, UHIST))
def _(spark, folder):
    t, _changes = table_and_changes(spark, folder)
    t = store.mark_notified(t, t.filter(c("score_total") >= 60), F.array(F.lit("discord")), now())
    rejected = t.filter(c("prix") > 4000).select("fingerprint", F.lit("ignore").alias("new_status"), F.lit("trop cher").alias("new_reason"))
    t = store.update_status(t, rejected, now())
    t = store.delete(t, t.filter(c("prix").isNull()))
    return t.select("fingerprint", "notified", "notified_at", "status", "ignore_reason")


@query("A26_export_rows", SQ("SELECT score_total, marque, modele, prix, kilometrage, annee, departement, alert_level, url, created_at FROM stored WHERE score_total >= 40 ORDER BY score_total DESC, arrival_seq", STORED))
def _(spark, folder):
    return store.export_rows(stored(spark, folder), 40).select(*store.EXPORT_COLUMNS)


@query("A22_encode_decode", SQ("SELECT arrival_seq, keywords_opportunite AS opp, notified, epoch(created_at)::BIGINT AS created_s, total AS bd_total FROM stored", STORED))
def _(spark, folder):
    """Rows to the text form of a row store and back (also covers A21)."""
    from carsift.operators.scoring import nest_breakdown

    df = nest_breakdown(stored(spark, folder)).select(KEY, "keywords_opportunite", "keywords_risque", "score_breakdown", "notified", "created_at")
    back = store.decode(store.encode(df))
    return back.select(KEY, F.array_join("keywords_opportunite", ", ").alias("opp"), "notified", F.unix_seconds("created_at").alias("created_s"), c("score_breakdown.total").alias("bd_total"))


@query("A27_export_json", SQ("SELECT arrival_seq, CAST(json_extract(to_json({'a': arrival_seq, 'p': prix, 's': score_total}), '$.p') AS VARCHAR) AS prix_json FROM stored WHERE score_total >= 40 AND prix IS NOT NULL ORDER BY score_total DESC, arrival_seq", STORED))
def _(spark, folder):
    rows = store.export_rows(stored(spark, folder).filter(c("prix").isNotNull()), 40)
    return rows.select(KEY, F.get_json_object(F.to_json(F.struct(KEY, "prix", "score_total")), "$.prix").alias("prix_json"))


@query("A28_scan_history", f"WITH {R.EVENTS} SELECT source, 'completed' AS status, count(*) AS listings_found, count(*) FILTER (event_type_purchase) AS listings_new, count(*) FILTER (failed) AS errors_count FROM (SELECT f.*, e.event_type = 'purchase' AS event_type_purchase FROM fetches f JOIN events e USING (event_id)) GROUP BY source")
def _(spark, folder):
    log = fetch_log_from_events(spark, folder).join(read_table(spark, folder, "events").select("event_id", "event_type"), "event_id")
    per = log.groupBy("source").agg(F.count("*").alias("index_count"), F.count_if(c("event_type") == "purchase").alias("new_count"), F.count_if("failed").alias("error_count"))
    return store.scan_history_rows(per, now()).select("source", "status", "listings_found", "listings_new", "errors_count")


@query("A29_scan_durations", "SELECT o_orderkey AS scan_id, coalesce(e.st, 'running') AS status, CAST(epoch(e.fin) - epoch(o_orderdate) AS DOUBLE) AS duration_seconds FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS fin, 'completed' AS st FROM lineitem GROUP BY l_orderkey) e ON l_orderkey = o_orderkey")
def _(spark, folder):
    """Start and end events of a scan (an order starts it, its last shipment ends it)."""
    started = read_table(spark, folder, "orders").select(c("o_orderkey").alias("scan_id"), c("o_orderdate").cast("timestamp").alias("started_at"))
    ended = read_table(spark, folder, "lineitem").groupBy(c("l_orderkey").alias("scan_id")).agg(
        F.max("l_shipdate").cast("timestamp").alias("finished_at")).withColumn("end_status", F.lit("completed"))
    return store.close_scans(started, ended).select("scan_id", "status", "duration_seconds")


@query("J8_source_status", f"WITH {R.EVENTS} SELECT source, arg_max(status_code, event_id) AS last_status, max(event_id) AS last_event, max(event_id) FILTER (failed) AS last_failure, max(event_id) FILTER (NOT failed) AS last_success FROM fetches GROUP BY source")
def _(spark, folder):
    return fetch_log_from_events(spark, folder).groupBy("source").agg(
        F.max_by("status_code", "event_id").alias("last_status"), F.max("event_id").alias("last_event"),
        F.max(F.when(c("failed"), c("event_id"))).alias("last_failure"), F.max(F.when(~c("failed"), c("event_id"))).alias("last_success"))
