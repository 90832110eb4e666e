"""Queries: scalar functions (survey section H) over listing texts, documents and page URLs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from carsift.functions import formats as fm
from carsift.functions import identity as idf
from carsift.functions import parse as ps
from carsift.functions import text as tx
from carsift.functions.urls import canonical_url
from carsift.plans import reference_sql as R
from carsift.plans.catalog_scoring import KEY, as_of_hours, as_of_minutes, flat, scored
from carsift.plans.registry import query
from carsift.sources.dictionaries import builtin
from carsift.sources.listings import listings_from_orders, read_table, spread

c = F.col
P = builtin("parsing")
YEAR = 2018

# raw texts built from listing numbers; the same SQL text is valid in both engines
_K = "CAST(CAST(floor({0} / 1000) AS INT) AS STRING)"
_R = "lpad(CAST({0} % 1000 AS STRING), 3, '0')"


def _grouped(col, sep, unit):
    return f"concat({_K.format(col)}, '{sep}', {_R.format(col)}, '{unit}')"


TEXTS = {
    "price_text": f"CASE arrival_seq % 6 WHEN 0 THEN concat('Prix: ', {_grouped('prix', ' ', ' € négociable')}) WHEN 1 THEN concat(CAST(prix AS STRING), '€') "
                  f"WHEN 2 THEN {_grouped('prix', '.', ' €')} WHEN 3 THEN {_grouped('prix', chr(0xA0), chr(0x202F) + '€')} WHEN 4 THEN CAST(prix AS STRING) ELSE 'gratuit' END",
    "km_text": f"CASE arrival_seq % 5 WHEN 0 THEN {_grouped('kilometrage', ' ', ' km')} WHEN 1 THEN concat(CAST(kilometrage AS STRING), 'KM au compteur') "
               f"WHEN 2 THEN {_grouped('kilometrage', '.', ' Km')} WHEN 3 THEN {_grouped('kilometrage', chr(0xA0), chr(0xA0) + 'km')} ELSE 'beaucoup' END",
    "year_text": "CASE arrival_seq % 4 WHEN 0 THEN concat('année ', CAST(annee AS STRING)) WHEN 1 THEN concat('01/', CAST(annee AS STRING)) "
                 "WHEN 2 THEN concat(CAST(annee - 4 AS STRING), '-', CAST(annee AS STRING)) ELSE concat('x', coalesce(CAST(annee AS STRING), '?'), ' 1985 2035') END",
    "place_text": "CASE arrival_seq % 4 WHEN 0 THEN concat('Créteil (', departement, ')') WHEN 1 THEN concat(departement, '100 Ville') WHEN 2 THEN concat('Lieu (', departement, '0)') ELSE 'France' END",
    "power_text": "concat(version, CASE arrival_seq % 3 WHEN 0 THEN ' 90 CV' WHEN 1 THEN ' 5 vitesses' ELSE ' 1.6 20hp' END)",
    "seller_text": "CASE arrival_seq % 6 WHEN 0 THEN 'Garage Auto Plus' WHEN 1 THEN 'Jean Dupont' WHEN 2 THEN seller_type WHEN 3 THEN 'Privé' WHEN 4 THEN 'Très propre' ELSE 'Private owner' END",
    "gearbox_text": "CASE arrival_seq % 5 WHEN 0 THEN 'Boîte manuelle' WHEN 1 THEN 'BVA' WHEN 2 THEN '5 vitesses' WHEN 3 THEN 'DSG7' ELSE version END",
    "fuel_text": "CASE arrival_seq % 7 WHEN 0 THEN carburant WHEN 1 THEN version WHEN 2 THEN 'Hybride' WHEN 3 THEN 'Électrique' WHEN 4 THEN 'GPL' WHEN 5 THEN 'Sans plomb 95' ELSE 'chevaux' END",
    "phone_text": "concat(description, ' Tél: 0', CAST(1 + arrival_seq % 9 AS STRING), CASE arrival_seq % 3 WHEN 0 THEN ' 12 34 56 78' WHEN 1 THEN '.12.34.56.78' ELSE '1234567' END, ' ou a', CAST(age_hours AS STRING), '@mail.fr')",
    "title_text": "CASE WHEN arrival_seq % 2 = 0 THEN titre ELSE trim(concat(modele, ' ', version)) END",
    "brand_text": "CASE arrival_seq % 4 WHEN 0 THEN upper(marque) WHEN 1 THEN lower(marque) WHEN 2 THEN ' vw ' ELSE 'citroen' END",
    "model_text": "concat(modele, ' ', version)",
    "iso_text": "CASE arrival_seq % 3 WHEN 0 THEN concat(substring(CAST(published_at AS STRING), 1, 10), 'T01:02:03Z') WHEN 1 THEN concat(substring(CAST(published_at AS STRING), 1, 10), 'T01:02:03+00:00') ELSE 'hier' END",
}


def L(spark, folder, *texts):
    df = listings_from_orders(spark, folder)
    return df.withColumns({t: F.expr(TEXTS[t]) for t in texts}) if texts else df


def LS(select, *texts, ctes="", source="lt"):
    cols = "".join(f", {TEXTS[t]} AS {t}" for t in texts)
    return f"WITH {R.SRC}, lt AS (SELECT *{cols} FROM src){ctes} SELECT {select} FROM {source}"


def docs(spark, folder):
    return spread(read_table(spark, folder, "documents").select("doc_id", "text"))


_SP = r"\t-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def X(expr, pattern, group=1):
    return f"nullif(regexp_extract({expr}, {R.q(pattern)}, {group}), '')"


def DIG(expr):
    return f"TRY_CAST(regexp_replace({expr}, '[^0-9]', '', 'g') AS BIGINT)"


def BET(expr, lo, hi):
    return f"CAST(CASE WHEN {expr} BETWEEN {lo} AND {hi} THEN {expr} END AS INT)"


@query("H1_canonical_url", f"WITH {R.SRC} SELECT arrival_seq AS id, {R.canonical_url('url')} AS url_canonique FROM src UNION ALL SELECT page_id, {R.canonical_url('url')} FROM pages")
def _(spark, folder):
    pages = read_table(spark, folder, "pages").select(c("page_id").alias("id"), "url")
    both = listings_from_orders(spark, folder).select(c(KEY).alias("id"), "url").unionByName(pages)
    return both.select("id", canonical_url(c("url")).alias("url_canonique"))


FP_SQL = (f"substr(sha256(CASE WHEN coalesce(source_listing_id, '') <> '' THEN source || ':' || source_listing_id ELSE concat_ws('|', source, {R.ident('marque')}, {R.ident('modele')}, "
          f"coalesce(CAST(nullif(annee, 0) AS VARCHAR), ''), coalesce(CAST(nullif(kilometrage, 0) AS VARCHAR), ''), coalesce(CAST(nullif(prix, 0) AS VARCHAR), ''), departement, substr({R.ident('titre')}, 1, 50)) END), 1, 32)")
SOFT_SQL = (f"substr(sha256(concat_ws('|', {R.ident('marque')}, {R.ident('modele')}, coalesce(CAST(annee AS VARCHAR), ''), "
            f"coalesce(CAST(nullif(kilometrage, 0) // 10000 * 10000 AS VARCHAR), ''), departement)), 1, 16)")


def with_fingerprint(df):
    return df.withColumn("fingerprint", idf.fingerprint(*[c(x) for x in ("source", "source_listing_id", "marque", "modele", "annee", "kilometrage", "prix", "departement", "titre")]))


def with_soft(df):
    return df.withColumn("fingerprint_soft", idf.fingerprint_soft(*[c(x) for x in ("marque", "modele", "annee", "kilometrage", "departement")]))


@query("H2_fingerprint", LS(f"arrival_seq, {FP_SQL} AS fingerprint"))
def _(spark, folder):
    return with_fingerprint(L(spark, folder)).select(KEY, "fingerprint")


@query("H3_soft_fingerprint", LS(f"arrival_seq, {SOFT_SQL} AS fingerprint_soft"))
def _(spark, folder):
    return with_soft(L(spark, folder)).select(KEY, "fingerprint_soft")


@query("H4_classic_id", LS("arrival_seq, md5(url) AS id"))
def _(spark, folder):
    return L(spark, folder).select(KEY, idf.classic_id(c("url")).alias("id"))


HASH_SQL = "md5(concat_ws('|', marque, modele, coalesce(CAST(prix AS VARCHAR), 'None'), coalesce(CAST(kilometrage AS VARCHAR), 'None'), departement))"


@query("H5_content_hash", LS(f"arrival_seq, {HASH_SQL} AS h"))
def _(spark, folder):
    return L(spark, folder).select(KEY, idf.content_hash(*[c(x) for x in ("marque", "modele", "prix", "kilometrage", "departement")]).alias("h"))


@query("H6_identity_text", LS(f"arrival_seq, {R.ident('description')} AS n"))
def _(spark, folder):
    return L(spark, folder).select(KEY, tx.normalize_identity(c("description")).alias("n"))


@query("H7_remove_accents", "SELECT doc_id, strip_accents(text) AS t FROM documents")
def _(spark, folder):
    return docs(spark, folder).select("doc_id", tx.remove_accents(c("text")).alias("t"))


@query("H8_normalize_keywords", f"SELECT doc_id, {R.norm('text')} AS t FROM documents")
def _(spark, folder):
    return docs(spark, folder).select("doc_id", tx.normalize_keywords(c("text")).alias("t"))


@query("H9_normalize_plain", f"SELECT doc_id, trim(regexp_replace(lower(text), '[{_SP}]+', ' ', 'g')) AS t FROM documents")
def _(spark, folder):
    return docs(spark, folder).select("doc_id", tx.normalize_plain(c("text")).alias("t"))


@query("H10_clean_for_matching", "SELECT doc_id, regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g') AS t FROM documents")
def _(spark, folder):
    return docs(spark, folder).select("doc_id", tx.clean_for_matching(c("text")).alias("t"))


_MARK = X("price_text", f"([0-9][0-9{_SP}.,]*)[{_SP}]*€")


@query("H11_parse_price", LS(f"arrival_seq, CASE WHEN {_MARK} IS NOT NULL THEN {BET(DIG(_MARK), 100, 100000)} ELSE {BET(DIG('price_text'), 500, 100000)} END AS prix", "price_text"))
def _(spark, folder):
    return L(spark, folder, "price_text").select(KEY, ps.parse_price(c("price_text")).alias("prix"))


@query("H12_parse_km", LS(f"arrival_seq, {BET(DIG(X('km_text', f'(?i)([0-9][0-9{_SP}.,]*)[{_SP}]*km')), 100, 500000)} AS km", "km_text"))
def _(spark, folder):
    return L(spark, folder, "km_text").select(KEY, ps.parse_km(c("km_text")).alias("km"))


@query("H13_parse_year", LS("arrival_seq, CAST(list_max(list_filter(list_transform(regexp_extract_all(year_text, '\\b(19[89]\\d|20[0-3]\\d)\\b', 1), lambda y: CAST(y AS INT)), "
                            f"lambda y: y BETWEEN 1990 AND {YEAR + 1})) AS INT) AS annee", "year_text"))
def _(spark, folder):
    return L(spark, folder, "year_text").select(KEY, ps.parse_year(c("year_text"), F.lit(YEAR)).alias("annee"))


@query("H14_parse_departement", LS(f"arrival_seq, coalesce(substr({X('place_text', chr(92) + 'b([0-9]{5})' + chr(92) + 'b')}, 1, 2), {X('place_text', chr(92) + '(([0-9]{2})' + chr(92) + ')')}) AS dept", "place_text"))
def _(spark, folder):
    return L(spark, folder, "place_text").select(KEY, ps.parse_departement(c("place_text")).alias("dept"))


@query("H15_parse_code_postal", LS(f"arrival_seq, {X('place_text', chr(92) + 'b([0-9]{5})' + chr(92) + 'b')} AS cp", "place_text"))
def _(spark, folder):
    return L(spark, folder, "place_text").select(KEY, ps.parse_code_postal(c("place_text")).alias("cp"))


@query("H16_extract_departement", LS(f"arrival_seq, CASE WHEN length(departement) >= 2 AND arrival_seq % 5 = 0 THEN substr(departement, 1, 2) ELSE coalesce(substr({X('place_text', chr(92) + 'b([0-9]{5})' + chr(92) + 'b')}, 1, 2), "
       f"substr({X('place_text', chr(92) + '(([0-9]{2,3})' + chr(92) + ')')}, 1, 2)) END AS dept", "place_text"))
def _(spark, folder):
    code = F.when(c(KEY) % 5 == 0, c("departement"))
    return L(spark, folder, "place_text").select(KEY, ps.extract_departement(c("place_text"), code).alias("dept"))


def _classes(expr, classes):
    return "CASE " + " ".join(f"WHEN {R.any_word(f'lower({expr})', ws)} THEN {R.q(k)}" for k, ws in classes.items()) + " ELSE 'unknown' END"


@query("H17_parse_carburant", LS(f"arrival_seq, {_classes('fuel_text', P['fuel_words'])} AS carburant", "fuel_text"))
def _(spark, folder):
    return L(spark, folder, "fuel_text").select(KEY, ps.parse_carburant(c("fuel_text")).alias("carburant"))


@query("H18_parse_boite", LS(f"arrival_seq, {_classes('gearbox_text', P['gearbox_words'])} AS boite", "gearbox_text"))
def _(spark, folder):
    return L(spark, folder, "gearbox_text").select(KEY, ps.parse_boite(c("gearbox_text")).alias("boite"))


@query("H19_parse_puissance", LS(f"arrival_seq, {BET(DIG(X('power_text', f'(?i)([0-9]{{2,3}})[{_SP}]*(?:ch|cv|hp)')), 40, 500)} AS ch", "power_text"))
def _(spark, folder):
    return L(spark, folder, "power_text").select(KEY, ps.parse_puissance(c("power_text")).alias("ch"))


@query("H20_parse_seller_type", LS(f"arrival_seq, {_classes('seller_text', P['seller_words'])} AS vendeur", "seller_text"))
def _(spark, folder):
    return L(spark, folder, "seller_text").select(KEY, ps.parse_seller_type(c("seller_text")).alias("vendeur"))


_PHONE = rf"((?:0|\+33)[1-9](?:[{_SP}.\-]?[0-9]{{2}}){{4}})"


@query("H21_extract_phone", LS(f"arrival_seq AS id, regexp_replace({X('phone_text', _PHONE)}, '[{_SP}.\\-]', '', 'g') AS tel", "phone_text")
       + f" UNION ALL SELECT doc_id, regexp_replace({X('text', _PHONE)}, '[{_SP}.\\-]', '', 'g') FROM documents")
def _(spark, folder):
    both = L(spark, folder, "phone_text").select(c(KEY).alias("id"), c("phone_text").alias("t")).union(docs(spark, folder))
    return both.select("id", ps.extract_phone(c("t")).alias("tel"))


_TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '([A-Za-z]+|[^A-Za-z]+)'), lambda s: upper(s[1:1]) || lower(s[2:])), '')"


@query("H22_normalize_marque", LS("arrival_seq, CASE lower(trim(brand_text)) WHEN 'vw' THEN 'Volkswagen' WHEN 'citroen' THEN 'Citroën' ELSE " + _TITLE.format("trim(brand_text)") + " END AS marque", "brand_text"))
def _(spark, folder):
    return L(spark, folder, "brand_text").select(KEY, ps.normalize_marque(c("brand_text")).alias("marque"))


_MODEL = r"trim(regexp_replace(regexp_replace({0}, '(?i)[0-9]+\.[0-9]+\s*(hdi|dci|tdi|vti|tce|dti|cdti|jtd).*', ''), '(?i)[0-9]+\s*(ch|cv).*', ''))"


@query("H23_normalize_modele", LS("arrival_seq, " + _TITLE.format(_MODEL.format("trim(model_text)")) + " AS modele", "model_text"))
def _(spark, folder):
    return L(spark, folder, "model_text").select(KEY, ps.normalize_modele(c("model_text")).alias("modele"))


def title_ctes(src="lt", col="title_text"):
    models = [(m, b) for b, ms in P["brand_models"].items() for m in ms]
    brand = "CASE " + " ".join(f"WHEN contains(lower({col}), {R.q(b.lower())}) THEN {R.q(b)}" for b in P["brands"]) + " ELSE '' END"
    inl = "(" + ", ".join(R.q(m.lower()) for m, _ in models) + ")"
    cl = lambda i: f"lower(regexp_replace(ws[{i}], '[^a-zA-Z0-9]', '', 'g'))"
    canon = "CASE {0} " + " ".join(f"WHEN {R.q(m.lower())} THEN {R.q(m)}" for m, _ in models) + " END"
    owner = "CASE lower(m0) " + " ".join(f"WHEN {R.q(m.lower())} THEN {R.q(b)}" for m, b in models) + " ELSE '' END"
    return (
        f", tt1 AS (SELECT *, {brand} AS br FROM {src}), "
        f"tt2 AS (SELECT *, CASE WHEN br = '' THEN trim({col}) ELSE trim(regexp_replace({col}, '(?i)' || br, '')) END AS rest FROM tt1), "
        f"tt3 AS (SELECT *, list_filter(string_split(regexp_replace(rest, '\\s+', ' ', 'g'), ' '), lambda s: s <> '') AS ws FROM tt2), "
        f"tt4 AS (SELECT *, CASE WHEN {cl(1)} IN {inl} THEN 1 WHEN {cl(2)} IN {inl} THEN 2 WHEN {cl(3)} IN {inl} THEN 3 END AS kk FROM tt3), "
        f"tt5 AS (SELECT *, coalesce(CASE WHEN kk IS NOT NULL THEN {canon.format('lower(regexp_replace(ws[kk], ' + R.q('[^a-zA-Z0-9]') + ', ' + R.q('') + ', ' + R.q('g') + '))')} ELSE ws[1] END, '') AS m0 FROM tt4), "
        f"titles AS (SELECT *, CASE CASE WHEN br <> '' THEN br ELSE {owner} END WHEN 'VW' THEN 'Volkswagen' WHEN 'Citroen' THEN 'Citroën' WHEN 'Mercedes' THEN 'Mercedes-Benz' WHEN 'BMW' THEN 'Bmw' ELSE (CASE WHEN br <> '' THEN br ELSE {owner} END) END AS t_marque, "
        f"{_TITLE.format(_MODEL.format('m0'))} AS t_modele, CASE WHEN kk IS NOT NULL THEN array_to_string(list_filter(ws, lambda s: s <> ws[kk]), ' ') WHEN len(ws) > 0 THEN coalesce(array_to_string(ws[2:], ' '), '') ELSE rest END AS t_version FROM tt5)")


@query("H24_parse_title", LS("arrival_seq, t_marque, t_modele, coalesce(t_version, '') AS t_version", "title_text", ctes=title_ctes(), source="titles"))
def _(spark, folder):
    return ps.with_title_parts(L(spark, folder, "title_text"), "title_text").select(KEY, "t_marque", "t_modele", "t_version")


@query("H25_extract_motorisation", LS("arrival_seq, coalesce(trim(coalesce(" + X("power_text", r"(?i)([0-9]+\.[0-9]+\s*(?:hdi|dci|tdi|vti|tce|dti|cdti|jtd|d-4d|bluehdi|blue\s*hdi))") + ", "
       + X("power_text", r"(?i)([0-9]+\.[0-9]+\s*(?:litres|litre|l)?)") + ", " + X("power_text", r"(?i)([0-9]{2,3}\s*(?:ch|cv|hp))") + ")), '') AS moteur", "power_text"))
def _(spark, folder):
    return L(spark, folder, "power_text").select(KEY, ps.extract_motorisation(c("power_text")).alias("moteur"))


@query("H26_clean_numbers", LS(f"arrival_seq, {DIG('price_text')} AS prix, {DIG('km_text')} AS km, TRY_CAST({X('year_text', '((?:19|20)[0-9]{2})')} AS INT) AS annee", "price_text", "km_text", "year_text"))
def _(spark, folder):
    return L(spark, folder, "price_text", "km_text", "year_text").select(
        KEY, ps.clean_number(c("price_text")).alias("prix"), ps.clean_number(c("km_text")).alias("km"), ps.clean_year(c("year_text")).alias("annee"))


@query("H27_format_numbers", LS(f"arrival_seq, coalesce({R.thousands('prix')} || ' €', 'N/C') AS prix_fr, coalesce({R.thousands('kilometrage')} || ' km', 'N/C') AS km_fr"))
def _(spark, folder):
    return L(spark, folder).select(KEY, fm.format_price_fr(c("prix")).alias("prix_fr"), fm.format_km_fr(c("kilometrage")).alias("km_fr"))


@query("H28_time_ago", LS("arrival_seq, CASE WHEN age_hours < 1 THEN 'à l''instant' WHEN age_hours < 24 THEN 'il y a ' || age_hours || 'h' WHEN age_hours < 168 THEN 'il y a ' || (age_hours // 24) || 'j' ELSE strftime(published_at, '%d/%m/%Y') END AS age"))
def _(spark, folder):
    return L(spark, folder).select(KEY, fm.time_ago(c("published_at"), as_of_hours()).alias("age"))


@query("H29_age_minutes", LS("arrival_seq, CAST(CASE WHEN annee IS NULL THEN 999999 ELSE age_hours END AS INT) AS minutes"))
def _(spark, folder):
    ts = F.when(c("annee").isNotNull(), c("published_at"))
    return L(spark, folder).select(KEY, fm.age_minutes(ts, as_of_minutes()).alias("minutes"))


@query("H30_parse_iso_time", LS("arrival_seq, CAST(epoch(TRY_CAST(iso_text AS TIMESTAMPTZ)) AS BIGINT) AS unix_s", "iso_text"))
def _(spark, folder):
    return L(spark, folder, "iso_text").select(KEY, F.unix_seconds(F.try_to_timestamp("iso_text")).alias("unix_s"))


_C1 = rf"((?:\+33|0033|0)[1-9][{_SP}.\-]?(?:[0-9]{{2}}[{_SP}.\-]?){{4}})"
_C2 = rf"(?i)(tel[{_SP}:]*[0-9][0-9{_SP}.\-]{{9,}})"
_MAIL = r"([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"


def _contact(col):
    a, b = (f"regexp_replace({X(col, p)}, '[^0-9+]', '', 'g')" for p in (_C1, _C2))
    return f"coalesce(CASE WHEN length({a}) >= 10 THEN {a} END, CASE WHEN length({b}) >= 10 THEN {b} END) AS tel, {X(col, _MAIL)} AS email"


@query("H31_extract_contacts", LS(f"arrival_seq AS id, {_contact('phone_text')}", "phone_text") + f" UNION ALL SELECT doc_id, {_contact('text')} FROM documents")
def _(spark, folder):
    both = L(spark, folder, "phone_text").select(c(KEY).alias("id"), c("phone_text").alias("t")).union(docs(spark, folder))
    return both.select("id", ps.extract_contact_phone(c("t")).alias("tel"), ps.extract_email(c("t")).alias("email"))


_LEVEL = "CASE alert_level WHEN 'urgent' THEN '🔴' WHEN 'interessant' THEN '🟠' WHEN 'surveiller' THEN '🟡' ELSE '⚪' END"


@query("H33_alert_labels", f"WITH {R.SRC}, {R.scored()} SELECT arrival_seq, {_LEVEL} AS emoji, CAST(CASE alert_level WHEN 'urgent' THEN 16711680 WHEN 'interessant' THEN 16747520 WHEN 'surveiller' THEN 16766720 ELSE 8421504 END AS INT) AS couleur FROM scored")
def _(spark, folder):
    return scored(spark, folder).select(KEY, fm.alert_emoji(c("alert_level")).alias("emoji"), fm.alert_color(c("alert_level")).alias("couleur"))


def reason_sql():
    labels = P["keyword_labels"]

    def label(x):
        return "CASE " + x + " " + " ".join(f"WHEN {R.q(k)} THEN {R.q(v)}" for k, v in labels.items()) + " ELSE " + _TITLE.format(f"replace({x}, '_', ' ')") + " END"

    risk = "CASE {0} " + " ".join(f"WHEN {R.q(k)} THEN {R.q(v)}" for k, v in P["risk_labels"].items()) + " END"
    pct = "regexp_extract(prix_detail, '-?([0-9]+)%', 1)"
    price = (f"CASE WHEN contains(prix_detail, '%') THEN (CASE WHEN {pct} <> '' THEN '-' || {pct} || '% marché' END) "
             f"WHEN contains(lower(prix_detail), 'très bas') OR contains(lower(prix_detail), 'bonne affaire') THEN '🔥 Prix bas' END")
    ol, rl = "(CASE WHEN keywords_opportunite = '' THEN [] ELSE string_split(keywords_opportunite, ', ') END)", "(CASE WHEN keywords_risque = '' THEN [] ELSE string_split(keywords_risque, ', ') END)"
    items = [price] + [f"CASE WHEN len({ol}) >= {i} THEN {label(f'({ol})[{i}]')} END" for i in (1, 2, 3)]
    items += ["CASE WHEN departement <> '' THEN departement END", "CASE WHEN seller_type = 'particulier' THEN 'Particulier' END"]
    items += [f"CASE WHEN len({rl}) >= {i} THEN {risk.format(f'({rl})[{i}]')} END" for i in (1, 2)]
    return R.joined(items, " + ")


def with_reason(df):
    return df.withColumn("raison", fm.reason_line(c("prix_detail"), c("keywords_opportunite"), c("departement"), c("seller_type"), c("keywords_risque")))


@query("H34_reason_line", f"WITH {R.SRC}, {R.scored()} SELECT arrival_seq, {reason_sql()} AS raison FROM scored")
def _(spark, folder):
    return with_reason(scored(spark, folder)).select(KEY, "raison")


@query("H35_breakdown_json", f"WITH {R.SRC}, {R.scored()} SELECT arrival_seq, total, prix_detail, margin_max FROM scored")
def _(spark, folder):
    """Breakdown to JSON and back; unknown keys of the text are ignored by the schema."""
    fields = ["total", "prix_detail", "margin_max"]
    df = scored(spark, folder).select(KEY, F.to_json(F.struct(*fields, F.lit(1).alias("inconnu"))).alias("j"))
    back = F.from_json("j", T.StructType.fromDDL("total int, prix_detail string, margin_max int"))
    return df.select(KEY, back.alias("b")).select(KEY, *[c(f"b.{f}").alias(f) for f in fields])


@query("H36_classic_title", LS("arrival_seq, mq AS marque, nullif(string_split(trim(string_split(lower(title_text), lower(mq))[2]), ' ')[1], '') AS modele",
       "title_text", ctes=", lc AS (SELECT *, CASE " + " ".join(f"WHEN contains(lower(title_text), '{b}') THEN '{b.capitalize()}'" for b in ["peugeot", "renault", "dacia", "ford", "toyota"]) + " END AS mq FROM lt)", source="lc"))
def _(spark, folder):
    t = ps.split_classic_title(c("title_text"))
    return L(spark, folder, "title_text").select(KEY, t.alias("t")).select(KEY, c("t.marque").alias("marque"), c("t.modele").alias("modele"))


@query("H37_bucket_labels", LS("arrival_seq, CAST(annee // 3 * 3 AS INT) || '-' || CAST(annee // 3 * 3 + 2 AS INT) AS annee_bucket, CAST(kilometrage // 50000 * 50000 AS INT) || '-' || CAST(kilometrage // 50000 * 50000 + 50000 AS INT) AS km_bucket"))
def _(spark, folder):
    return L(spark, folder).select(KEY, fm.year_bucket(c("annee")).alias("annee_bucket"), fm.km_bucket(c("kilometrage")).alias("km_bucket"))


_SUM = " || ' | ' || "


def _card_sql():
    t = R.thousands
    return ("rtrim('🚗 ' || marque || ' ' || modele || ' ' || version) || chr(10) || '💰 ' || coalesce(" + t("prix") + " || ' €', 'N/C') || chr(10) || '🛣️ ' || coalesce(" + t("kilometrage")
            + " || ' km', 'N/C') || (CASE WHEN annee <> 0 THEN chr(10) || '📅 ' || annee ELSE '' END) || (CASE WHEN departement <> '' THEN chr(10) || '📍 ' || departement ELSE '' END)"
            " || chr(10) || '📊 Score: ' || score_total || '/100 (' || alert_level || ')' || (CASE WHEN margin_min <> 0 OR margin_max <> 0 THEN chr(10) || '💵 Marge: ' || " + t("margin_min") + " || ' - ' || " + t("margin_max")
            + " || ' €' ELSE '' END) || (CASE WHEN keywords_opportunite <> '' THEN chr(10) || '✅ ' || array_to_string(string_split(keywords_opportunite, ', ')[1:3], ', ') ELSE '' END)"
            " || (CASE WHEN keywords_risque <> '' THEN chr(10) || '⚠️ ' || array_to_string(string_split(keywords_risque, ', ')[1:3], ', ') ELSE '' END) || chr(10) || '🔗 ' || url")


def _summary_sql():
    parts = [f"CASE WHEN {col} <> 0 THEN {R.q(lab)} || {col} || 'pts' END" for lab, col in [
        ("Prix: ", "prix_score"), ("Km: ", "km_score"), ("Fraîcheur: ", "freshness_score"), ("Mots-clés: ", "keywords_score"), ("Bonus: +", "bonus_score"), ("Risques: ", "risk_penalty")]]
    s = R.joined(parts, " | ")
    return f"CASE WHEN {s} = '' THEN 'Non calculé' ELSE {s} END"


@query("B19_cards", f"WITH {R.SRC}, {R.scored()} SELECT arrival_seq, {_card_sql()} AS carte, {_summary_sql()} AS resume, substr(titre, 1, 50) AS titre_court FROM scored")
def _(spark, folder):
    df = scored(spark, folder).withColumn("ville", F.lit(""))
    return df.select(KEY, fm.notification_text(c).alias("carte"), fm.breakdown_summary(c).alias("resume"), F.substring("titre", 1, 50).alias("titre_court"))
