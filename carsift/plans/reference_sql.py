"""SQL building blocks of the oracles: plain SQL written from the rules, independent of the DataFrame code."""

from __future__ import annotations

import re
import unicodedata

from carsift.sources.dictionaries import builtin


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# one listing per lineitem, see sources/listings.py
SRC = """
b AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_shipdate, p_size, s_nationkey,
         CAST(p_size % 8 AS INT) AS v,
         CAST((l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 16 AS INT) AS t,
         CAST((l_orderkey + l_suppkey * 5) % 12 AS INT) AS w
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
), src0 AS (
SELECT
  (l_orderkey * 10 + l_linenumber) * 1048576 + (l_partkey * 1000003 + l_suppkey * 7919) % 1048576 AS arrival_seq,
  CASE l_suppkey % 4 WHEN 0 THEN 'autoscout24' WHEN 1 THEN 'lacentrale' WHEN 2 THEN 'paruvendu' ELSE 'leboncoin' END AS source,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20))) END AS source_listing_id,
  concat('https://WWW.Example.fr/annonce/', CAST(l_orderkey AS VARCHAR(20)), '/', CAST(l_partkey % 50 AS VARCHAR(20)),
    CASE l_partkey % 5 WHEN 0 THEN '?utm_source=feed&b=2' WHEN 1 THEN '/' WHEN 2 THEN '#photos' WHEN 3 THEN '?searchId=9&x=' ELSE '' END) AS url,
  CASE v WHEN 0 THEN 'Peugeot' WHEN 1 THEN 'Renault' WHEN 2 THEN 'Dacia' WHEN 3 THEN 'Renault' WHEN 4 THEN 'Ford' WHEN 5 THEN 'Toyota' WHEN 6 THEN 'BMW' ELSE '' END AS marque,
  CASE v WHEN 0 THEN '207' WHEN 1 THEN 'Clio' WHEN 2 THEN 'Sandero' WHEN 3 THEN 'Twingo' WHEN 4 THEN 'Fiesta' WHEN 5 THEN 'Yaris' WHEN 6 THEN 'Serie 3' ELSE '' END AS modele,
  CASE w % 6 WHEN 0 THEN '1.4 HDi 70ch' WHEN 1 THEN '1.5 dCi 75ch' WHEN 2 THEN '1.2 16v' WHEN 3 THEN '1.4 VTi' WHEN 4 THEN 'Stepway 1.5 dCi' ELSE 'Sport RS' END AS version,
  CASE w % 4 WHEN 0 THEN 'diesel' WHEN 1 THEN 'essence' WHEN 2 THEN 'unknown' ELSE 'diesel' END AS carburant,
  CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE CAST(600 + (l_partkey * 37 + l_orderkey * 11) % 4200 AS INT) END AS prix,
  CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE CAST(40000 + (l_partkey * 9973 + l_suppkey * 131) % 200000 AS INT) END AS kilometrage,
  CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE CAST(2003 + l_partkey % 15 AS INT) END AS annee,
  CASE s_nationkey % 10 WHEN 0 THEN '75' WHEN 1 THEN '92' WHEN 2 THEN '93' WHEN 3 THEN '77' WHEN 4 THEN '95' WHEN 5 THEN '60' WHEN 6 THEN '02' WHEN 7 THEN '69' WHEN 8 THEN '13' ELSE '' END AS departement,
  CASE l_returnflag WHEN 'A' THEN 'particulier' WHEN 'R' THEN 'professionnel' ELSE 'unknown' END AS seller_type,
  CAST(l_quantity AS INT) % 12 AS n_images,
  CASE t WHEN 0 THEN 'CT ok, prix négociable' WHEN 1 THEN 'Urgent, déménagement' WHEN 2 THEN 'vente urgente, première main'
         WHEN 3 THEN 'Moteur HS, pour pièces' WHEN 4 THEN 'CT refusé, contre-visite' WHEN 5 THEN 'ct à faire, en l''état'
         WHEN 6 THEN 'embrayage à faire, distribution à faire' WHEN 7 THEN 'Epave pour pièces' WHEN 8 THEN 'carnet d''entretien, factures, suivi'
         WHEN 9 THEN 'rouille, bas de caisse, prix à discuter' WHEN 10 THEN 'turbo-diesel très bon état' WHEN 11 THEN 'ne démarre plus, injecteurs'
         WHEN 12 THEN 'export ou marchand' WHEN 13 THEN '' WHEN 14 THEN 'boîte HS, accidenté, à débattre' ELSE 'faible kilométrage, toujours garé' END AS description,
  CAST(l_shipdate AS TIMESTAMP) AS published_at,
  CAST((l_orderkey * 13 + l_partkey) % 220 AS INT) AS age_hours,
  l_partkey % 2 = 0 AS has_detail
FROM b
), src AS (SELECT *, trim(marque || ' ' || modele || ' ' || version) AS titre FROM src0)
"""

EVENTS = """
fetches AS (
  SELECT event_id, ts, CASE user_id % 4 WHEN 0 THEN 'autoscout24' WHEN 1 THEN 'lacentrale' WHEN 2 THEN 'paruvendu' ELSE 'leboncoin' END AS source,
         CAST(CASE WHEN event_type = 'error' THEN 403 ELSE 200 END AS INT) AS status_code,
         CAST(trunc(value) AS INT) AS latency_ms, event_type = 'error' AS failed
  FROM events)
"""


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def norm(expr: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({expr})), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def ident(expr: str) -> str:
    """The accent fold used in fingerprints."""
    return (f"regexp_replace(translate(lower({expr}), 'éèêëàâäùûüôöîïç', 'eeeeaaauuuooiic'), '[^a-z0-9]', '', 'g')")


def thousands(expr: str) -> str:
    return f"replace(format('{{:,}}', {expr}), ',', ' ')"


def any_word(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def non_null(items: list[str]) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


def joined(items: list[str], sep: str = ", ") -> str:
    return f"coalesce(array_to_string({non_null(items)}, {q(sep)}), '')"


def whole_word(text: str, patterns: list[str]) -> str:
    """Patterns between word boundaries in normalised, blank-padded text."""
    return "(" + " OR ".join(f"contains({text}, {q(' ' + fold(p) + ' ')})" for p in patterns) + ")"


def vehicle_ord(brand="lower(trim(marque))", model="lower(trim(modele))", title="lower(titre)", vers="lower(version)", fuel="lower(carburant)") -> str:
    cfg = builtin("targets")
    out = "CASE WHEN marque = '' OR modele = '' THEN NULL"
    for i, v in enumerate(cfg["vehicles"]):
        m = q(v["marque"].lower())
        conds = [f"(contains({brand}, {m}) OR contains({m}, {brand}))"]
        conds.append("(" + " OR ".join(f"regexp_matches({f}, {q(p)})" for p in v["modele_patterns"] for f in (model, title, vers)) + ")")
        if v["carburant"]:
            hints = any_word(f"({title} || ' ' || {vers})", cfg["fuel_hints"][v["carburant"]])
            conds.append(f"(contains({fuel}, {q(v['carburant'])}) OR {fuel} = 'unknown' OR {hints})")
        conds.append(f"NOT {any_word(title, v['exclusions'])} AND NOT {any_word(vers, v['exclusions'])}")
        out += f" WHEN {' AND '.join(conds)} THEN {i}"
    return out + " END"


def dim_vehicle() -> str:
    rows = [
        f"({i}, {q(v['id'])}, {v['prix'][0]}, {v['prix'][1]}, {v['km'][0]}, {v['km'][1]}, {v['km_ideal'][0]}, {v['km_ideal'][1]}, "
        f"{v['revente'][0]}, {v['revente'][1]}, {v['marche_median']})"
        for i, v in enumerate(builtin("targets")["vehicles"])
    ]
    return ("dim_vehicle(vo, vid, pmin, pmax, kmin, kmax, imin, imax, rmin, rmax, med) AS (VALUES " + ", ".join(rows) + ")")


def tr(expr: str) -> str:
    return f"CAST(trunc({expr}) AS INT)"


def keyword_flags(profile: str) -> tuple[list[tuple[dict, str]], list[tuple[dict, str]]]:
    kw = builtin("keywords")
    if profile == "v3":
        opp = [(e, whole_word("pad", e["patterns"])) for e in kw["opportunity"]]
        for e in kw["opportunity_regex"]:
            opp.append((e, "(" + " OR ".join(f"regexp_matches(pad, {q(p)})" for p in e["patterns"]) + ")"))
        risk = [(e, whole_word("pad", e["patterns"])) for e in kw["risk"]]
    else:
        opp = [(e, any_word("low", [p.lower() for p in e["patterns"]])) for e in kw["opportunity"]]
        risk = [(e, any_word("low", [p.lower() for p in e["patterns"]])) for e in kw["risk"]]
    return opp, risk


def scored(profile: str = "v3", source: str = "src", hours: str = "CAST(age_hours AS DOUBLE)") -> str:
    """CTEs k1..k4 and `scored`: the full scoring rule over `source`."""
    kw, cfg = builtin("keywords"), builtin("targets")
    w, v3 = cfg["weights"], profile == "v3"
    opp, risk = keyword_flags(profile)
    if v3:
        excl = "CASE " + " ".join(f"WHEN {whole_word('pad', [p])} THEN {q('Exclusion: ' + fold(p))}" for p in kw["exclusions"]) + " END"
    else:
        excl = ("CASE " + " ".join(f"WHEN contains(low || ' ' || lower(version), {q(p.lower())}) THEN {q('Mot-clé exclu: ' + p)}"
                                   for p in kw["exclusions"]) + " END")
    k1 = (f"k1 AS (SELECT *, {vehicle_ord()} AS vo, ' ' || {norm(chr(39).join(['titre || ', ' ', ' || description || ', ' ', ' || version']))} || ' ' AS pad, "
          f"lower(titre || ' ' || description) AS low, {hours} AS hrs FROM {source})")
    flags = [f"{c} AS o{i}" for i, (_, c) in enumerate(opp)] + [f"{c} AS r{i}" for i, (_, c) in enumerate(risk)]
    k2 = f"k2 AS (SELECT k1.*, d.* EXCLUDE (vo), {', '.join(flags)}, {excl} AS excl FROM k1 LEFT JOIN dim_vehicle d ON k1.vo = d.vo)"

    def add(pairs, prefix, field):
        return " + ".join(f"(CASE WHEN {prefix}{i} THEN {e[field]} ELSE 0 END)" for i, (e, _) in enumerate(pairs))

    def ids(pairs, prefix):
        return joined([f"CASE WHEN {prefix}{i} THEN {q(e['id'])} END" for i, (e, _) in enumerate(pairs)])

    rank = kw["severity_rank"]
    by_rank = sorted(range(len(risk)), key=lambda i: -rank.get(risk[i][0]["severity"], 0))
    severity = "CASE " + " ".join(f"WHEN r{i} THEN {q(risk[i][0]['severity'])}" for i in by_rank) + " ELSE 'none' END"
    k3 = (f"k3 AS (SELECT *, {add(opp, 'o', 'bonus')} AS kb, {add(risk, 'r', 'penalty')} AS kp, {add(risk, 'r', 'cost')} AS kc, "
          f"{ids(opp, 'o')} AS oids, {ids(risk, 'r')} AS rids, {severity} AS sev, (1 - prix / CAST(med AS DOUBLE)) * 100 AS disc FROM k2)")

    tiers, W = cfg["department_tiers"], w["prix"]
    inl = lambda t: "(" + ", ".join(q(d) for d in tiers[t]) + ")"
    base = tr(f"{W} * ((pmax - prix) / CAST(pmax - pmin AS DOUBLE))")
    fresh_bands = ([(1, 1.0), (3, .95), (6, .85), (12, .7), (24, .5), (48, .3), (168, .15)] if v3 else [(1, 1.0), (6, .9), (24, .7), (48, .5), (168, .3)])
    fresh = (f"CASE WHEN hrs IS NULL THEN {int(w['freshness'] * .5)} " + " ".join(f"WHEN hrs < {h} THEN {int(w['freshness'] * s)}" for h, s in fresh_bands) + " ELSE 0 END")
    K = w["km"]
    km = (f"CASE WHEN kilometrage IS NULL THEN {int(K * .3)} WHEN kilometrage < kmin THEN {int(K * (.5 if v3 else .4))} WHEN kilometrage > kmax THEN 0 "
          f"WHEN kilometrage BETWEEN imin AND imax THEN {K} "
          f"WHEN kilometrage < imin THEN {tr(f'{K} * (0.7e0 + 0.3e0 * (CASE WHEN imin > kmin THEN (kilometrage - kmin) / CAST(imin - kmin AS DOUBLE) ELSE 1 END))')} "
          f"ELSE {tr(f'{K} * (CASE WHEN kmax > imax THEN (kmax - kilometrage) / CAST(kmax - imax AS DOUBLE) ELSE 0 END) * 0.7e0')} END")
    step = "(vo = 2 AND contains(lower(titre || ' ' || version), 'stepway'))"
    if v3:
        legit = "(n_images > 0 AND seller_type = 'particulier' AND rids = '')"
        cheap = "prix < med * 0.85e0"
        ps = (f"CASE WHEN prix IS NULL OR prix > pmax THEN 0 WHEN prix < pmin THEN (CASE WHEN {legit} THEN {W} ELSE {int(W * .9)} END) "
              f"WHEN {cheap} THEN least({W}, {base} + {int(W * .15)}) ELSE {base} END")
        pd = (f"CASE WHEN prix IS NULL THEN 'Prix non renseigné' WHEN prix > pmax THEN 'Prix trop élevé (' || prix || '€ > ' || pmax || '€ max)' "
              f"WHEN prix < pmin AND {legit} THEN '🔥 ' || prix || '€ (-' || {tr('disc')} || '% marché) - Très bonne affaire!' "
              f"WHEN prix < pmin THEN '⚠️ ' || prix || '€ (-' || {tr('disc')} || '% marché) - À VÉRIFIER (prix anormal)' "
              f"WHEN {cheap} THEN prix || '€ (-' || {tr('disc')} || '% vs marché ' || med || '€)' ELSE prix || '€ (fourchette ' || pmin || '-' || pmax || '€)' END")
        nv = f"coalesce(prix < pmin AND NOT {legit}, false)"
        bonus = (f"(CASE WHEN departement IN {inl(1)} THEN 5 WHEN departement IN {inl(2)} THEN 3 WHEN departement IN {inl(3)} THEN 1 ELSE 0 END) + "
                 f"(CASE seller_type WHEN 'particulier' THEN 3 WHEN 'professionnel' THEN -1 ELSE 0 END) + (CASE WHEN n_images >= 5 THEN 1 ELSE 0 END) + (CASE WHEN {step} THEN 2 ELSE 0 END)")
        bd = joined([f"CASE WHEN departement IN {inl(1)} THEN '📍 ' || departement || ' (proche)' WHEN departement IN {inl(2)} THEN '📍 ' || departement WHEN departement IN {inl(3)} THEN departement END",
                     "CASE seller_type WHEN 'particulier' THEN 'Particulier' WHEN 'professionnel' THEN 'Pro' END",
                     "CASE WHEN n_images >= 5 THEN n_images || ' photos' END", f"CASE WHEN {step} THEN 'stepway' END"])
        fd = ("CASE WHEN hrs IS NULL THEN 'Date inconnue' WHEN hrs < 1 THEN '< 1h 🔥' WHEN hrs < 24 THEN CAST(trunc(hrs) AS INT) || 'h' WHEN hrs < 48 THEN '1-2j' "
              "WHEN hrs < 168 THEN CAST(trunc(hrs / 24) AS INT) || 'j' ELSE '> 1 sem' END")
        T = thousands
        kd = (f"CASE WHEN kilometrage IS NULL THEN 'Km non renseigné' WHEN kilometrage < kmin THEN {T('kilometrage')} || ' km < ' || {T('kmin')} || ' km - bas (vérifier)' "
              f"WHEN kilometrage > kmax THEN {T('kilometrage')} || ' km > ' || {T('kmax')} || ' km max' WHEN kilometrage BETWEEN imin AND imax THEN {T('kilometrage')} || ' km (idéal)' "
              f"WHEN kilometrage < imin THEN {T('kilometrage')} || ' km' ELSE {T('kilometrage')} || ' km (élevé)' END")
        rd = ("CASE WHEN rids = '' THEN 'Aucun risque détecté' WHEN sev = 'critical' THEN '⚠️ CRITIQUE: ' || rids || ' (~' || kc || '€)' ELSE rids || ' (~' || kc || '€)' END")
        buffer = cfg["margin_buffer"]
    else:
        cheap = "prix < med * 0.8e0"
        ps = (f"CASE WHEN prix IS NULL OR prix > pmax THEN 0 WHEN prix < pmin THEN {int(W * .3)} "
              f"WHEN {cheap} THEN least({W}, {base} + {int(W * .2)}) ELSE {base} END")
        pd = (f"CASE WHEN prix IS NULL THEN 'Prix non renseigné' WHEN prix < pmin THEN 'Prix très bas (' || prix || '€ < ' || pmin || '€ min) - suspect' "
              f"WHEN prix > pmax THEN 'Prix trop élevé (' || prix || '€ > ' || pmax || '€ max)' "
              f"WHEN {cheap} THEN prix || '€ (-' || {tr('disc')} || '% vs marché ' || med || '€)' ELSE prix || '€ (fourchette ' || pmin || '-' || pmax || '€)' END")
        nv = "false"
        bonus = (f"(CASE WHEN departement IN {inl(1)} THEN 3 WHEN departement IN {inl(2)} THEN 2 WHEN departement IN {inl(3)} THEN 1 ELSE 0 END) + "
                 f"(CASE seller_type WHEN 'particulier' THEN 2 WHEN 'professionnel' THEN -1 ELSE 0 END) + (CASE WHEN {step} THEN 2 ELSE 0 END)")
        bd = joined([f"CASE WHEN departement IN {inl(1)} THEN 'Dept ' || departement || ' (T1)' WHEN departement IN {inl(2)} THEN 'Dept ' || departement || ' (T2)' WHEN departement IN {inl(3)} THEN 'Dept ' || departement || ' (T3)' END",
                     "CASE seller_type WHEN 'particulier' THEN 'Particulier' WHEN 'professionnel' THEN 'Pro (-1)' END", f"CASE WHEN {step} THEN 'stepway' END"])
        fd = ("CASE WHEN hrs IS NULL THEN 'Date publication inconnue' WHEN hrs < 1 THEN '< 1h (très frais)' WHEN hrs < 24 THEN CAST(trunc(hrs) AS INT) || 'h' WHEN hrs < 48 THEN '1-2 jours' "
              "WHEN hrs < 168 THEN CAST(trunc(hrs / 24) AS INT) || ' jours' ELSE '> 1 semaine (' || CAST(trunc(hrs / 24) AS INT) || ' jours)' END")
        T = thousands
        kd = (f"CASE WHEN kilometrage IS NULL THEN 'Km non renseigné' WHEN kilometrage < kmin THEN {T('kilometrage')} || ' km < ' || {T('kmin')} || ' km min - suspect' "
              f"WHEN kilometrage > kmax THEN {T('kilometrage')} || ' km > ' || {T('kmax')} || ' km max' WHEN kilometrage BETWEEN imin AND imax THEN {T('kilometrage')} || ' km (idéal ' || {T('imin')} || '-' || {T('imax')} || ')' "
              f"WHEN kilometrage < imin THEN {T('kilometrage')} || ' km (sous idéal)' ELSE {T('kilometrage')} || ' km (au-dessus idéal)' END")
        rd = ("CASE WHEN rids = '' THEN 'Aucun risque détecté' ELSE "
              + joined([f"CASE WHEN r{i} THEN {q(e['id'] + ' (' + str(e['penalty']) + 'pts, ~' + str(e['cost']) + '€)')} END" for i, (e, _) in enumerate(risk)]) + " END")
        buffer = 0
    mm = lambda r: f"CASE WHEN prix IS NULL THEN 0 ELSE greatest(0, {r} - prix - kc - {buffer}) END"
    k4 = (f"k4 AS (SELECT *, vo IS NOT NULL AND excl IS NULL AS ok, {ps} AS p_s, {pd} AS p_d, {nv} AS nv, {km} AS k_s, {kd} AS k_d, {fresh} AS f_s, {fd} AS f_d, "
          f"least({w['keywords']}, kb) AS w_s, greatest(0, least({w['bonus']}, {bonus})) AS b_s, {bd} AS b_d, {rd} AS r_d, {mm('rmin')} AS mmin, {mm('rmax')} AS mmax FROM k3)")
    mb = "(CASE WHEN mmin >= 1500 THEN 5 WHEN mmin >= 1000 THEN 3 WHEN mmin >= 500 THEN 2 ELSE 0 END)" if v3 else "0"
    k5 = f"k5 AS (SELECT *, greatest(0, least(100, p_s + k_s + f_s + w_s + b_s + kp + {mb})) AS tot0 FROM k4)"
    tot = "CASE WHEN sev = 'critical' AND tot0 >= 60 AND mmin < 1000 THEN 59 ELSE tot0 END" if v3 else "tot0"
    z = lambda e, d="0": f"CASE WHEN ok THEN {e} ELSE {d} END"
    fin = f"""scored0 AS (SELECT k5.*, coalesce(vid, '') AS vehicule_cible_id, {z('p_s')} AS prix_score,
      CASE WHEN vo IS NULL THEN 'Véhicule non ciblé' WHEN ok THEN p_d ELSE '' END AS prix_detail, {z('k_s')} AS km_score, {z('k_d', "''")} AS km_detail,
      {z('f_s')} AS freshness_score, {z('f_d', "''")} AS freshness_detail, {z('w_s')} AS keywords_score,
      {z("CASE WHEN oids = '' THEN 'Aucun' ELSE oids END", "''")} AS keywords_detail, {z('b_s')} AS bonus_score,
      {z("CASE WHEN b_d = '' THEN 'Aucun' ELSE b_d END", "''")} AS bonus_detail, {z('kp')} AS risk_penalty,
      CASE WHEN vo IS NOT NULL AND excl IS NOT NULL THEN 'EXCLU: ' || excl WHEN ok THEN r_d ELSE '' END AS risk_detail,
      {z(tot)} AS total, {z('mmin')} AS margin_min, {z('mmax')} AS margin_max, {z('CASE WHEN prix IS NULL THEN 0 ELSE kc END')} AS repair_cost_estimate,
      {z('oids', "''")} AS keywords_opportunite,
      {z("CASE WHEN nv THEN (CASE WHEN rids = '' THEN 'prix_a_verifier' ELSE rids || ', prix_a_verifier' END) ELSE rids END", "''")} AS keywords_risque,
      CASE WHEN vo IS NOT NULL AND excl IS NOT NULL THEN 'exclue' ELSE 'nouveau' END AS status,
      CASE WHEN vo IS NOT NULL AND excl IS NOT NULL THEN excl ELSE '' END AS ignore_reason FROM k5),
    scored AS (SELECT *, CASE WHEN total >= 80 THEN 'urgent' WHEN total >= 60 THEN 'interessant' WHEN total >= 40 THEN 'surveiller' ELSE 'archive' END AS alert_level,
      total AS score_total FROM scored0)"""
    return ", ".join([dim_vehicle(), k1, k2, k3, k4, k5, fin])


def canonical_url(url: str) -> str:
    """Canonical URL for URLs without percent escapes: tracking keys, blank values, fragment and trailing '/' removed."""
    keys = ", ".join(q(k) for k in builtin("parsing")["tracking_params"])
    nofrag = f"split_part({url}, '#', 1)"
    head, query = f"split_part({nofrag}, '?', 1)", f"split_part({nofrag}, '?', 2)"
    kept = (f"array_to_string(list_filter(string_split({query}, '&'), lambda p: split_part(p, '=', 2) <> '' AND lower(split_part(p, '=', 1)) NOT IN ({keys})), '&')")
    host = f"lower(regexp_extract({head}, '^[A-Za-z]+://[^/]*'))"
    path = f"rtrim(regexp_replace({head}, '^[A-Za-z]+://[^/]*', ''), '/')"
    return f"({host} || {path} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END)"
