"""Display formats: thousands with spaces, age text, alert labels, notification texts, buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carsift.functions.text import title_case
from carsift.sources.dictionaries import builtin


def thousands(num: Column) -> Column:
    return F.translate(F.format_number(num, 0), ",", " ")


def format_price_fr(prix: Column) -> Column:
    return F.when(prix.isNull(), "N/C").otherwise(F.concat(thousands(prix), F.lit(" €")))


def format_km_fr(km: Column) -> Column:
    return F.when(km.isNull(), "N/C").otherwise(F.concat(thousands(km), F.lit(" km")))


def age_seconds(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(1e6)


def time_ago(ts: Column, as_of: Column) -> Column:
    s = age_seconds(ts, as_of)

    def whole(seconds: int) -> Column:
        return (s / seconds).cast("int").cast("string")

    return (
        F.when(ts.isNull(), "N/C")
        .when(s < 60, "à l'instant")
        .when(s < 3600, F.concat(F.lit("il y a "), whole(60), F.lit(" min")))
        .when(s < 86400, F.concat(F.lit("il y a "), whole(3600), F.lit("h")))
        .when(s < 7 * 86400, F.concat(F.lit("il y a "), whole(86400), F.lit("j")))
        .otherwise(F.date_format(ts, "dd/MM/yyyy"))
    )


def age_minutes(ts: Column, as_of: Column) -> Column:
    return F.coalesce((age_seconds(ts, as_of) / 60).cast("int"), F.lit(999999))


def alert_level(score: Column) -> Column:
    return F.when(score >= 80, "urgent").when(score >= 60, "interessant").when(score >= 40, "surveiller").otherwise("archive")


def _lookup(key: Column, table: dict[str, str | int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def alert_emoji(level: Column) -> Column:
    return F.coalesce(_lookup(level, builtin("parsing")["level_emoji"]), F.lit("⚪"))


def alert_color(level: Column, classic: bool = False) -> Column:
    # fixed values: embed colours of the current and the older alert format
    current = {"urgent": 0xFF0000, "interessant": 0xFF8C00, "surveiller": 0xFFD700, "archive": 0x808080}
    older = {"urgent": 0xFF0000, "interessant": 0xFFA500, "surveiller": 0xFFFF00, "archive": 0x808080}
    return F.coalesce(_lookup(level, older if classic else current), F.lit(0x808080))


def keyword_label(keyword_id: Column) -> Column:
    spelled = title_case(F.translate(keyword_id, "_", " "))
    return F.coalesce(_lookup(keyword_id, builtin("parsing")["keyword_labels"]), spelled)


def reason_line(prix_detail: Column, opportunities: Column, departement: Column, seller_type: Column, risks: Column) -> Column:
    """One-line reason: discount, up to three opportunities, department, private seller, known ones of the first two risks."""
    pct = F.regexp_extract(prix_detail, r"-?([0-9]+)%", 1)
    lowered = F.lower(prix_detail)
    price = F.when(F.contains(prix_detail, F.lit("%")), F.when(pct != "", F.concat(F.lit("-"), pct, F.lit("% marché")))).when(
        F.contains(lowered, F.lit("très bas")) | F.contains(lowered, F.lit("bonne affaire")), "🔥 Prix bas")
    parts = F.concat(
        F.array(price),
        F.transform(F.slice(opportunities, 1, 3), keyword_label),
        F.array(F.when(departement != "", departement), F.when(seller_type == "particulier", "Particulier")),
        F.transform(F.slice(risks, 1, 2), lambda r: _lookup(r, builtin("parsing")["risk_labels"])),
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), " + ")


def place(ville: Column, departement: Column) -> Column:
    v, d = F.coalesce(ville, F.lit("")), F.coalesce(departement, F.lit(""))
    return F.when((v != "") & (d != ""), F.concat(v, F.lit(" ("), d, F.lit(")"))).otherwise(F.concat(v, d))


def notification_text(c) -> Column:
    """Multi-line card; lines without data are left out. `c(name)` gives the listing column."""
    loc = place(c("ville"), c("departement"))
    return F.concat_ws(
        "\n",
        F.btrim(F.concat(F.lit("🚗 "), c("marque"), F.lit(" "), c("modele"), F.lit(" "), c("version"))),
        F.concat(F.lit("💰 "), format_price_fr(c("prix"))),
        F.concat(F.lit("🛣️ "), format_km_fr(c("kilometrage"))),
        F.when(c("annee") != 0, F.concat(F.lit("📅 "), c("annee").cast("string"))),
        F.when(loc != "", F.concat(F.lit("📍 "), loc)),
        F.concat(F.lit("📊 Score: "), c("score_total").cast("string"), F.lit("/100 ("), c("alert_level"), F.lit(")")),
        F.when((c("margin_min") != 0) | (c("margin_max") != 0), F.concat(
            F.lit("💵 Marge: "), thousands(c("margin_min")), F.lit(" - "), thousands(c("margin_max")), F.lit(" €"))),
        F.when(F.size(c("keywords_opportunite")) > 0, F.concat(F.lit("✅ "), F.array_join(F.slice(c("keywords_opportunite"), 1, 3), ", "))),
        F.when(F.size(c("keywords_risque")) > 0, F.concat(F.lit("⚠️ "), F.array_join(F.slice(c("keywords_risque"), 1, 3), ", "))),
        F.concat(F.lit("🔗 "), c("url")),
    )


def breakdown_summary(c) -> Column:
    def part(label: str, col: str, unit: str = "pts") -> Column:
        return F.when(c(col) != 0, F.concat(F.lit(label), c(col).cast("string"), F.lit(unit)))

    text = F.concat_ws(" | ", part("Prix: ", "prix_score"), part("Km: ", "km_score"), part("Fraîcheur: ", "freshness_score"),
                       part("Mots-clés: ", "keywords_score"), part("Bonus: +", "bonus_score"), part("Risques: ", "risk_penalty"))
    return F.when(text == "", "Non calculé").otherwise(text)


def _range_label(num: Column, width: int, inclusive: bool) -> Column:
    low = (F.floor(num / width) * width).cast("int")
    return F.concat_ws("-", low.cast("string"), (low + (width - 1 if inclusive else width)).cast("string"))


def year_bucket(annee: Column, width: int = 3) -> Column:
    """Inclusive range such as 2010-2012."""
    return F.when(annee.isNotNull(), _range_label(annee, width, True))


def km_bucket(km: Column, width: int = 50000) -> Column:
    """Range such as 100000-150000."""
    return F.when(km.isNotNull(), _range_label(km, width, False))
