"""Alert decision, update messages, channel routing and alert payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carsift.functions import formats as fm
from carsift.functions.text import null_if_blank
from carsift.sources.dictionaries import builtin


def alert_reason(score: Column, prix: Column, existing: Column, min_score: int | Column = 60) -> Column:
    """Reason text; `existing` is a struct(prix, score_total, notified), NULL for a listing not seen before."""
    limit = min_score if isinstance(min_score, Column) else F.lit(min_score)
    old_prix, old_score, notified = existing["prix"], existing["score_total"], existing["notified"]
    enough = score >= limit
    dropped = (old_prix != 0) & (prix != 0) & (prix < old_prix * F.lit(0.95))
    return (
        F.when(existing.isNull(), F.when(enough, "new").otherwise("score_too_low"))
        .when(notified, F.when(dropped, "price_dropped").when(score >= old_score + 10, "score_increased").otherwise("already_notified"))
        .otherwise(F.when(enough, "score_threshold").otherwise("score_too_low"))
    )


SENDING = ["new", "price_dropped", "score_increased", "score_threshold"]


def with_decision(df: DataFrame, existing: Column, min_score: int = 60) -> DataFrame:
    """Adds notify_reason and notify. A minimum score of 999 is a dry run."""
    return df.withColumn("notify_reason", alert_reason(F.col("score_total"), F.col("prix"), existing, min_score)).withColumn(
        "notify", F.col("notify_reason").isin(SENDING))


def update_message(prix: Column, score: Column, old_prix: Column, old_score: Column) -> Column:
    """Price fall and score rise against the previous state; NULL when neither happened."""
    diff = old_prix - prix
    pct = (diff / F.nullif(old_prix, F.lit(0)) * 100).cast("int")
    fell = F.when((old_prix != 0) & (prix != 0) & (prix < old_prix), F.concat(
        F.lit("📉 Prix -"), diff.cast("string"), F.lit("€ (-"), pct.cast("string"), F.lit("%)")))
    rose = F.when((old_score != 0) & (score > old_score), F.concat(F.lit("📈 Score +"), (score - old_score).cast("string"), F.lit("pts")))
    return null_if_blank(F.concat_ws(" | ", fell, rose))


def channels(level: Column) -> Column:
    out = None
    for lv, names in builtin("parsing")["alert_channels"].items():
        arr = F.array(*[F.lit(n) for n in names])
        out = F.when(level == lv, arr) if out is None else out.when(level == lv, arr)
    return out.otherwise(F.array().cast("array<string>"))


def route(df: DataFrame) -> DataFrame:
    """One row per listing and channel, with the channel priority."""
    urgent_push = (F.col("alert_level") == "urgent") & (F.col("channel") == "pushover")
    return df.withColumn("channel", F.explode(channels(F.col("alert_level")))).withColumn(
        "channel_priority", F.when(urgent_push, 1).otherwise(0))


def notification_log(df: DataFrame, key: str, sent_at: Column) -> DataFrame:
    """Audit rows of routed alerts."""
    return route(df).select(F.col(key).alias("annonce_id"), "channel", F.lit("sent").alias("status"), sent_at.alias("sent_at"),
                            F.lit(None).cast("string").alias("error_message"), sent_at.alias("created_at"))


def orphan_notifications(log: DataFrame, listings: DataFrame, key: str) -> DataFrame:
    """Audit rows without a listing (foreign-key check)."""
    return log.join(listings.select(F.col(key).alias("annonce_id")), "annonce_id", "left_anti")


def payload(df: DataFrame, updated: Column | None = None) -> DataFrame:
    """Alert table: title, description, colour and the display fields of a rich message."""
    c = F.col
    title = F.concat(fm.alert_emoji(c("alert_level")), F.lit(" "), c("marque"), F.lit(" "), c("modele"),
                     F.when(c("version") != "", F.concat(F.lit(" "), F.substring("version", 1, 25))).otherwise(""))
    if updated is not None:
        title = F.when(updated, F.concat(F.lit("🔄 "), title)).otherwise(title)

    def part(label: str, name: str) -> Column:
        return F.when(c(name) != 0, F.concat(F.lit(label), c(name).cast("string")))

    compact = F.concat_ws(" | ", part("Prix:", "prix_score"), part("Km:", "km_score"), part("Fresh:", "freshness_score"),
                          part("KW:", "keywords_score"), part("Risk:", "risk_penalty"))
    description = F.concat_ws(
        "\n",
        F.when(c("raison") != "", F.concat(F.lit("**🎯 "), c("raison"), F.lit("**"))),
        F.concat(F.lit("Score: **"), c("score_total").cast("string"), F.lit("/100** ("), c("alert_level"), F.lit(")")),
        F.when(compact != "", F.concat(F.lit("*("), compact, F.lit(")*"))),
    )
    margin = F.concat(fm.thousands(c("margin_min")), F.lit(" - "), fm.thousands(c("margin_max")), F.lit(" €"),
                      F.when(c("repair_cost_estimate") != 0, F.concat(F.lit("\n*(réparations: ~"), fm.thousands(c("repair_cost_estimate")), F.lit("€)*"))).otherwise(""))

    def field(name: str, value: Column, cond: Column | None = None) -> Column:
        s = F.struct(F.lit(name).alias("name"), value.alias("value"))
        return s if cond is None else F.when(cond, s)

    fields = F.array_compact(F.array(
        field("💰 Prix", fm.format_price_fr(c("prix"))),
        field("🛣️ Kilométrage", fm.format_km_fr(c("kilometrage"))),
        field("📅 Année", F.coalesce(F.when(c("annee") != 0, c("annee").cast("string")), F.lit("N/C"))),
        field("📍 Localisation", c("departement"), c("departement") != ""),
        field("⛽ Carburant", F.initcap("carburant"), c("carburant") != "unknown"),
        field("👤 Vendeur", F.initcap("seller_type"), c("seller_type") != "unknown"),
        field("💵 Marge potentielle", margin, (c("margin_min") != 0) | (c("margin_max") != 0)),
        field("✅ Opportunités", F.array_join(F.slice("keywords_opportunite", 1, 5), ", "), F.size("keywords_opportunite") > 0),
        field("⚠️ Risques", F.array_join(F.slice("keywords_risque", 1, 5), ", "), F.size("keywords_risque") > 0),
    ))
    return df.withColumns({
        "alert_title": F.substring(title, 1, 256), "alert_description": F.substring(description, 1, 4096),
        "alert_color": fm.alert_color(c("alert_level")), "alert_fields": fields,
        "alert_footer": F.concat(c("source"), F.lit(" • Score "), c("score_total").cast("string"), F.lit("/100")),
    })
