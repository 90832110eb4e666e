"""Statistics, market prices, run metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carsift.functions.formats import alert_level, km_bucket, year_bucket
from carsift.sources.dictionaries import builtin

c = F.col


def global_stats(df: DataFrame) -> DataFrame:
    """Counts and averages without ignored and excluded listings (a NULL status drops out too)."""
    return df.filter(~c("status").isin("ignore", "exclue")).agg(
        F.count("*").alias("total_annonces"), F.count_if(c("status") == "nouveau").alias("nouveaux"),
        F.count_if(c("alert_level") == "urgent").alias("urgents"), F.count_if(c("alert_level") == "interessant").alias("interessants"),
        F.count_if(c("notified")).alias("notifiees"), F.avg("score_total").alias("score_moyen"), F.avg("prix").alias("prix_moyen"),
        F.avg("kilometrage").alias("km_moyen"))


def stats_by_source(df: DataFrame, today: Column) -> DataFrame:
    return df.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(F.to_date("created_at") == today).alias("aujourdhui"),
        F.avg("score_total").alias("score_moyen"), F.max("score_total").alias("score_max"))


def classic_stats(df: DataFrame) -> DataFrame:
    """Long form (kind, label, n) with zero rows for absent groups: total, four sources, five statuses, four score bands."""
    fixed = [("total", "total")] + [("source", s) for s in builtin("parsing")["enums"]["source"]]
    fixed += [("statut", s) for s in ("nouveau", "contacté", "acheté", "expiré", "ignoré")]
    fixed += [("score", s) for s in builtin("parsing")["enums"]["alert_level"]]
    # one pass: pre-aggregated by the three grouping columns, then unfolded to the long form
    base = df.groupBy("source", "status", alert_level(c("score_total")).alias("band")).count()
    long = base.select(F.explode(F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("total").alias("label"), "count"),
        F.struct(F.lit("source").alias("kind"), c("source").alias("label"), "count"),
        F.struct(F.lit("statut").alias("kind"), c("status").alias("label"), "count"),
        F.struct(F.lit("score").alias("kind"), c("band").alias("label"), "count"))).alias("x")).select("x.*")
    counts = long.groupBy("kind", "label").agg(F.sum("count").alias("n"))
    dim = df.sparkSession.createDataFrame(fixed, "kind string, label string")
    return dim.join(counts, ["kind", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def market_prices(df: DataFrame, year_width: int = 3, km_width: int = 50000) -> DataFrame:
    """Price statistics per target vehicle, year range and mileage range: per department and national (NULL department)."""
    priced = df.filter((c("vehicule_cible_id") != "") & c("prix").isNotNull() & c("annee").isNotNull() & c("kilometrage").isNotNull()).select(
        "vehicule_cible_id", year_bucket(c("annee"), year_width).alias("annee_bucket"), km_bucket(c("kilometrage"), km_width).alias("km_bucket"),
        "departement", "prix")
    # exact medians from a price histogram: counts per distinct price are small and merge map-side, whatever the group size
    hist = priced.groupBy("vehicule_cible_id", "annee_bucket", "km_bucket", "departement", "prix").agg(F.count("*").alias("n"))
    sets = hist.groupingSets(
        [["vehicule_cible_id", "annee_bucket", "km_bucket", "departement"], ["vehicule_cible_id", "annee_bucket", "km_bucket"]],
        "vehicule_cible_id", "annee_bucket", "km_bucket", "departement").agg(
            F.sum("n").alias("count"), F.min("prix").alias("prix_min"), F.max("prix").alias("prix_max"),
            F.percentile("prix", 0.5, c("n")).alias("prix_median"), (F.sum(c("prix") * c("n")) / F.sum("n")).alias("prix_moyenne"))
    return sets.withColumnRenamed("departement", "departement_bucket")


def pipeline_stats(index_counts: DataFrame, detailed: DataFrame) -> DataFrame:
    """One row of run counters from the index counts (scanned, fresh) and the detailed, scored, decided listings."""
    d = detailed.agg(F.count("*").alias("detail_fetched"), F.count_if(c("alert_level") == "urgent").alias("urgent_count"),
                     F.count_if(c("alert_level") == "interessant").alias("interessant_count"), F.count_if("notify").alias("notified"))
    return index_counts.join(d).withColumn("index_duplicates", c("index_scanned") - c("index_new"))


def fetch_stats(log: DataFrame) -> DataFrame:
    """Requests, successes, blocks and whole-number average latency per source."""
    return log.groupBy("source").agg(
        F.count("*").alias("requests"), F.count_if(c("status_code") == 200).alias("success"),
        F.count_if(c("status_code").isin(403, 429, 503)).alias("blocked"), F.floor(F.avg("latency_ms")).alias("avg_latency_ms"))


def run_report(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(F.size("mots_cles_detectes") > 0).alias("avec_mots_cles"),
                  F.count_if(c("score_rentabilite") >= 50).alias("score_50"), F.count_if(c("score_rentabilite") >= 30).alias("score_30"))


def digest(df: DataFrame, order: list[Column], lines: int = 10) -> DataFrame:
    """Text digest: the first lines in order, then how many more there are. The counting is one partial aggregation and
    the lines come from a top-k, so nothing else reaches the last task."""
    line = F.concat("emoji", F.lit(" "), "marque", F.lit(" "), "modele", F.lit(" - "), F.coalesce(c("prix").cast("string"), F.lit("None")),
                    F.lit("€ - Score: "), c("score").cast("string"))
    top = df.orderBy(*order).limit(lines).select(
        F.row_number().over(W.orderBy(*order)).alias("i"), line.alias("line"))
    text = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("body"))
    n = df.agg(F.count("*").alias("n"))
    more = F.when(c("n") > lines, F.concat(F.lit("\n\n... et "), (c("n") - lines).cast("string"), F.lit(" autres"))).otherwise("")
    return n.join(text).select(F.concat(F.lit("📊 RÉCAPITULATIF - "), c("n").cast("string"), F.lit(" annonces\n\n"), "body", more).alias("message"))
