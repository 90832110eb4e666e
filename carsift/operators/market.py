"""Market prices kept up to date: a log of price counts that batches add to and retract from.

Counts per bucket and distinct price merge by addition, so a batch writes only its own difference: plus one for the price a
listing has now, minus one for the price it had. Statistics, exact medians included, are read from the summed counts; a compaction
writes these sums as the first folder of a new log. A replayed batch rewrites its own folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carsift.functions.formats import km_bucket, year_bucket

c = F.col
BUCKETS = ["vehicule_cible_id", "annee_bucket", "km_bucket", "departement"]
SCHEMA = "vehicule_cible_id string, annee_bucket string, km_bucket string, departement string, prix int, n long"


def price_counts(df: DataFrame, year_width: int = 3, km_width: int = 50000) -> DataFrame:
    """Listings -> counts per bucket and price; listings without vehicle, price, year or mileage have none."""
    known = (c("vehicule_cible_id") != "") & c("prix").isNotNull() & c("annee").isNotNull() & c("kilometrage").isNotNull()
    rows = df.filter(known).select("vehicule_cible_id", year_bucket(c("annee"), year_width).alias("annee_bucket"), km_bucket(c("kilometrage"), km_width).alias("km_bucket"),
                                   "departement", c("prix").cast("int").alias("prix"))
    return rows.groupBy(*BUCKETS, "prix").agg(F.count("*").alias("n"))


def price_stats(counts: DataFrame) -> DataFrame:
    """Statistics per bucket and department, and nationwide (NULL department), of counts that may come in parts."""
    whole = counts.groupBy(*BUCKETS, "prix").agg(F.sum("n").alias("n")).filter("n > 0")
    sets = whole.groupingSets([BUCKETS, BUCKETS[:3]], *BUCKETS).agg(
        F.sum("n").alias("count"), F.min("prix").alias("prix_min"), F.max("prix").alias("prix_max"), F.percentile("prix", 0.5, c("n")).alias("prix_median"),
        (F.sum(c("prix") * c("n")) / F.sum("n")).alias("prix_moyenne"))
    return sets.withColumnRenamed("departement", "departement_bucket")


class PriceLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def apply(self, now: DataFrame | None, before: DataFrame | None, batch: int) -> None:
        """`now`: the batch's listings; `before`: the versions they replace, or listings that went away."""
        parts = [] if now is None else [price_counts(now)]
        if before is not None:
            parts.append(price_counts(before).withColumn("n", -c("n")))
        if not parts:
            return
        delta = reduce(DataFrame.unionByName, parts)
        delta.groupBy(*BUCKETS, "prix").agg(F.sum("n").alias("n")).filter("n <> 0").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def counts(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/batch=*")

    def prices(self) -> DataFrame:
        return price_stats(self.counts())

    def compact(self, path: str, upto: int) -> PriceLog:
        """A new log that begins with the sums, under the number of the last batch they hold."""
        sums = self.counts().groupBy(*BUCKETS, "prix").agg(F.sum("n").alias("n")).filter("n <> 0")
        sums.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={upto}")
        return PriceLog(self.spark, path)
