"""Index row -> listing, listing + detail, comparison inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carsift.functions.parse import parse_boite, parse_carburant, parse_departement, parse_seller_type, with_title_parts
from carsift.functions.text import blank_if_null
from carsift.operators.dedup import first_per_key

c = F.col


def index_to_listing(df: DataFrame, faithful: bool = False) -> DataFrame:
    """Brand, model and version from the source, else from the title; department from the place text; thumbnail as the
    only image. `faithful` drops the fuel of the index row (as the original flow does)."""
    t = with_title_parts(df, "titre", "_t_")
    incomplete = (blank_if_null("marque") == "") | (blank_if_null("modele") == "")

    def fill(name: str):
        return F.when(incomplete & (blank_if_null(name) == ""), c(f"_t_{name}")).otherwise(blank_if_null(name))

    out = t.withColumns({n: fill(n) for n in ("marque", "modele", "version")})
    dept = F.when(blank_if_null("departement") != "", c("departement")).otherwise(parse_departement(c("ville")))
    images = F.when(blank_if_null("thumbnail_url") != "", F.array("thumbnail_url")).otherwise(F.array().cast("array<string>"))
    fuel = F.lit("unknown") if faithful else F.when(blank_if_null("carburant") != "", c("carburant")).otherwise("unknown")
    return out.withColumns({"departement": dept, "images_urls": images, "carburant": fuel}).drop("_t_marque", "_t_modele", "_t_version")


def merge_detail(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Left join on url. Where a detail exists: description, seller name, phone and power are replaced; images, seller type,
    fuel, gearbox and engine only by non-empty values; the version only fills an empty one. One detail of an address is merged
    (of several, the same one in every run), so no listing comes out twice."""
    names = [n for n in details.columns if n != "url"]
    one = first_per_key(details.filter(c("url").isNotNull()), c("url"), [F.xxhash64(*names)])
    d = one.select(c("url"), F.struct(*names).alias("_d"))
    j = listings.join(d, "url", "left")
    has = c("_d").isNotNull()

    def always(name: str):
        return F.when(has, c(f"_d.{name}")).otherwise(c(name))

    def non_empty(name: str, value=None):
        raw = c(f"_d.{name}")
        return F.when(has & (blank_if_null(raw) != ""), raw if value is None else value).otherwise(c(name))

    return j.withColumns({
        "description": always("description"), "seller_name": always("seller_name"), "seller_phone": always("seller_phone"),
        "puissance_ch": always("puissance_ch"),
        "images_urls": F.when(has & (F.size("_d.images_urls") > 0), c("_d.images_urls")).otherwise(c("images_urls")),
        "seller_type": non_empty("seller_type", parse_seller_type(c("_d.seller_type"))),
        "carburant": non_empty("carburant", parse_carburant(c("_d.carburant"))),
        "boite": non_empty("boite", parse_boite(c("_d.boite"))),
        "motorisation": non_empty("motorisation"),
        "version": F.when(has & (blank_if_null("version") == "") & (blank_if_null("_d.version") != ""), c("_d.version")).otherwise(c("version")),
    }).drop("_d")


def compare_with_best(df: DataFrame, group: str, score: str, seq: str = "arrival_seq") -> DataFrame:
    """Every listing of a group of two or more against the best-scored one: price, mileage and score differences.

    The best row is a max over (score, earlier arrival), which aggregates before the shuffle; AQE splits hot groups of
    the join that brings it back."""
    best = df.groupBy(group).agg(
        F.max(F.struct(c(score).alias("s"), (-c(seq)).alias("o"), c("prix").alias("p"), c("kilometrage").alias("k"))).alias("_b"),
        F.count("*").alias("_n")).filter(c("_n") >= 2)
    zero = lambda x: F.coalesce(x, F.lit(0))
    return df.join(best, group).filter(c(seq) != -c("_b.o")).withColumns({
        "diff_prix": zero(c("prix")) - zero(c("_b.p")), "diff_km": zero(c("kilometrage")) - zero(c("_b.k")),
        "diff_score": c(score) - c("_b.s")}).drop("_b", "_n")
