"""Target-vehicle identification, unrolled from the dictionary into one CASE per row: no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carsift.functions.text import blank_if_null, contains_any, strip_spaces
from carsift.operators.settle import settle
from carsift.sources.dictionaries import builtin


def target_ord(brand: Column, model: Column, title: Column, vers: Column, fuel: Column, targets: dict | None = None) -> Column:
    """Position of the first dictionary vehicle that fits, NULL if none. Inputs are lower-cased."""
    cfg = targets or builtin("targets")
    both = F.concat_ws(" ", title, vers)
    out = None
    for i, v in enumerate(cfg["vehicles"]):
        want = v["marque"].lower()
        fits = F.contains(brand, F.lit(want)) | F.contains(F.lit(want), brand)
        regex = "(?i)" + "|".join(f"(?:{p})" for p in v["modele_patterns"])
        fits = fits & (model.rlike(regex) | title.rlike(regex) | vers.rlike(regex))
        if v["carburant"]:
            fits = fits & (F.contains(fuel, F.lit(v["carburant"])) | (fuel == "unknown")
                           | contains_any(both, cfg["fuel_hints"][v["carburant"]]))
        if v["exclusions"]:
            words = [e.lower() for e in v["exclusions"]]
            fits = fits & ~contains_any(title, words) & ~contains_any(vers, words)
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return out


def vehicle_value(ord_col: Column, getter, targets: dict | None = None) -> Column:
    """Dictionary value of the matched vehicle: an array literal indexed by its position."""
    values = [getter(v) for v in (targets or builtin("targets"))["vehicles"]]
    return F.get(F.array(*[F.lit(x) for x in values]), ord_col)


def with_target(df: DataFrame, targets: dict | None = None) -> DataFrame:
    """Adds veh_ord and vehicule_cible_id ('' when no vehicle fits)."""
    return settle(unsettled_target(df, targets), ["veh_ord", "vehicule_cible_id"])  # later filters on the vehicle must not repeat the CASE


def unsettled_target(df: DataFrame, targets: dict | None = None) -> DataFrame:
    """The same for a caller that settles them with columns of its own. The lower-cased inputs are a projection of their own,
    so the CASE over the vehicles does not repeat them."""
    c = F.col
    lowered = {
        "id_brand": strip_spaces(F.lower("marque")), "id_model": strip_spaces(F.lower("modele")),
        "id_title": F.lower(blank_if_null("titre")), "id_version": F.lower(blank_if_null("version")),
        "id_fuel": F.lower(F.coalesce("carburant", F.lit("unknown"))),
    }
    found = target_ord(*[c(n) for n in lowered], targets)
    known = (blank_if_null("marque") != "") & (blank_if_null("modele") != "")
    return df.withColumns(lowered).withColumn("veh_ord", F.when(known, found)).withColumn(
        "vehicule_cible_id", F.coalesce(vehicle_value(c("veh_ord"), lambda v: v["id"], targets), F.lit(""))).drop(*lowered)


def with_target_by_dictionary(df: DataFrame, vehicles: DataFrame, patterns: DataFrame, exclusions: DataFrame, hints: dict | None = None) -> DataFrame:
    """Same rule against dictionary frames supplied by the user (too large to unroll).

    A conditional join of the distinct texts of the listings with the dictionary; Catalyst broadcasts the dictionary when its
    size allows. The first match is a min over the dictionary order, and every listing finds it by its own texts, so listings
    that share a key, or have none, keep their own vehicle.
    """
    hints = hints or builtin("targets")["fuel_hints"]
    pats = patterns.groupBy("vehicle_id").agg(F.array_join(F.collect_list(F.concat(F.lit("(?:"), "regex", F.lit(")"))), "|").alias("rx"))
    excl = exclusions.groupBy("vehicle_id").agg(F.collect_list(F.lower("text")).alias("words"))
    dim = vehicles.select("vehicle_id", F.col("ord").alias("veh_ord"), F.lower("marque").alias("v_marque"), F.col("carburant").alias("v_fuel")) \
        .join(pats, "vehicle_id").join(excl, "vehicle_id", "left")
    c = F.col
    texts = {"b": strip_spaces(F.lower("marque")), "m": strip_spaces(F.lower("modele")), "t": F.lower(blank_if_null("titre")),
             "s": F.lower(blank_if_null("version")), "f": F.lower(F.coalesce("carburant", F.lit("unknown")))}
    read = df.withColumns({"_" + n: x for n, x in texts.items()})
    names = ["_" + n for n in texts]
    distinct = read.filter((c("_b") != "") & (c("_m") != "")).select(*[c("_" + n).alias(n) for n in texts]).distinct()
    hint_ok = F.lit(False)
    for fuel, words in hints.items():
        hint_ok = hint_ok | ((c("v_fuel") == fuel) & contains_any(F.concat_ws(" ", "t", "s"), words))
    regex = F.concat(F.lit("(?i)"), c("rx"))
    fits = (
        (F.contains(c("b"), c("v_marque")) | F.contains(c("v_marque"), c("b")))
        & (F.regexp_like(c("m"), regex) | F.regexp_like(c("t"), regex) | F.regexp_like(c("s"), regex))
        & (c("v_fuel").isNull() | F.contains(c("f"), c("v_fuel")) | (c("f") == "unknown") | hint_ok)
        & (c("words").isNull() | ~F.exists(c("words"), lambda w: F.contains(c("t"), w) | F.contains(c("s"), w)))
    )
    first = distinct.join(dim, fits).groupBy(*texts).agg(F.min(F.struct("veh_ord", "vehicle_id")).alias("hit")).select(
        *[c(n).alias("_" + n) for n in texts], "hit")
    return read.join(first, names, "left").withColumn("vehicule_cible_id", F.coalesce(c("hit.vehicle_id"), F.lit(""))).drop("hit", *names)


def classic_target_ord(marque: Column, modele: Column, titre: Column, description: Column, motorisation: Column,
                       classic: dict | None = None) -> Column:
    """Older rule: brand in brand or title, model in model or title, engine words excluded and required."""
    cfg = classic or builtin("classic")
    brand, model, title = (F.lower(blank_if_null(x)) for x in (marque, modele, titre))
    text = F.lower(F.concat_ws(" ", blank_if_null(titre), blank_if_null(description), blank_if_null(motorisation)))
    undecided = (blank_if_null(motorisation) == "") & (blank_if_null(description) == "")
    out = None
    for i, v in enumerate(cfg["vehicles"]):
        want, models = v["marque"].lower(), [m.lower() for m in v["modeles"]]
        fits = (
            (F.contains(brand, F.lit(want)) | F.contains(title, F.lit(want)))
            & (contains_any(model, models) | contains_any(title, models))
            & ~contains_any(text, [e.lower() for e in v["exclude"]])
            & (contains_any(text, [e.lower() for e in v["include"]]) | undecided)
        )
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return out
