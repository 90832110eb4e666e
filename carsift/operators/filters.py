"""Read-side filters, paging and lookups, search criteria, quarantine of invalid values, block classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carsift.functions.text import blank_if_null, contains_any
from carsift.sources.dictionaries import builtin

c = F.col
# fixed values: the orders a caller may ask for (column, descending)
ORDERS = {
    "score_total DESC": ("score_total", True), "score_total ASC": ("score_total", False),
    "created_at DESC": ("created_at", True), "created_at ASC": ("created_at", False),
    "prix ASC": ("prix", False), "prix DESC": ("prix", True),
}


def filter_listings(df: DataFrame, source: str | None = None, status: str | None = None, alert_level: str | None = None,
                    min_score: int | None = None, not_notified: bool = False) -> DataFrame:
    for col, value in (("source", source), ("status", status), ("alert_level", alert_level)):
        if value:
            df = df.filter(c(col) == value)
    if min_score is not None:
        df = df.filter(c("score_total") >= min_score)
    return df.filter(~c("notified")) if not_notified else df


def ordered(df: DataFrame, order_by: str = "score_total DESC", tie: str = "arrival_seq") -> DataFrame:
    """Unknown orders fall back to the best score first; ties are broken by arrival."""
    col, down = ORDERS.get(order_by, ORDERS["score_total DESC"])
    return df.orderBy(c(col).desc_nulls_last() if down else c(col).asc_nulls_first(), c(tie))


def page(df: DataFrame, order_by: str = "score_total DESC", limit: int = 100, offset: int = 0) -> DataFrame:
    return ordered(df, order_by).offset(offset).limit(limit)


def page_count(df: DataFrame, limit: int) -> DataFrame:
    return df.agg(F.ceil(F.count("*") / limit).alias("total_pages"))


def pending_alerts(df: DataFrame, min_score: int = 40) -> DataFrame:
    return df.filter(~c("notified") & (c("score_total") >= min_score))


def classic_filter(df: DataFrame, source: str | None = None, departement: str | None = None, score_min: int | None = None,
                   notified: bool | None = None) -> DataFrame:
    """All rows that pass; classic_page cuts a page from them."""
    if source:
        df = df.filter(c("source") == source)
    if departement:
        df = df.filter(c("departement") == departement)
    if score_min is not None:
        df = df.filter(c("score_rentabilite") >= score_min)
    if notified is not None:
        df = df.filter(c("notified") == notified)
    return df


def classic_page(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return df.orderBy(c("score_rentabilite").desc(), "arrival_seq").offset(offset).limit(limit)


def exists_flags(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Adds known_fingerprint and known_url (raw or canonical URL of a history row)."""
    from carsift.operators.dedup import known_urls

    fps = history.select("fingerprint").distinct().withColumn("_f", F.lit(True))
    urls = known_urls(history).withColumnRenamed("url_canonique", "url").withColumn("_u", F.lit(True))
    out = batch.join(fps, "fingerprint", "left").join(urls, "url", "left")
    return out.withColumns({"known_fingerprint": c("_f").isNotNull(), "known_url": c("_u").isNotNull()}).drop("_f", "_u")


def _in_range(col: Column, low, high) -> Column:
    """Missing and 0 pass; a missing bound does not limit."""
    ok = F.coalesce(col, F.lit(0)) == 0
    inside = F.lit(True)
    if low:
        inside = inside & (col >= low)
    if high:
        inside = inside & (col <= high)
    return ok | F.coalesce(inside, F.lit(False))


def strict_criteria(cfg: dict, with_text: bool = True) -> Column:
    """Price, mileage and year in range, fuel, and (with_text) no excluded engine word; missing values pass."""
    fuel = F.lower(blank_if_null("carburant"))
    cond = (_in_range(c("prix"), *cfg["prix"]) & _in_range(c("kilometrage"), *cfg["km"]) & _in_range(c("annee"), *cfg["annee"]))
    if with_text:
        if cfg["carburant"]:
            cond = cond & ((fuel == "") | F.contains(fuel, F.lit(cfg["carburant"])))
        text = F.lower(F.concat_ws(" ", blank_if_null("titre"), blank_if_null("description"), F.lit("")))
        cond = cond & ~contains_any(text, [e.lower() for e in cfg["exclude"]])
    else:
        cond = cond & ~contains_any(F.lower(blank_if_null("titre")), [e.lower() for e in cfg["exclude"]])
    return cond


def tolerant_criteria(cfg: dict) -> Column:
    """Price down to 80 % and up to 120 %, mileage up to 110 %; missing values pass."""
    prix, km = F.nullif(c("prix"), F.lit(0)), F.nullif(c("kilometrage"), F.lit(0))
    return F.coalesce((prix >= cfg["prix"][0] * 0.8) & (prix <= cfg["prix"][1] * 1.2), F.lit(True)) & F.coalesce(
        km <= cfg["km"][1] * 1.1, F.lit(True))


def matching_vehicles(df: DataFrame, criteria, cfg: dict | None = None) -> DataFrame:
    """One row per listing and dictionary vehicle whose criteria it meets, unrolled from the dictionary (no join)."""
    hits = [F.when(criteria(v), v["id"]) for v in (cfg or builtin("classic"))["vehicles"]]
    return df.withColumn("vehicle_id", F.explode(F.array_compact(F.array(*hits))))


def in_zone(cfg: dict | None = None) -> Column:
    zones = (cfg or builtin("classic"))["zones"]
    return (blank_if_null("departement") == "") | c("departement").isin(zones["priority"] + zones["secondary"])


def active_searches(searches: DataFrame) -> DataFrame:
    """Enabled searches, one row per source; the older single `source` field still counts."""
    sources = F.coalesce("sources", F.array("source"))
    return searches.filter(F.coalesce("enabled", F.lit(True))).withColumn("search_source", F.explode(sources))


def match_searches(df: DataFrame, searches: list[dict] | None = None, every: bool = False) -> DataFrame:
    """Listing x search: equal source and brand, model contained in the title, values inside the search ranges. Unrolled from
    the dictionary, so listings are neither shuffled nor joined. Disabled searches count only with `every`."""
    def between(col: str, low, high) -> Column:
        """An absent or zero bound is open; a bounded value must be present."""
        ok = F.lit(True)
        ok = ok & (c(col) >= low) if low else ok
        return ok & (c(col) <= high) if high else ok

    def meets(s: dict) -> Column:
        ok = c("source").isin(s.get("sources") or [s["source"]]) & (F.lower("marque") == s["marque"].lower())
        ok = ok & F.contains(F.lower("titre"), F.lit(s["modele"].lower()))
        for col, name in (("prix", "prix"), ("kilometrage", "km"), ("annee", "annee")):
            ok = ok & between(col, s.get(name + "_min"), s.get(name + "_max"))
        if s.get("carburant"):
            ok = ok & (c("carburant") == s["carburant"])
        return ok & (c("seller_type") == "particulier") if s.get("particulier_only") else ok

    used = [s for s in (searches or builtin("searches")["searches"]) if every or s.get("enabled", True)]
    hits = F.array_compact(F.array(*[F.when(meets(s), s["name"]) for s in used])) if used else F.array().cast("array<string>")
    return df.withColumn("search", F.explode(hits))


def department_tier(targets: dict | None = None) -> Column:
    """Tier of the department, NULL outside all tiers."""
    tiers = (targets or builtin("targets"))["department_tiers"]
    return F.coalesce(*[F.when(c("departement").isin(list(ds)), int(t)) for t, ds in tiers.items()])


def enum_problems(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds `invalid`: names of the columns whose value is not in its list; such rows go to quarantine instead of failing."""
    enums = builtin("parsing")["enums"]
    bad = [F.when(c(n).isNotNull() & ~c(n).isin(enums[n]), n) for n in columns]
    return df.withColumn("invalid", F.array_compact(F.array(*bad)))


def blocked(status_code: Column, html: Column) -> Column:
    """A blocking status, or a block phrase in a short page without the marks of a real result page."""
    # fixed values: marks of valid content and of block pages
    valid = ["annonce", "voiture", "prix", "€", "listing", "vehicle"]
    phrases = ["captcha", "access denied", "blocked", "too many requests", "rate limit"]
    text, size = F.lower(html), F.length(html)
    return (F.when(status_code.isin(403, 429, 503), True).when(contains_any(text, valid) & (size > 10000), False)
            .otherwise(contains_any(text, phrases) & (size < 50000)))
