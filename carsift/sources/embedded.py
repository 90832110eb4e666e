"""JSON that result and detail pages carry in their markup, as VARIANT, and lists at fixed paths in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def next_data(html: Column) -> Column:
    """VARIANT of the page's data script; NULL without one or on bad JSON."""
    return F.try_parse_json(F.regexp_extract(html, r'(?s)<script[^>]*\bid="__NEXT_DATA__"[^>]*>(.*?)</script>', 1))


def initial_state(html: Column) -> Column:
    return F.try_parse_json(F.regexp_extract(html, r"(?s)window\.__INITIAL_STATE__\s*=\s*(\{.*?\});", 1))


def search_results_attribute(html: Column) -> Column:
    raw = F.regexp_extract(html, r'(?s)<[^>]*data-testid="searchResults"[^>]*\bdata-results="([^"]*)"', 1)
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return F.try_parse_json(raw)


def embedded_json(html: Column) -> Column:
    """First of the three places that holds valid JSON, as VARIANT."""
    return F.coalesce(next_data(html), initial_state(html), search_results_attribute(html))


def json_scripts(html: Column) -> Column:
    """All application/json script blocks."""
    return F.regexp_extract_all(html, F.lit(r'(?s)<script[^>]*type="application/json"[^>]*>(.*?)</script>'), 1)


def script_json(pages: DataFrame) -> DataFrame:
    """One row per application/json block with valid JSON: page_id, block, json (VARIANT)."""
    blocks = pages.select("page_id", F.posexplode(json_scripts(c("html"))).alias("block", "text"))
    return blocks.select("page_id", "block", F.try_parse_json("text").alias("json")).filter(c("json").isNotNull())


def _objects(found: Column) -> Column:
    """The objects of an array of VARIANT, none for NULL. The cast only tells the kind, without a copy of the members."""
    return F.filter(F.coalesce(found, F.array().cast("array<variant>")), lambda x: F.try_variant_get(x, "$", "struct<>").isNotNull())


def members(json: Column, path: str) -> Column:
    """Objects of the list at a fixed path, as array of VARIANT; empty where there is none."""
    return _objects(F.try_variant_get(json, path, "array<variant>"))


def listed_vehicles(json: Column) -> Column:
    """Older result pages: the vehicles of searchResults, then lists under four keys of the page's properties."""
    lists = ["results", "listings", "ads", "vehicles"]
    # one cast for all lists: a path that is not there is slow to ask for
    kind = f"struct<searchResults: struct<vehicles: array<variant>>, {', '.join(f'{k}: array<variant>' for k in lists)}>"
    props = F.try_variant_get(json, "$.props.pageProps", kind)
    return F.concat(*[_objects(x) for x in (props["searchResults"]["vehicles"], *[props[k] for k in lists])])
