"""Configuration dictionaries: YAML on the driver -> plain dicts (for generated expressions) and small dimension frames.

The dictionaries hold tens of rows, so they are folded into column expressions where possible; the dimension frames
exist for joins with user-supplied dictionaries.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

CONFIG_DIR = Path(__file__).resolve().parent.parent / "config"


def load_yaml(path: str | Path) -> dict[str, Any]:
    """A missing or empty file reads as an empty dictionary."""
    path = Path(path)
    if not path.exists():
        return {}
    return yaml.safe_load(path.read_text(encoding="utf-8")) or {}


@lru_cache(maxsize=None)
def builtin(name: str) -> dict[str, Any]:
    return load_yaml(CONFIG_DIR / f"{name}.yaml")


def dim_vehicle(spark: SparkSession, targets: dict | None = None) -> DataFrame:
    rows = [
        (i, v["id"], v["marque"], v["carburant"], *v["prix"], *v["km"], *v["km_ideal"], *v["annee"], *v["revente"], v["marche_median"])
        for i, v in enumerate((targets or builtin("targets"))["vehicles"])
    ]
    return spark.createDataFrame(
        rows,
        "ord int, vehicle_id string, marque string, carburant string, prix_min int, prix_max int, km_min int, km_max int, "
        "km_ideal_min int, km_ideal_max int, annee_min int, annee_max int, resale_min int, resale_max int, market_median int",
    )


def dim_vehicle_pattern(spark: SparkSession, targets: dict | None = None) -> DataFrame:
    rows = [
        (v["id"], i, p) for v in (targets or builtin("targets"))["vehicles"] for i, p in enumerate(v["modele_patterns"])
    ]
    return spark.createDataFrame(rows, "vehicle_id string, ord int, regex string")


def dim_vehicle_exclusion(spark: SparkSession, targets: dict | None = None) -> DataFrame:
    rows = [(v["id"], e) for v in (targets or builtin("targets"))["vehicles"] for e in v["exclusions"]]
    return spark.createDataFrame(rows, "vehicle_id string, text string")


def dim_keyword(spark: SparkSession, keywords: dict | None = None) -> DataFrame:
    kw = keywords or builtin("keywords")
    rows = []
    for kind, entries in (("opportunity", kw["opportunity"]), ("risk", kw["risk"])):
        for i, e in enumerate(entries):
            for j, p in enumerate(e["patterns"]):
                rows.append((kind, i, e["id"], j, p, e.get("bonus", 0), e.get("penalty", 0), e.get("cost", 0), e.get("severity", "low")))
    rows += [("exclusion", 0, "exclusion", j, p, 0, 0, 0, "low") for j, p in enumerate(kw["exclusions"])]
    return spark.createDataFrame(
        rows,
        "kind string, ord int, keyword_id string, pat_ord int, pattern string, bonus int, penalty int, cost int, severity string",
    )


def dim_search(spark: SparkSession, searches: dict | None = None) -> DataFrame:
    cols = ["name", "enabled", "source", "sources", "marque", "modele", "prix_min", "prix_max", "km_min", "km_max",
            "annee_min", "annee_max", "carburant", "particulier_only", "detail_threshold", "notify_threshold"]
    rows = [tuple(s.get(c) for c in cols) for s in (searches or builtin("searches"))["searches"]]
    return spark.createDataFrame(
        rows,
        "name string, enabled boolean, source string, sources array<string>, marque string, modele string, prix_min int, "
        "prix_max int, km_min int, km_max int, annee_min int, annee_max int, carburant string, particulier_only boolean, "
        "detail_threshold int, notify_threshold int",
    )


def dim_vehicle_classic(spark: SparkSession, classic: dict | None = None) -> DataFrame:
    rows = [
        (i, v["id"], v["marque"], v["carburant"], *v["prix"], *v["km"], *v["annee"], [e.lower() for e in v["exclude"]])
        for i, v in enumerate((classic or builtin("classic"))["vehicles"])
    ]
    return spark.createDataFrame(
        rows,
        "ord int, vehicle_id string, marque string, carburant string, prix_min int, prix_max int, km_min int, km_max int, "
        "annee_min int, annee_max int, exclude array<string>",
    )
