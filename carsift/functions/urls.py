"""URL canonicalisation: tracking parameters, blank values, fragment and trailing slashes removed, host lower-cased."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carsift.sources.dictionaries import builtin


def _quote_plus(col: Column) -> Column:
    # url_encode keeps '*' and escapes '~'; the canonical form does the opposite
    return F.replace(F.replace(F.url_encode(col), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    drop = builtin("parsing")["tracking_params"]
    text = F.coalesce(url, F.lit(""))
    no_fragment = F.regexp_replace(text, "(?s)#.*$", "")
    head = F.regexp_extract(no_fragment, r"(?s)^([^?]*)", 1)
    query = F.when(F.contains(no_fragment, F.lit("?")), F.regexp_extract(no_fragment, r"(?s)^[^?]*\?(.*)$", 1)).otherwise("")

    scheme = F.lower(F.regexp_extract(head, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1))
    after = F.regexp_replace(head, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    host = F.lower(F.regexp_extract(after, r"^(//[^/]*)", 1))
    path = F.regexp_replace(F.regexp_replace(after, r"^//[^/]*", ""), "/+$", "")

    # key=value pairs with a value, tracking keys removed; repeated keys are grouped at their first place
    pairs = F.filter(
        F.transform(
            F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=.")),
            lambda p: F.struct(
                F.try_url_decode(F.regexp_extract(p, "(?s)^([^=]*)=", 1)).alias("k"),
                F.try_url_decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v"),
            ),
        ),
        lambda p: ~F.lower(p["k"]).isin(drop),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    encoded = F.array_join(
        F.flatten(F.transform(keys, lambda k: F.transform(
            F.filter(pairs, lambda p: p["k"] == k), lambda p: F.concat(_quote_plus(k), F.lit("="), _quote_plus(p["v"]))))),
        "&",
    )
    tail = F.when(query == "", "").otherwise(F.when(encoded == "", "").otherwise(F.concat(F.lit("?"), encoded)))
    return F.when(text == "", "").otherwise(F.concat(scheme, host, path, tail))
