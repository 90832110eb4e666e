"""Compiler from the profile table (config/profiles.yaml) to column expressions: JSON objects, HTML cards and detail pages of a
site become typed rows by one job, whatever the site. A new page layout is a new row of the table, not new code.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carsift.functions.parse import digits
from carsift.functions.text import SPACE, blank_if_null, null_if_blank
from carsift.operators.settle import settle
from carsift.sources import cards, walk
from carsift.sources.dictionaries import builtin
from carsift.sources.embedded import listed_vehicles, next_data, script_json

c = F.col
# fixed values: site addresses
BASE = {"autoscout24": "https://www.autoscout24.fr", "lacentrale": "https://www.lacentrale.fr", "leboncoin": "https://www.leboncoin.fr",
        "paruvendu": "https://www.paruvendu.fr"}
CARD_COLUMNS = ["page_id", "pos", "source", "source_listing_id", "url", "titre", "prix", "kilometrage", "annee", "ville", "departement", "thumbnail_url",
                "marque", "modele", "version", "carburant"]
DETAIL_COLUMNS = ["url", "description", "images_urls", "seller_type", "seller_name", "seller_phone", "carburant", "boite", "puissance_ch", "version",
                  "motorisation", "ct_info"]


def profile(kind: str, name: str) -> dict:
    return builtin("profiles")[kind][name]


def first(*values: Column) -> Column:
    """First value that is not NULL, empty, 0 or false; NULL if there is none."""
    return F.coalesce(*[F.when(~v.isin("", "0", "0.0", "null", "false", "[]", "{}"), v) for v in values], F.lit(None).cast("string"))


def absolute(url: Column, source: str) -> Column:
    return F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit(BASE[source]), url))


# ---- JSON objects -----------------------------------------------------------------------------------------------
def member(raw: Column, path: str, kind: str = "string") -> Column:
    """Text (or another type) at a path of the profile table."""
    owner, bar, rest = path.partition("|")
    if not bar:
        return F.try_variant_get(raw, f"$.{path}", kind)
    there = F.try_variant_get(raw, f"$.{owner}", "variant").isNotNull()
    return F.when(there, F.try_variant_get(raw, f"$.{owner}.{rest}", kind)).otherwise(F.try_variant_get(raw, f"$.{rest}", kind))


def as_type(text: Column, kind: str | None) -> Column:
    if kind == "int":
        return text.try_cast("double").cast("int")
    if kind == "digits":
        return digits(text).try_cast("int")
    if kind == "year":
        return F.when(text.rlike("^[0-9]{4}$"), text).when(F.contains(text, F.lit("/")), F.substring_index(text, "/", -1)).try_cast("int")
    return text


def _split(path: str) -> tuple[str, str]:
    """(owner, name) of a path of the profile table; owner is empty for a member of the object itself."""
    owner, _, name = path.replace("|", ".").rpartition(".")
    if "." in owner:
        raise ValueError(f"{path}: paths of JSON profiles have one dot at most")
    return owner, name


def _json_types(paths: list[str], lists: list[str], keys: list[str]) -> tuple[str, str]:
    """Two struct types that hold all paths of a profile: members and texts of lists, and what is below them.

    An object is cast to both once; a path asked for by itself is walked anew, and one that is not there ends in an exception.
    """
    flat, below = {}, {name: keys for name in lists}
    for owner, name in map(_split, paths):
        if owner:
            below.setdefault(owner, [])
            below[owner] = list(dict.fromkeys([*below[owner], name]))
    for path in paths:
        owner, name = _split(path)
        if not owner or "|" in path:
            flat[name] = "string"
        if "|" in path:
            flat.setdefault(owner, "variant")
    strings = lambda names: f"struct<{', '.join(f'`{n}`: string' for n in names)}>"
    flat |= {name: "array<string>" for name in lists}
    nested = [f"`{name}`: {f'array<{strings(names)}>' if name in lists else strings(names)}" for name, names in below.items()]
    return f"struct<{', '.join(f'`{n}`: {kind}' for n, kind in flat.items())}>", f"struct<{', '.join(nested)}>"


def _json_member(path: str) -> Column:
    """As `member`, of an object cast to the types of `_json_types` as columns flat and below."""
    owner, name = _split(path)
    if "|" in path:
        return F.when(c("flat")[owner].isNotNull(), c("below")[owner][name]).otherwise(c("flat")[name])
    return c("below")[owner][name] if owner else c("flat")[name]


def images(lists: list[str], keys: list[str], most: int | None) -> Column:
    """Addresses in the first of the lists that exists; items are texts or objects with the address under a key."""
    def addresses(name: str) -> Column:
        some = F.slice(c("flat")[name], 1, most) if most else c("flat")[name]
        below = lambda i: F.get(c("below")[name], i)
        # an object's own text begins with a brace and is no address
        return F.transform(some, lambda x, i: F.coalesce(*[below(i)[k] for k in keys], F.when(~F.startswith(x, F.lit("{")), x), F.lit("")))

    return F.coalesce(*[addresses(name) for name in lists], F.array().cast("array<string>"))


def json_rows(objects: DataFrame, name: str) -> DataFrame:
    """`raw` (VARIANT, or JSON text) -> typed rows of a JSON profile; objects without id give none."""
    p = profile("json", name)
    if dict(objects.dtypes)["raw"] == "string":
        objects = objects.withColumn("raw", F.try_parse_json("raw"))
    source = p["source"]
    keep = [x for x in objects.columns if x != "raw"]
    fields = ["titre", "prix", "marque", "modele", "version", "annee", "kilometrage", "carburant", "motorisation", "ville", "code_postal", "departement"]
    paths = [*p["id"], *p["url"]["first"], *p["private"], *[x for f in fields for x in (*p[f]["first"], *p[f].get("else_words", []))]]
    if set(p["images"]["lists"]) & {part for x in paths for part in _split(x)}:
        raise ValueError(f"{name}: a list of images is no other member")
    flat, below = (F.try_variant_get("raw", "$", kind) for kind in _json_types(paths, p["images"]["lists"], p["images"]["keys"]))
    objects = settle(objects.withColumns({"flat": flat, "below": below}), ["flat", "below"])

    def field(spec: dict) -> Column:
        value = first(*[_json_member(path) for path in spec["first"]])
        if "else_words" in spec:
            words = F.concat_ws(" ", *[F.coalesce(_json_member(path), F.lit("")) for path in spec["else_words"]])
            value = F.coalesce(value, words)
        return as_type(value, spec.get("as"))

    lid = first(*[_json_member(path) for path in p["id"]])
    before, after = p["url"]["else"].split("{id}")
    url = F.coalesce(first(*[_json_member(path) for path in p["url"]["first"]]), F.concat(F.lit(before), lid, F.lit(after)))
    private = reduce(lambda a, b: a | b, [F.coalesce(_json_member(k) == v, F.lit(False)) for k, v in p["private"].items()])
    return objects.filter(lid.isNotNull()).select(
        *keep, F.lit(source).alias("source"), lid.alias("source_listing_id"), absolute(url, source).alias("url"), *[field(p[f]).alias(f) for f in fields],
        F.when(private, "particulier").otherwise("pro").alias("type_vendeur"), images(**p["images"]).alias("images_urls"))


def older_listings(pages: DataFrame, name: str) -> DataFrame:
    """Listings of older result pages (page_id, html) by a JSON profile: every JSON block of the page, or its data script."""
    p = profile("json", name)
    if p["find"] == "listed_vehicles":
        data = pages.select("page_id", next_data(c("html")).alias("json"))
        objects = data.select("page_id", F.posexplode(listed_vehicles(c("json"))).alias("pos", "raw"))
    else:
        blocks = script_json(pages).select(F.struct("page_id", "block").alias("at"), "json")
        found = walk.find(blocks, p["find"], key="at")
        objects = found.select("at.page_id", F.concat(F.array("at.block"), "path").alias("pos"), c("node").alias("raw"))
    return json_rows(objects, name)


# ---- HTML cards -------------------------------------------------------------------------------------------------
def rule(p: dict) -> cards.Rule:
    return cards.Rule(p.get("cards", []), p["parts"], p.get("link", ""), p.get("around"), p.get("skip", ""))


def _found(text: Column, pattern: str) -> Column:
    return null_if_blank(F.regexp_extract(text, pattern.replace("{space}", SPACE), 1))


def _bounded(value: Column, spec: dict) -> Column:
    ok = F.lit(True)
    if "from" in spec:
        ok = ok & value.between(spec["from"], spec["to"])
    if "above" in spec:
        ok = ok & (value > spec["above"])
    if "below" in spec:
        ok = ok & (value < spec["below"])
    return F.when(ok, value)


def card_rows(pages: DataFrame, name: str, brand: str = "", model: str = "") -> DataFrame:
    """Index rows of the cards of all pages (page_id, html) by a card profile, in page order."""
    p = profile("cards", name)
    source = p["source"]
    euro_texts, attributes = p["price"].get("euro_texts", False), p["image"]["attributes"]
    found = pages.select("page_id", F.posexplode(cards.cut(c("html"), rule(p), attributes, euro_texts, first_image=True)).alias("pos", "card"))
    if "most" in p:
        found = found.filter(c("pos") < p["most"])
    parts = lambda part: c("card.parts")[part] if part in p["parts"] else F.lit(None).cast("string")
    whole = c("card.text")
    # text a pattern is read from: a named part, or where it is absent the whole card
    at = lambda spec: F.coalesce(parts(spec["in"]), whole if spec["in"] == "infos" else F.lit("")) if "in" in spec else whole
    href = c("card.href")
    keep = href.isNotNull() & (href != "")
    if "href_has" in p:
        keep = keep & reduce(lambda a, b: a | b, [F.contains(F.lower(href) if name.endswith("older") else href, F.lit(x)) for x in p["href_has"]])
    if p.get("needs_title"):
        keep = keep & parts("title").isNotNull()
    lid = F.coalesce(*[_found(href, x) for x in p["id"]])

    spec = p["price"]
    if euro_texts:
        amounts = F.transform(F.filter("card.texts", lambda t: F.contains(t, F.lit("€"))), lambda t: digits(t).try_cast("bigint"))
        prix = F.get(F.filter(amounts, lambda a: a.between(spec["from"], spec["to"])), F.lit(0))
    elif "pattern" in spec:
        prix = digits(_found(whole, spec["pattern"])).try_cast("bigint")
    else:
        text = digits(parts(spec["part"]))
        text = F.when(F.length(text) <= spec["most_digits"], text) if "most_digits" in spec else text
        prix = _bounded(text.try_cast("bigint"), spec)
    km = _bounded(digits(_found(at(p["km"]), p["km"]["pattern"])).try_cast("bigint"), p["km"]) if "km" in p else F.lit(None)
    annee = _found(at(p["year"]), p["year"]["pattern"]) if "year" in p else F.lit(None)
    place = F.coalesce(_found(at(p["place"]), p["place"]["pattern"]), F.lit("")) if "place" in p else F.lit("")
    ville = F.lit("")
    if "place" in p and p["place"].get("city"):
        text = F.trim(blank_if_null(parts("place")))
        ville = text if p["place"]["city"] == "whole" else F.when(place != "", F.trim(F.substring_index(text, "(", 1))).otherwise(text)
    image = F.coalesce(*[null_if_blank(F.get("card.images", F.lit(0))[a]) for a in attributes], F.lit(""))
    if p["image"].get("no_data"):
        image = F.when(F.startswith(image, F.lit("data:")), "").otherwise(image)
    shown = {"capital": brand.capitalize(), "title": brand.title(), "as_is": brand}[p["brand"]]
    titles = [null_if_blank(parts(t)) for t in p["title"]["parts"]] + ([null_if_blank(c("card.link_title"))] if p["title"].get("link") else [])
    titre = F.coalesce(*titles, F.lit(f"{shown} {model}".strip()))
    fuel = F.lit("")
    if "fuel" in p:
        low = F.lower(whole)
        words = [(k, v) for k, v in p["fuel"].items() if k != "else"]
        fuel = reduce(lambda a, kv: a.when(low.rlike("|".join(map(re.escape, kv[1]))), kv[0]), words[1:], F.when(low.rlike("|".join(map(re.escape, words[0][1]))), words[0][0])).otherwise(p["fuel"]["else"])
    return found.filter(keep).select(
        "page_id", "pos", F.lit(source).alias("source"), lid.alias("source_listing_id"), absolute(href, source).alias("url"), titre.alias("titre"), prix.cast("int").alias("prix"),
        km.cast("int").alias("kilometrage"), annee.cast("int").alias("annee"), ville.alias("ville"), place.alias("departement"), image.alias("thumbnail_url"),
        F.lit(shown).alias("marque"), F.lit(model.title() if p["brand"] == "title" else model).alias("modele"), F.lit("").alias("version"), fuel.alias("carburant"),
    ).filter(c("source_listing_id").isNotNull())


# ---- detail pages -----------------------------------------------------------------------------------------------
def detail_rows(pages: DataFrame, site: str, most_images: int | None = 10, most_text: int | None = 2000) -> DataFrame:
    """Detail pages (url, html) of a site -> the columns of a detail row; description and images as long as asked (None: whole)."""
    p = profile("details", site)
    nothing = F.lit("")
    if "json" in p:
        d = pages.select("url", next_data(c("html")).alias("data")).filter(c("data").isNotNull()).select("url", F.try_variant_get("data", p["json"], "variant").alias("ad"))
        ad = c("ad")
        text = F.coalesce(*[member(ad, x) for x in p["description"]], nothing)
        found = F.coalesce(member(ad, p["images_path"], "array<string>"), F.array().cast("array<string>"))
        seller, name = F.coalesce(member(ad, p["seller_type"]), nothing), F.coalesce(member(ad, p["seller_name"]), nothing)
    else:
        one = cards.Rule(["html", "body", "div"], p["parts"], most=1)
        cut = cards.cut(F.concat(F.lit("<html>"), c("html")), one, ["src"])
        d = pages.filter(c("html").isNotNull()).select("url", F.get(cut, F.lit(0)).alias("card"))
        part = lambda x: blank_if_null(c("card.parts")[x])
        text, low, name = part("description"), F.lower(part("seller")), nothing
        urls = F.transform("card.images", lambda a: F.coalesce(a["src"], F.lit("")))
        wanted = lambda u: reduce(lambda a, b: a | b, [F.contains(u, F.lit(x)) for x in p["images"]]) & ~F.startswith(u, F.lit("data:"))
        found = F.coalesce(F.filter(urls, wanted), F.array().cast("array<string>"))
        pro = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in p.get("pro_words", [])])
        seller = F.when(F.contains(low, F.lit("particulier")), "particulier").when(pro, "professionnel").otherwise("")
    text = F.substring(text, 1, most_text) if most_text else text
    return d.select(
        "url", text.alias("description"), (F.slice(found, 1, most_images) if most_images else found).alias("images_urls"), seller.alias("seller_type"), name.alias("seller_name"),
        nothing.alias("seller_phone"), nothing.alias("carburant"), nothing.alias("boite"), F.lit(None).cast("int").alias("puissance_ch"), nothing.alias("version"),
        nothing.alias("motorisation"), nothing.alias("ct_info"))
