"""Field parsers: price, mileage, year, place, fuel, gearbox, power, seller, phone, brand, title, engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carsift.functions.text import SPACE, clean_for_matching, contains_any, null_if_blank, squeeze, strip_spaces, title_case
from carsift.operators.settle import settle
from carsift.sources.dictionaries import builtin

_S = f"[{SPACE}]"
_NUMBER = rf"(\p{{Nd}}[\p{{Nd}}{SPACE}.,]*)"
_WB, _WE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of the group; NULL when the pattern does not occur."""
    return null_if_blank(F.regexp_extract(text, pattern, group))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def to_int(text: Column) -> Column:
    """Whole number, NULL if blank or too long."""
    return text.try_cast("bigint")


def _between(num: Column, low, high) -> Column:
    return F.when(num.between(low, high), num.cast("int"))


def parse_price(text: Column) -> Column:
    marked = _group(text, _NUMBER + _S + "*€")
    return F.when(marked.isNotNull(), _between(to_int(digits(marked)), 100, 100000)).otherwise(
        _between(to_int(digits(text)), 500, 100000))


def parse_km(text: Column) -> Column:
    return _between(to_int(digits(_group(text, "(?i)" + _NUMBER + _S + "*km"))), 100, 500000)


def parse_year(text: Column, this_year: Column) -> Column:
    """The latest plausible year in the text, up to next year."""
    years = F.regexp_extract_all(text, F.lit(rf"{_WB}(19[89][0-9]|20[0-3][0-9]){_WE}"), 1)
    return F.array_max(F.filter(F.transform(years, lambda y: y.cast("int")), lambda y: y.between(1990, this_year + 1)))


def parse_code_postal(text: Column) -> Column:
    return _group(text, rf"{_WB}(\p{{Nd}}{{5}}){_WE}")


def parse_departement(text: Column) -> Column:
    return F.coalesce(F.substring(parse_code_postal(text), 1, 2), _group(text, r"\((\p{Nd}{2})\)"))


def extract_departement(location: Column, code_postal: Column) -> Column:
    """Older rule: the postal code wins, then a 5-digit code, then two or three digits in brackets (cut to two)."""
    return (
        F.when(F.length(code_postal) >= 2, F.substring(code_postal, 1, 2))
        .otherwise(F.coalesce(F.substring(parse_code_postal(location), 1, 2),
                              F.substring(_group(location, r"\((\p{Nd}{2,3})\)"), 1, 2)))
    )


def _classify(text: Column, classes: dict[str, list[str]]) -> Column:
    out = None
    for label, words in classes.items():
        hit = contains_any(text, words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.when(text.isNull(), "unknown").otherwise(out.otherwise("unknown"))


def parse_carburant(text: Column) -> Column:
    return _classify(F.lower(text), builtin("parsing")["fuel_words"])


def parse_boite(text: Column) -> Column:
    return _classify(F.lower(text), builtin("parsing")["gearbox_words"])


def parse_seller_type(text: Column) -> Column:
    return _classify(F.lower(text), builtin("parsing")["seller_words"])


def parse_puissance(text: Column) -> Column:
    return _between(to_int(_group(text, rf"(?i)([0-9]{{2,3}}){_S}*(?:ch|cv|hp)")), 40, 500)


def extract_phone(text: Column) -> Column:
    found = _group(text, rf"((?:0|\+33)[1-9](?:[{SPACE}.\-]?[0-9]{{2}}){{4}})")
    return F.regexp_replace(found, rf"[{SPACE}.\-]", "")


def extract_contact_phone(text: Column) -> Column:
    """Two looser phone patterns in order; a result needs ten characters."""
    def clean(c):
        return F.regexp_replace(c, r"[^0-9+]", "")
    first = clean(_group(text, rf"((?:\+33|0033|0)[1-9][{SPACE}.\-]?(?:[0-9]{{2}}[{SPACE}.\-]?){{4}})"))
    second = clean(_group(text, rf"(?i)(tel[{SPACE}:]*[0-9][0-9{SPACE}.\-]{{9,}})"))
    return F.coalesce(F.when(F.length(first) >= 10, first), F.when(F.length(second) >= 10, second))


def extract_email(text: Column) -> Column:
    return _group(text, r"([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})")


def clean_number(text: Column) -> Column:
    """All digits of the text as one number."""
    return to_int(digits(text))


def clean_year(text: Column) -> Column:
    return _group(text, r"((?:19|20)[0-9]{2})").cast("int")


def normalize_marque(marque: Column) -> Column:
    name = title_case(strip_spaces(F.coalesce(marque, F.lit(""))))
    key = clean_for_matching(name)
    out = None
    for brand, variants in builtin("parsing")["brand_aliases"].items():
        hit = key.isin([v.lower() for v in variants])
        out = F.when(hit, brand) if out is None else out.when(hit, brand)
    return out.otherwise(name)


def normalize_modele(modele: Column) -> Column:
    text = strip_spaces(F.coalesce(modele, F.lit("")))
    text = F.regexp_replace(text, rf"(?i)[0-9]+\.[0-9]+{_S}*(hdi|dci|tdi|vti|tce|dti|cdti|jtd).*", "")
    text = F.regexp_replace(text, rf"(?i)[0-9]+{_S}*(ch|cv).*", "")
    return title_case(strip_spaces(text))


def with_title_parts(df: DataFrame, titre: str, prefix: str = "t_") -> DataFrame:
    """Adds <prefix>marque, modele, version: the first listed brand found in the title, then a known model among the first
    three words (else the first word); a known model without a brand supplies the brand. One projection per step."""
    cfg = builtin("parsing")
    models = [(m, b) for b, ms in cfg["brand_models"].items() for m in ms]
    c = F.col
    brand = None
    for b in cfg["brands"]:
        hit = F.contains(c("_low"), F.lit(b.lower()))
        brand = F.when(hit, b) if brand is None else brand.when(hit, b)
    st = df.withColumn("_title", strip_spaces(F.coalesce(c(titre), F.lit("")))).withColumn("_low", F.lower("_title"))
    st = settle(st.withColumn("_brand", brand.otherwise("")), ["_brand"])
    # drop the first occurrence of the brand
    at = F.position(F.lower("_brand"), c("_low"))
    cut = strip_spaces(F.concat(F.substring("_title", F.lit(1), at - 1), F.substring("_title", at + F.length("_brand"), F.length("_title"))))
    st = settle(st.withColumn("_rest", F.when(c("_brand") != "", cut).otherwise(c("_title"))), ["_rest"])
    st = settle(st.withColumn("_words", F.when(c("_rest") == "", F.array().cast("array<string>")).otherwise(F.split(squeeze(c("_rest")), " "))), ["_words"])
    table = F.create_map(*[F.lit(x) for m, _ in models for x in (m.lower(), m)])
    heads = F.filter(
        F.transform(F.slice("_words", 1, 3), lambda w: F.struct(
            w.alias("w"), F.try_element_at(table, F.lower(F.regexp_replace(w, "[^a-zA-Z0-9]", ""))).alias("m"))),
        lambda s: s["m"].isNotNull())
    st = settle(st.withColumn("_known", F.get(heads, F.lit(0))), ["_known"])
    version = (
        F.when(c("_known").isNotNull(), F.array_join(F.filter("_words", lambda w: w != c("_known.w")), " "))
        .when(F.size("_words") > 0, F.array_join(F.slice("_words", 2, 2147483647), " "))
        .otherwise(c("_rest"))
    )
    st = settle(st.withColumn("_model", F.coalesce(c("_known.m"), F.get("_words", F.lit(0)), F.lit(""))), ["_model"])
    owner = F.create_map(*[F.lit(x) for m, b in models for x in (m.lower(), b)])
    st = settle(st.withColumn("_owner", F.when(c("_brand") != "", c("_brand")).otherwise(
        F.coalesce(F.try_element_at(owner, F.lower("_model")), F.lit("")))), ["_owner"])
    out = st.withColumns({prefix + "marque": normalize_marque(c("_owner")), prefix + "modele": normalize_modele(c("_model")),
                          prefix + "version": strip_spaces(version)})
    return settle(out.drop("_title", "_low", "_brand", "_rest", "_words", "_known", "_model", "_owner"),
                  [prefix + n for n in ("marque", "modele", "version")])


def extract_motorisation(text: Column) -> Column:
    found = F.coalesce(
        _group(text, rf"(?i)([0-9]+\.[0-9]+{_S}*(?:hdi|dci|tdi|vti|tce|dti|cdti|jtd|d-4d|bluehdi|blue{_S}*hdi))"),
        _group(text, rf"(?i)([0-9]+\.[0-9]+{_S}*(?:litres|litre|l)?)"),
        _group(text, rf"(?i)([0-9]{{2,3}}{_S}*(?:ch|cv|hp))"),
    )
    return F.coalesce(strip_spaces(found), F.lit(""))


def split_classic_title(titre: Column) -> Column:
    """struct(marque, modele) from the five brands of the oldest card parser: the brand, then the next word."""
    lowered = F.lower(F.coalesce(titre, F.lit("")))
    marque, modele = None, None
    for b in ["peugeot", "renault", "dacia", "ford", "toyota"]:
        hit = F.contains(lowered, F.lit(b))
        word = null_if_blank(F.get(F.split(squeeze(F.get(F.split(lowered, b), F.lit(1))), " "), F.lit(0)))
        marque = F.when(hit, b.capitalize()) if marque is None else marque.when(hit, b.capitalize())
        modele = F.when(hit, word) if modele is None else modele.when(hit, word)
    return F.struct(marque.alias("marque"), modele.alias("modele"))
