"""Stable ids and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carsift.functions.text import normalize_identity


def _text_or_blank(num: Column) -> Column:
    """Number as text; NULL and 0 both count as missing."""
    return F.coalesce(F.when(num != 0, num.cast("string")), F.lit(""))


def fingerprint(source: Column, listing_id: Column, marque: Column, modele: Column, annee: Column, km: Column,
                prix: Column, departement: Column, titre: Column) -> Column:
    """From the source's own listing id when there is one, else from eight normalised fields."""
    by_fields = F.concat_ws(
        "|", source, normalize_identity(marque), normalize_identity(modele), _text_or_blank(annee), _text_or_blank(km),
        _text_or_blank(prix), F.coalesce(departement, F.lit("")), F.substring(normalize_identity(titre), 1, 50))
    by_id = F.concat_ws(":", source, listing_id)
    return F.substring(F.sha2(F.when(F.coalesce(listing_id, F.lit("")) != "", by_id).otherwise(by_fields), 256), 1, 32)


def soft_key(marque: Column, modele: Column, annee: Column, km: Column, departement: Column) -> Column:
    """Readable form of the cross-source key: no source, no price, mileage floored to 10 000."""
    bucket = F.coalesce(F.when(km != 0, (F.floor(km / 10000) * 10000).cast("string")), F.lit(""))
    return F.concat_ws("|", normalize_identity(marque), normalize_identity(modele), _text_or_blank(annee), bucket,
                       F.coalesce(departement, F.lit("")))


def fingerprint_soft(marque: Column, modele: Column, annee: Column, km: Column, departement: Column) -> Column:
    return F.substring(F.sha2(soft_key(marque, modele, annee, km, departement), 256), 1, 16)


def classic_id(url: Column) -> Column:
    return F.md5(url)


def content_hash(marque: Column, modele: Column, prix: Column, km: Column, departement: Column) -> Column:
    """Missing values are spelled 'None' in this hash."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("None")) for c in (marque, modele, prix, km, departement)]))
