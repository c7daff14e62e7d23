"""Hash keys of articles and feed entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressline.functions.text import normalize_headline

KEY_HEX = 40


def short_sha(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, KEY_HEX)


def dedupe_hash(canonical_url: Column) -> Column:
    """Primary key of an article: its canonical URL."""
    return short_sha(F.concat(F.lit("url:"), canonical_url))


def content_hash(headline: Column, published_at: Column) -> Column:
    """Key of a syndicated story: normalised headline and UTC day."""
    return short_sha(F.concat(F.lit("content:"), normalize_headline(headline), F.lit(":"), F.date_format(published_at, "yyyy-MM-dd")))


def revision_hash(*fields: Column) -> Column:
    """Equality key of a normalised item; the order of the fields is fixed by the caller."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def fingerprint(entry: Column) -> Column:
    """Equality key of a feed entry (a struct)."""
    return F.sha2(F.to_json(entry), 256)
