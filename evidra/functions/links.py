"""Addresses of items and outbound queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def item_link(object_id: Column, base: str = "https://news.ycombinator.com/item?id=") -> Column:
    return F.concat(F.lit(base), object_id)


def capture_link(stamp: Column, original: Column, raw: bool = False, base: str = "https://web.archive.org/web/") -> Column:
    """The address of an archived page, ``raw`` without the archive's frame."""
    return F.concat(F.lit(base), stamp, F.lit("id_/" if raw else "/"), original)


def list_page(base: str, page: Column) -> Column:
    return F.when(page > 0, F.concat(F.lit(f"{base}?page="), page.cast("string"))).otherwise(F.lit(base))


def query_link(base: str, **params: Column) -> Column:
    """``base`` with encoded parameters in the order given."""
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in params.items())))


def absolute(href: Column, base: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))
