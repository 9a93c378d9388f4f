"""Project and parser routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratamem import constants as K
from stratamem.functions import text


def collection_of_slug(slug: Column) -> Column:
    return F.concat(F.lit(K.COLLECTION_PREFIX), slug)


def collection_of_project(name: Column) -> Column:
    return collection_of_slug(text.project_slug(name))


def collection_of_item(layer: Column, slug: Column) -> Column:
    """User-global items share one collection; the rest live in their project's."""
    shared = F.lit(K.COLLECTION_PREFIX + K.SHARED_SLUG)
    return F.when(layer == K.IMMUNE_LAYER, shared).otherwise(collection_of_slug(slug))


def parser_of(source: Column) -> Column:
    """Name of the parser for a path or URL; null when none applies.

    Web addresses are recognised first, so a URL that ends in a file suffix is
    still fetched as a page.
    """
    lowered = F.lower(source)
    suffix = text.suffix(source)
    return (
        F.when(source.rlike("^https?://"), "web")
        .when(F.endswith(lowered, F.lit(".docx")), "docx")
        .when(F.endswith(lowered, F.lit(".pdf")), "pdf")
        .when(lowered.rlike(r"\.(md|mdx|markdown)$"), "markdown")
        .when(suffix.isin(*K.CODE_SUFFIXES), "code")
    )
