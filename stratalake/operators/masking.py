"""Masks for the customer table, or for the columns a dictionary marks as personal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stratalake.functions.personal import mask_email, mask_name, mask_phone
from stratalake.settings import DEFAULT_SITE, Site


def mask_columns(
    df: DataFrame, emails: Sequence[str] = (), names: Sequence[str] = (), phones: Sequence[str] = (),
    site: Site = DEFAULT_SITE,
) -> DataFrame:
    """Mask the given columns in one projection."""
    return df.withColumns({
        **{c: mask_email(F.col(c), site) for c in emails},
        **{c: mask_name(F.col(c)) for c in names},
        **{c: mask_phone(F.col(c)) for c in phones},
    })


def mask_customers(df: DataFrame, site: Site = DEFAULT_SITE) -> DataFrame:
    """Address and both names hashed, phone cut to its tail; the consent date is kept."""
    return mask_columns(df, emails=["email"], names=["nombre", "apellido"], phones=["telefono"], site=site)
