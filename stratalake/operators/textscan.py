"""Personal data in text columns of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stratalake.functions.personal import (
    between_emails, email_gaps, email_matches, find_personal_cued, locate, off_placeholder, phone_gaps, phone_matches, redact_all,
    redact_found,
)
from stratalake.settings import DEFAULT_SITE, Site


def findings(df: DataFrame, keys: Sequence[str], text: str, site: Site = DEFAULT_SITE) -> DataFrame:
    """(*keys, type, value, position) of every address and phone-like run.

    Matches and gaps are columns of their own, each found once per text; only texts with a
    match are split a second time for the positions.
    """
    source = F.col(text)
    matched = df.select(*keys, text, email_matches(source).alias("_emails"), phone_matches(source).alias("_phones"))
    split_up = matched.withColumns({
        "_email_gaps": F.when(F.size("_emails") > 0, email_gaps(source)),
        "_phone_gaps": F.when(F.size("_phones") > 0, phone_gaps(source)),
    })
    none = F.array().cast("array<struct<type:string,value:string,position:int>>")
    located = F.concat(
        F.coalesce(off_placeholder(locate(F.col("_emails"), F.col("_email_gaps"), "email"), site), none),
        F.coalesce(locate(F.col("_phones"), F.col("_phone_gaps"), "phone"), none),
    )
    return split_up.select(*keys, F.inline(located))


def findings_cued(df: DataFrame, keys: Sequence[str], text: str, site: Site = DEFAULT_SITE) -> DataFrame:
    """(*keys, type, value); safe addresses left out, phones only in texts that name a phone."""
    return df.select(*keys, F.inline(find_personal_cued(F.col(text), site)))


def redact(df: DataFrame, text: str) -> DataFrame:
    """Replace every address and phone-like run of the column by a tag."""
    return df.withColumn(text, redact_all(F.col(text)))


def redact_output(df: DataFrame, text: str, flag: str = "pii_found", site: Site = DEFAULT_SITE) -> DataFrame:
    """Replace what :func:`findings_cued` finds, wherever it stands, and tell whether it found anything."""
    source = F.col(text)
    found = df.withColumn("_found", find_personal_cued(source, site)).withColumns({
        "_matches": F.when(F.size("_found") > 0, email_matches(source)), "_gaps": F.when(F.size("_found") > 0, between_emails(source))})
    return found.withColumns({
        text: redact_found(source, F.col("_found"), F.col("_matches"), F.col("_gaps"), site),
        flag: F.size("_found") > 0,
    }).drop("_found", "_matches", "_gaps")
