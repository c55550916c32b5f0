"""Personal data in values and in free text: masks, findings, redaction. All native columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from stratalake.functions.digests import sha256
from stratalake.functions.scalars import once, running_totals
from stratalake.settings import (
    DEFAULT_SITE, EMAIL_PATTERN, EMAIL_TAG, PHONE_CUES, PHONE_PATTERN, PHONE_TAG, Site,
)

# Word boundaries, digits and spaces count in any script.
_PHONE = "(?U)" + PHONE_PATTERN
_CUE = "|".join(PHONE_CUES)
# A run of address characters with two signs, and digits enough for a phone with at most one separator between.
_TWO_SIGNS = "@[a-zA-Z0-9_.+-]*@"
_LONG_CLUSTER = r"(?U)\d(?:[\s-]?\d){9,}"


def mask_email(column: Column, site: Site = DEFAULT_SITE) -> Column:
    """Hash an address; the placeholder for a missing one stays readable."""
    return F.when(column == site.missing_email, column).otherwise(sha256(column))


def mask_name(column: Column) -> Column:
    return sha256(column)


def mask_phone(column: Column) -> Column:
    """``****`` and the last four digits, or ``****`` alone when there are fewer."""
    digits = F.regexp_replace(column, r"(?U)\D", "")
    tail = F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).otherwise(F.lit(""))
    return F.when(column.isNotNull(), F.concat(F.lit("****"), tail))


def _matches(text: Column, pattern: str, needed: str | None = None) -> Column:
    """All matches as an array; texts without the ``needed`` character skip the regex."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    usable = text.isNotNull() if needed is None else F.coalesce(F.contains(text, F.lit(needed)), F.lit(False))
    return F.when(usable, found).otherwise(none)


def email_matches(text: Column) -> Column:
    return _matches(text, EMAIL_PATTERN, needed="@")


def phone_matches(text: Column) -> Column:
    return _matches(text, _PHONE)


def _without(found: Column, safe: Sequence[str]) -> Column:
    return F.filter(found, lambda value: ~F.lower(value).isin(*safe))


def between_emails(text: Column) -> Column:
    """What stands before, between and after the addresses of a text."""
    return F.split(text, EMAIL_PATTERN, -1)


def email_gaps(text: Column) -> Column:
    """Lengths of the stretches between the addresses of a text, in characters."""
    return F.transform(between_emails(text), F.length)


def phone_gaps(text: Column) -> Column:
    return F.transform(F.split(text, _PHONE, -1), F.length)


def _start_positions(found: Column, gaps: Column) -> Column:
    """0-based start of each match: the running total of the gap before it and of the match before that."""
    return running_totals(F.transform(found, lambda _, i: F.get(gaps, i) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(F.lit(0))))


def locate(found: Column, gaps: Column, kind: str) -> Column:
    """Array of (type, value, position) from matches and gaps; null when there is no match.

    Give existing columns, not expressions: they are read once for every match.
    """
    hits = F.transform(
        F.arrays_zip(found.alias("value"), _start_positions(found, gaps).alias("position")),
        lambda hit: F.struct(
            F.lit(kind).alias("type"),
            hit["value"].alias("value"),
            hit["position"].alias("position"),
        ),
    )
    return F.when(F.size(found) > 0, hits)


def off_placeholder(hits: Column, site: Site = DEFAULT_SITE) -> Column:
    """Located addresses other than the placeholder."""
    return F.filter(hits, lambda hit: F.lower(hit["value"]) != site.missing_email)


def find_personal_cued(text: Column, site: Site = DEFAULT_SITE) -> Column:
    """Array of (type, value): addresses off the safe list; phones only in texts with a cue word."""
    cued = F.coalesce(F.lower(text).rlike(_CUE), F.lit(False))
    phones = F.when(cued, phone_matches(text)).otherwise(F.array().cast("array<string>"))

    def tagged(values: Column, kind: str) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    return F.concat(
        tagged(_without(email_matches(text), site.safe_emails), "email"), tagged(phones, "phone"))


def redact_all(text: Column) -> Column:
    """Replace every address (safe ones too) and every phone run by a tag."""
    emails_gone = F.when(
        F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL_PATTERN, EMAIL_TAG)).otherwise(text)
    return F.regexp_replace(emails_gone, _PHONE, PHONE_TAG)


def _folded(text: Column, values: Column, tag: str) -> Column:
    """Replace value after value, each wherever it stands by then. Time: values x text."""
    return F.aggregate(F.array_distinct(values), text, lambda current, value: F.replace(current, value, F.lit(tag)))


def _nested(addresses: Column) -> Column:
    """Whether an address may stand inside another one: the part before its @ ends the other's.

    Sorted from the back, such parts begin one another, and then some two neighbours do.
    """
    backwards = F.array_sort(F.transform(F.array_distinct(addresses), lambda a: F.reverse(F.substring_index(a, "@", 1))))
    return once(backwards, lambda b: F.exists(
        F.transform(b, lambda part, i: F.when(i > 0, F.startswith(part, F.get(b, i - 1))).otherwise(F.lit(False))), lambda inside: inside))


def _without_addresses(text: Column, found: Column, matches: Column, gaps: Column, safe: Sequence[str]) -> Column:
    """The found addresses replaced wherever they stand.

    Where no run of address characters has two @ and no address may stand inside another, a found address stands nowhere
    but at its own matches, so the text is put together again from gaps and matches; else value after value.
    """
    tagged = F.transform(matches, lambda m: F.when(F.lower(m).isin(*safe), m).otherwise(F.lit(EMAIL_TAG)))
    rebuilt = F.array_join(F.zip_with(gaps, tagged, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")
    plain = ~text.rlike(_TWO_SIGNS) & ~_nested(matches)
    return F.when(F.size(found) == 0, text).when(plain, rebuilt).otherwise(_folded(text, found, EMAIL_TAG))


def _without_phones(text: Column, found: Column) -> Column:
    """The found phone runs replaced wherever they stand.

    Where each long cluster of digits is a match, all of it was found and the found ones have equally many digits, a
    found run stands nowhere but at its own matches, so one pass replaces them; else value after value.
    """
    def replaced(t: Column) -> Column:
        digits = F.transform(found, lambda p: F.length(F.regexp_replace(p, r"(?U)\D", "")))
        plain = once(phone_matches(t), lambda m: (m == F.regexp_extract_all(t, F.lit(_LONG_CLUSTER), F.lit(0))) & (F.size(F.array_except(m, found)) == 0))
        return F.when(plain & (F.array_min(digits) == F.array_max(digits)), F.regexp_replace(t, _PHONE, PHONE_TAG)).otherwise(_folded(t, found, PHONE_TAG))

    return F.when(F.size(found) == 0, text).otherwise(once(text, replaced))


def redact_found(text: Column, found: Column, matches: Column, gaps: Column, site: Site = DEFAULT_SITE) -> Column:
    """Replace every value of ``found`` (from :func:`find_personal_cued`) wherever it stands, as if one after another.

    ``matches`` and ``gaps``: all addresses of the text and what stands between. Give existing columns.
    """
    def values(kind: str) -> Column:
        return F.transform(F.filter(found, lambda hit: hit["type"] == kind), lambda hit: hit["value"])

    addressed = _without_addresses(text, values("email"), matches, gaps, site.safe_emails)
    return F.when(F.size(found) > 0, once(values("phone"), lambda phones: _without_phones(addressed, phones))).otherwise(text)
