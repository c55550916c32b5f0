"""Masks, findings and redaction, against fixed cases and against Python's regular expressions."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from stratalake.functions.digests import sha256
from stratalake.functions.personal import mask_email, mask_phone
from stratalake.operators.masking import mask_customers
from stratalake.operators.textscan import findings, findings_cued, redact, redact_output
from stratalake.settings import EMAIL_PATTERN, EMAIL_TAG, PHONE_PATTERN, PHONE_TAG, Site

SITE = Site("corp.example")

TEXTS = [
    "write to ana.ruiz@mail.example now",
    "ask crm@corp.example or UNKNOWN@CORP.EXAMPLE",
    "total 2,500,000 COP",
    "cel 300 123 45 67",
    "id 3001234567",
    "ana@mail.example.",
    "pedido cancelado 3001234567 y 573001234567",
    "a@b.co_m@x.org a@b.co, a@b.co",
    "móvil 300-123-45-67 / 30012345678901",
    "ñandú 😀 ana@mail.example 😀 tel 3001234567",
    "phone ١٢٣٤٥٦٧٨٩٠ and x3001234567",
    "mariana@x.example ana@x.example mariana@x.example",
    "ana@x.example mariana@x.example ana@x.example.co",
    "a@b.co@c.de b.co@c.de a@b.co",
    "cel 573001234567 3001234567 30012345678",
    "cel 3001234567 y 9993001234567123 y 300 123 45 67",
    "phone 300 1234567@mail.example 300 1234567",
    "cel 3001234567 3001234567 3009999999 crm@corp.example crm@corp.example.co",
    "cel 2024 300 123 4567 / 300 123 4567",
    "cel 300-123-4567 3001234567 ana@x.example x3001234567x",
    "",
    None,
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def python_findings(text, positions):
    if not text:
        return []
    safe = {SITE.missing_email} if positions else set(SITE.safe_emails)
    found = [("email", m.group(), m.start()) for m in re.finditer(EMAIL_PATTERN, text) if m.group().lower() not in safe]
    if positions or re.search("telefono|phone|cel|móvil", text.lower()):
        found += [("phone", m.group(), m.start()) for m in re.finditer(PHONE_PATTERN, text)]
    return found


def test_findings_with_positions(texts):
    want = sorted((i, *hit) for i, text in enumerate(TEXTS) for hit in python_findings(text, True))
    assert sorted(tuple(r) for r in findings(texts, ["id"], "text", SITE).collect()) == want


def test_findings_with_cue(texts):
    want = sorted((i, *hit[:2]) for i, text in enumerate(TEXTS) for hit in python_findings(text, False))
    assert sorted(tuple(r) for r in findings_cued(texts, ["id"], "text", SITE).collect()) == want


def test_redact_everything(texts):
    got = {r.id: r.text for r in redact(texts, "text").collect()}
    for i, text in enumerate(TEXTS):
        want = text and re.sub(PHONE_PATTERN, PHONE_TAG, re.sub(EMAIL_PATTERN, EMAIL_TAG, text))
        assert got[i] == want


def test_redact_what_was_found(texts):
    got = {r.id: (r.text, r.pii_found) for r in redact_output(texts, "text", site=SITE).collect()}
    for i, text in enumerate(TEXTS):
        want, hits = text, python_findings(text, False)
        for kind, value, _ in hits:
            want = want.replace(value, EMAIL_TAG if kind == "email" else PHONE_TAG)
        assert got[i] == (want, bool(hits))


def test_whole_documents_against_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", F.concat("text", F.lit(" 300 1234567 x@y.example "), "text").alias("text"))
    want = sorted((r.doc_id, *hit) for r in docs.collect() for hit in python_findings(r.text, True))
    assert sorted(tuple(r) for r in findings(docs, ["doc_id"], "text", SITE).collect()) == want


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@mail.example 30012345{i % 90 + 10}" for i in range(2000))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert sorted(tuple(r)[1:] for r in findings(df, ["id"], "text", SITE).collect()) == sorted(python_findings(text, True))


def test_phone_masks(spark):
    df = spark.createDataFrame([("+57 300 123 4567",), ("12",), (None,), ("N/A",), ("",)], "p string")
    assert [r[0] for r in df.select(mask_phone(F.col("p"))).collect()] == ["****4567", "****", None, "****", "****"]


def test_hash_leaves_blank_and_placeholder(spark):
    df = spark.createDataFrame([("ana@mail.example",), (SITE.missing_email,), (None,), ("  ",), ("",)], "v string")
    digest = hashlib.sha256(b"ana@mail.example").hexdigest()
    assert [r[0] for r in df.select(mask_email(F.col("v"), SITE)).collect()] == [
        digest, SITE.missing_email, None, "  ", ""]
    assert df.select(sha256(F.col("v"))).first()[0] == digest


def test_masked_customers_keep_rows_and_hide_values(spark):
    people = [(i, f"N{i}", f"A{i}", f"n{i}@mail.example", f"+57 300 000 {i:04d}", "2024-01-01") for i in range(50)]
    df = spark.createDataFrame(
        people, "cliente_id int, nombre string, apellido string, email string, telefono string, fecha_consentimiento string")
    masked = mask_customers(df, SITE).collect()
    assert len(masked) == 50
    shown = {str(v) for r in masked for v in r}
    assert not shown & {str(v) for p in people for v in p[1:5]}
    assert {r.fecha_consentimiento for r in masked} == {"2024-01-01"}


def test_running_totals(spark):
    from stratalake.functions.scalars import running_totals

    rows = [(list(range(n)),) for n in (0, 1, 2, 3, 7, 8, 9, 100)] + [(None,)]
    got = spark.createDataFrame(rows, "a array<int>").select("a", running_totals(F.col("a")).alias("s")).collect()
    for r in got:
        assert r.s == (None if r.a is None else [sum(r.a[: k + 1]) for k in range(len(r.a))])


def test_random_texts_are_redacted_value_after_value(spark):
    import random

    rng = random.Random(6)
    words = ["ana@x.example", "mariana@x.example", "ana@x.example.co", "a@b.co@c.de", "b.co@c.de", "crm@corp.example", "CRM@Corp.example", "cel", "3001234567",
             "300 123 45 67", "573001234567", "30012345678", "x3001234567", "9993001234567123", "-", ".", "67", "y", "u1@m.example", "u2@m.example", "_", "+"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "", "-", "."]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    for r in redact_output(df, "text", site=SITE).collect():
        want, hits = texts[r.id], python_findings(texts[r.id], False)
        for kind, value, _ in hits:
            want = want.replace(value, EMAIL_TAG if kind == "email" else PHONE_TAG)
        assert (r.text, r.pii_found) == (want, bool(hits)), texts[r.id]


def test_fifty_thousand_matches_end_in_seconds(spark):
    import time

    text = " ".join(f"user.{i:05d}@mail.example cel 300{i:07d}" for i in range(25_000))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    begin = time.perf_counter()
    places = {r.value: r.position for r in findings(df, ["id"], "text", SITE).collect()}
    redacted = redact_output(df, "text", site=SITE).first()
    assert time.perf_counter() - begin < 30
    assert len(places) == 50_000 and all(text.startswith(v, p) for v, p in places.items())
    assert redacted.text == " ".join([f"{EMAIL_TAG} cel {PHONE_TAG}"] * 25_000) and redacted.pii_found
