import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from stratalake.llm.exact_dedup import Entry, Table, distinct, drop_copies, exact_groups

SCHEMA = pa.schema([("key", pa.string()), ("text", pa.string()), ("rows", pa.int64()), ("top", pa.int64()), ("ties", pa.int64()), ("rest", pa.string())])


def expected(rows):
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = by[t or ""]
        top = max((x for x in ids if x is not None), default=None)
        out.append((i, top, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def check(df, rows):
    got = df.collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == expected(rows)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(exact_groups(odd_docs), rows)


def test_texts_that_share_a_key_are_told_apart(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(exact_groups(odd_docs, key=F.length(F.coalesce("text", F.lit(""))).cast("string")), rows)


def test_one_group_with_a_third_of_the_rows(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"text {k % 400}") for k in range(3000)]
    check(exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)), rows)


def test_spills_when_the_budget_is_small():
    entries = [Entry(str(k % 500), f"text {k % 500}".encode() * 5, 1, k, 1, None) for k in range(2000)]
    hashed = [(hash(e.text) & (1 << 64) - 1, e) for e in entries]
    got = {e.key: (e.rows, e.top) for e in distinct(iter(hashed), SCHEMA, budget=3000)}
    assert got == {str(k): (4, 1500 + k) for k in range(500)}


def test_equal_hashes_never_end_the_recursion():
    entries = [(7, Entry(str(k), f"text {k}".encode(), 1, k, 1, None)) for k in range(200)]
    assert len(list(distinct(iter(entries), SCHEMA, budget=500))) == 200


def test_table_compares_contents():
    table = Table()
    for text in (b"a", b"b", b"a"):
        table.add(1, Entry("k", text, 1, 0, 1, None))
    assert sorted((e.text, e.rows) for _, e in table.items()) == [(b"a", 2), (b"b", 1)]


def test_drop_copies_keeps_all_columns(odd_docs):
    out = drop_copies(odd_docs)
    assert out.columns == odd_docs.columns
    got = out.collect()
    texts = [r.text or "" for r in got]
    assert sorted(texts) == sorted({r.text or "" for r in odd_docs.collect()})
    assert next(r.doc_id for r in got if (r.text or "") == "") == 99


def test_empty(no_docs):
    assert exact_groups(no_docs).count() == 0
    assert drop_copies(no_docs).count() == 0
