import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalake.llm import middle
from stratalake.llm.middle import ArrayContainer, BitmapContainer, BoundarySet, RunContainer, container, cut_places, middle_last, restored


def plainly(doc_id, text):
    """(n, form, prefix, middle, suffix, output) by the rule, on code points."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("places, kind", [
    (np.arange(0, 65536), RunContainer), (np.arange(5, 60000, 3), BitmapContainer), (np.arange(0, 60000, 40), ArrayContainer),
    (np.concatenate((np.arange(10, 3000), np.arange(4000, 9000))), RunContainer), (np.array([65535]), ArrayContainer)])
def test_containers_select(places, kind):
    held = container(places)
    assert isinstance(held, kind)
    assert (held.select(np.arange(len(places))) == places).all()


def test_set_over_many_containers():
    rng = np.random.default_rng(1)
    places = np.unique(np.concatenate([
        rng.choice(65536, 900, replace=False), 65536 + np.arange(65536), 5 * 65536 + rng.choice(65536, 30000, replace=False), [9 * 65536]]))
    ranks = rng.permutation(len(places))
    flags = np.zeros(10 * 65536, bool)
    flags[places] = True
    held = BoundarySet(flags)
    assert {type(c) for c in held.containers} == {ArrayContainer, RunContainer, BitmapContainer, type(None)}
    assert (held.select(ranks) == places[ranks]).all()


@pytest.mark.parametrize("unit, split", [
    ("char", lambda t: list(t)), ("line", lambda t: t.splitlines(keepends=True)),
    ("word", lambda t: [w for w in middle.re.findall(r"^\s*\S*\s*|\S+\s*", t) if w])])
def test_units(unit, split):
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("aé日🙂 \n"), k)) for k in rng.integers(0, 300, 200)] + ["", "x" * 200_000, "日本" * 90_000, " lead", "\n", "a  b "]
    one, other = rng.integers(0, 2**32, (2, len(texts)))
    n, first, second = cut_places(pa.array(texts), one, other, unit)
    for t, k, a, b, x, y in zip(texts, n, first, second, one, other):
        units = split(t)
        assert k == len(units)
        low, high = sorted((x % (k + 1), y % (k + 1)))
        assert (a, b) == (len("".join(units[:low]).encode()), len("".join(units[:high]).encode()))


def test_against_the_rule(spark):
    texts = ["", None, "a", "<P> x", "<<S>", "x<M", "end <", "é🙂 日本語", "long " * 30_000, "same", "same"]
    rows = [(k, texts[k % len(texts)]) for k in range(600)] + [(None, "no id"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = middle_last(docs).withColumn("back", restored(F.col("form"), F.col("output")))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix, r.middle, r.suffix, r.output, r.back) for r in out.collect()), key=repr)
    assert got == sorted(((k, *plainly(k, t), t or "") for k, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_odd_rows(odd_docs, no_docs):
    out = middle_last(odd_docs.withColumn("n", F.lit(1)).withColumn("form", F.lit("x")))
    assert sorted(((r.doc_id, r.output) for r in out.collect()), key=repr) == sorted(
        ((r.doc_id, plainly(r.doc_id, r.text)[-1]) for r in odd_docs.collect()), key=repr)
    assert middle_last(no_docs).count() == 0
