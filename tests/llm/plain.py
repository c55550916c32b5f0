"""The pipeline's stages on lists of (id, text), one pair of texts at a time."""

from tests.llm.test_decontaminate import brute
from tests.llm.test_jaccard_join import expected


def exact(rows):
    last = {}
    for k, t in rows:
        last[t] = max(k, last.get(t, k))
    return [(k, t) for k, t in rows if last[t] == k]


def near(rows):
    first = {k: c for k, c, _ in expected(rows)}
    return [(k, t) for k, t in rows if first[k] == k]


def decontaminated(rows, items):
    hit = {k for k, _ in brute(rows, list(enumerate(items)))}
    return [(k, t) for k, t in rows if k not in hit]
