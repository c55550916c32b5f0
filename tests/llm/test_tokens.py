import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stratalake.llm import tokens
from stratalake.llm.token_counts import token_counts
from stratalake.llm.token_files import Segment, pack, token_files

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
HARD = ["<|endoftext|> a <|endoftext|>b  c", "  x \n y", "it's  don't 'll x y ́ z", " lead", "trail ", "", " ", "a\x1c b \x1c c",
        "ΣΑΣ, ΣΑΣ. Σ! ας", "BELEDİYESİ, SİVASİ. Lİ!", "が゙、か゚。" * 40, "日本語。テスト、" * 200 + "か\u3099。\u3099" * 30, "a b   c", "tab\t tab \tx", "1234 5,6. x?", "é É e ́", "日本語。 テスト", "\r\n a\r\n", "x." * 50, "ab.\ncd ef."]


def whole(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", HARD)
def test_cut_texts_give_the_library_ids(text):
    assert tokens.counts(WORDS, pa.array([text])) == [len(whole(WORDS, text))]
    assert list(tokens.encoded(BYTES, pa.array([text]))) == [np.array(whole(BYTES, text), "<u4").tobytes()]


def test_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 3)
    texts = [f"word{k} and word{k + 1}, x" for k in range(50)] * 2
    assert tokens.counts(WORDS, pa.array(texts)) == [len(whole(WORDS, t)) for t in texts]


def test_counts(odd_docs, no_docs):
    got = token_counts(odd_docs, WORDS, limit=100).collect()
    rows = odd_docs.collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == sorted(
        ((r.doc_id, len((r.text or "").encode()), len(whole(WORDS, r.text or ""))) for r in rows), key=repr)
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts(no_docs, WORDS).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_segment_round_trip(n):
    rng = np.random.default_rng(n)
    values = (rng.integers(0, 2**32, n) >> rng.integers(0, 33, n)).astype(np.uint32)
    segment = Segment(pack(values))
    assert (segment.read() == values).all()
    if n > 256:
        assert (segment.read(1, 2) == values[128:256]).all()


def test_outliers_are_patched_and_make_blocks_small():
    values = np.arange(128, dtype=np.uint32) % 7 + 1000
    plain = len(pack(values))
    values[5] = 1 << 31
    assert len(pack(values)) <= plain + 5
    assert (Segment(pack(values)).read() == values).all()


def test_files(odd_docs, no_docs):
    got = sorted(token_files(odd_docs, BYTES).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda k: (k is not None, k or 0))
    start = 0
    texts = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for row, (doc, text) in zip(got, texts):
        tokens_ = np.array([*whole(BYTES, text), 0], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc, start, len(tokens_), zlib.crc32(tokens_.tobytes()))
        start += len(tokens_)
    assert len(got) == len(texts)
    assert token_files(no_docs, BYTES).count() == 0


def random_texts(seed, n):
    """Words over letters with long lower case, marks, digits, special strings and every white space."""
    rng = np.random.default_rng(seed)
    letters = list("abcXYZİıẞßΣσςéÉ日語がカ한글ḱⱠǅﬁ") + ["i\u0307", "e\u0301", "\u3099", "\u0345"]
    marks = list(".,;:!?'\"-()。、！？…") + ["'s", "'ll", "<|endoftext|>", "<|startoftext|>", "12", "½", "①", "🙂", "\u0300"]
    spaces = [" "] * 12 + [c for c in map(chr, range(0x3001)) if c.isspace()] + ["\x1c", "  ", "\r\n", "\u200b", "\ufeff"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(1, 12)):
            parts.append("".join(rng.choice(letters, rng.integers(0, 6))) + "".join(rng.choice(marks, rng.integers(0, 3))))
            parts.append(rng.choice(spaces) if rng.random() < 0.8 else "")
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_against_the_library(seed):
    texts = random_texts(seed, 5000) + ["".join(random_texts(seed + 100, 300)).replace(" ", "")]
    words, pieces = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    expected = [len(e.ids) for e in words.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, a, b in zip(texts, tokens.counts(WORDS, pa.array(texts)), expected) if a != b]
    assert not wrong, wrong[:3]
    expected = [np.array(e.ids, "<u4").tobytes() for e in pieces.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, a, b in zip(texts, tokens.encoded(BYTES, pa.array(texts)), expected) if a != b]
    assert not wrong, wrong[:3]
