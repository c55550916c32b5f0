"""Encoding with public tokenizers: texts are cut where no token can reach across, and each distinct piece
is encoded once by the library while it stays in the task's cache.

Where a cut is safe:

- word BPE (white space is dropped): at every space. Its pattern has no white space in a token, and neither
  normalisation nor lower-casing looks across a space. Long pieces without a space are also cut between a Han or
  Kana letter and the sentence mark beside it: letters and marks are apart in the pattern, and neither composes
  with the other. A mark after ASCII letters is counted apart from them for the same reason; after other letters it
  is not, since lower-casing one may leave a combining mark at the end (as in Turkish), which joins the next mark.
- byte-level BPE: before a single space that stands between two other characters. All its tokens with an
  inner or trailing space consist of white space alone, and the piece before such a space ends in none.

Special strings hold no space, so a cut never breaks one.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

PIECE_BYTES = 1 << 20
CACHED = 600_000
LONGEST_CACHED = 64
#: White space other than the single space; the pairs are those a cut must not be made in.
ASCII_SPACE = "\t\n\v\f\r\x1c\x1d\x1e\x1f "
MARKS = frozenset(".,;:!?")
ODD_PAIRS = [pair for c in ASCII_SPACE for pair in (c + " ", " " + c)]
OTHER_SPACE = [c for c in map(chr, range(0x80, 0x3001)) if c.isspace()]
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Between a Han or Kana letter and a sentence mark.
SENTENCE = re.compile("(?<=[\u4e00-\u9fff\u3041-\u3096\u30a1-\u30fa])(?=[。、！？])|(?<=[。、！？])(?=[\u4e00-\u9fff\u3041-\u3096\u30a1-\u30fa])")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class Pieces(dict):
    """Piece -> what `value` makes of the ids of `prefix` + piece. Bounded: when full, it becomes the older half
    and is begun anew; what is found in the older half is taken over."""

    def __init__(self, path: str, prefix: str, value: Callable, plain: Callable[[str], str] | None = None, apart: Callable[[str], bool] = str.isalpha):
        """plain: what the library's splitter makes of a piece of ASCII letters, a single word, if these may go to its model
        at once. apart: letters whose following mark is a token of its own."""
        super().__init__()
        self.path, self.prefix, self.value, self.plain, self.apart, self.older = path, prefix, value, plain, apart, {}
        self.marks = {m: value(tokenizer(path).encode(m, add_special_tokens=False).ids) for m in MARKS}

    def encode(self, pieces: list[str]) -> dict[str, object]:
        """Encode distinct pieces in batches balanced by bytes; with `plain`, words of ASCII letters by the library's
        model at once."""
        model, begin, out = tokenizer(self.path), 0, {}
        if self.plain:
            word = model.model.tokenize
            out = {p: self.value([t.id for t in word(self.plain(p))]) for p in pieces if p.isascii() and p.isalpha()}
            pieces = [p for p in pieces if p not in out]
        sizes = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in pieces])
        while begin < len(pieces):
            end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + PIECE_BYTES)))
            batch = pieces[begin:end]
            full = [self.prefix + p for p in batch] if self.prefix else batch
            out.update(zip(batch, (self.value(e.ids) for e in model.encode_batch_fast(full, add_special_tokens=False))))
            begin = end
        return out

    def learn(self, pieces: set[str]) -> dict[str, object]:
        """Values of new pieces. Where a mark after letters is a token of its own, the piece is its letters' value and
        the mark's, and the letters are often known."""
        marked = [(p, p[:-1]) for p in pieces if p[-1:] in MARKS and self.apart(p[:-1])]
        plain = pieces.difference(p for p, _ in marked)
        stems = {stem: self.get(stem, self.older.get(stem)) for _, stem in marked}
        new = self.encode(list(plain.union(stem for stem, v in stems.items() if v is None)))
        new |= {p: (new[stem] if stems[stem] is None else stems[stem]) + self.marks[p[-1]] for p, stem in marked}
        return new

    def values(self, texts: list[list[str]]) -> list[list]:
        """The values of each text's pieces."""
        out = [list(map(self.get, pieces)) for pieces in texts]
        gaps = [k for k, values in enumerate(out) if None in values]
        if gaps:
            gap = {p for k in gaps for p, v in zip(texts[k], out[k]) if v is None}
            new = {p: self.older[p] for p in gap if p in self.older}
            new |= self.learn(gap.difference(new))
            for k in gaps:
                out[k] = [new[p] if v is None else v for p, v in zip(texts[k], out[k])]
            if len(self) + len(new) > CACHED:
                self.older = dict(self)
                self.clear()
            self.update((p, v) for p, v in new.items() if len(p) <= LONGEST_CACHED)
        return out


def _ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _after_space(word: str) -> str:
    return "\u0120" + word  # how the byte-level splitter writes the space


@lru_cache(maxsize=8)
def _pieces(path: str, prefix: str, value: Callable, plain: Callable[[str], str] | None = None, apart: Callable[[str], bool] = str.isalpha) -> Pieces:
    # the library's own threads would compete with the other tasks of the executor
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Pieces(path, prefix, value, plain, apart)


def _ascii_letters(text: str) -> bool:
    return text.isascii() and text.isalpha()


def cut_words(text: str) -> list[str]:
    """Pieces for the word BPE."""
    pieces = text.split(" ")
    if text.isascii() or max(map(len, pieces)) <= LONGEST_CACHED:
        return pieces
    return [part for piece in pieces for part in (SENTENCE.split(piece) if len(piece) > LONGEST_CACHED else (piece,))]


def cut_bytes(text: str) -> list[str]:
    """Pieces for the byte-level BPE; all but the first lack the space they begin with."""
    odd = text[:1] == " " or text[-1:] == " " or any(p in text for p in ODD_PAIRS) or not text.isascii() and any(c in text for c in OTHER_SPACE)
    return CUT.split(text) if odd else text.split(" ")


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size > 2 * PIECE_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def counts(path: str, texts: pa.Array) -> list[int]:
    """Tokens of each text under a word BPE file."""
    known = _pieces(path, "", len, apart=_ascii_letters)
    return [sum(v) for group in _groups(texts.fill_null("").to_pylist()) for v in known.values([cut_words(t) for t in group])]


def encoded(path: str, texts: pa.Array) -> Iterator[bytes]:
    """Ids of each text under a byte-level BPE file, as little-endian unsigned 32-bit integers."""
    first, later = _pieces(path, "", _ids, str), _pieces(path, " ", _ids, _after_space)
    for group in _groups(texts.fill_null("").to_pylist()):
        cut = [cut_bytes(t) for t in group]
        heads = first.values([pieces[:1] for pieces in cut])
        for head, tail in zip(heads, later.values([pieces[1:] for pieces in cut])):
            yield b"".join(head + tail)
