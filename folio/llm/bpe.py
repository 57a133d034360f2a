"""Token ids of whole groups of texts: numpy splits them into the pieces that the vocabulary's pattern names, the
tokenizer encodes each distinct piece once, and ids are gathered back. Texts with characters beyond U+024F, control
characters U+001C to U+001F or a special token's string go through the tokenizer as they are. Pieces are told apart by their
own bytes."""

from __future__ import annotations

import json
import unicodedata
from functools import cached_property

import numpy as np
import pyarrow as pa

_LIMIT = 0x250
#: Fixed value: the special token of the vocabulary.
SPECIAL = "<|endoftext|>"
OTHER, LETTER, NUMBER, SPACE = range(4)
_KIND = np.array([LETTER if (c := unicodedata.category(chr(i)))[0] == "L" else NUMBER if c[0] == "N" else SPACE if chr(i).isspace() and not 0x1C <= i <= 0x1F else OTHER for i in range(_LIMIT)], np.uint8)
#: What may follow an apostrophe as one piece, in the pattern's order.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def split(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the pieces of the texts between bounds (code points below the limit)."""
    n = len(cp)
    kind = _KIND[cp]
    begin = np.zeros(n + 1, bool)
    begin[bounds] = True
    run = begin.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    run[n] = True
    starts = run[:n].copy()
    # white space: the last character of a run goes to the next piece if it's a blank, else stands alone; at a text's end the run is one piece
    at = np.flatnonzero(run)
    a, b = at[:-1], at[1:]
    ws = kind[a] == SPACE
    a, b = a[ws], b[ws]
    inner = ~begin[b]
    a, b = a[inner], b[inner]
    starts[b - 1] = True
    blank = cp[b - 1] == 32
    starts[b[blank]] = False
    # contractions: an apostrophe that starts a piece of its own, and the letters after it
    quote = np.flatnonzero((cp == 39) & starts)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~begin[quote + 1]]
    for i in quote.tolist():
        one = chr(cp[i + 1])
        two = one + chr(cp[i + 2]) if i + 2 < n and kind[i + 2] == LETTER and not begin[i + 2] else one
        for c in CONTRACTIONS:
            if c == one or c == two:
                starts[i + 1] = False
                end = i + 1 + len(c)
                if end < n:
                    starts[end] = True
                break
    return np.flatnonzero(starts)


def _pieces(path: str):
    """Encodes one piece: tiktoken's core over the same file's vocabulary, whose ids are in order of its merges; ten times
    as fast as a call of the tokenizer for each piece, and held against it in the tests."""
    import tiktoken

    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token != SPECIAL}
    return tiktoken.Encoding("pieces", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


class Encoder:
    """One per worker; the distinct pieces' ids are kept, up to `most` pieces."""

    def __init__(self, vocabulary: str | None = None, most: int = 100_000):
        import public_tokenizers

        self.path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        self.piece = _pieces(self.path)
        self.most = most
        self._clear()

    @cached_property
    def tokenizer(self):
        """Loaded for the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, pieces: list[bytes]) -> None:
        got = [self.piece(p) for p in pieces]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum()))
        at = len(self.ids) + np.cumsum(sizes) - sizes
        self.known |= {p: len(self.known) + k for k, p in enumerate(pieces)}
        self.ids, self.at, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.at, at]), np.concatenate([self.sizes, sizes])

    def encode(self, texts: list[str], part: int = 1_000_000) -> list[np.ndarray]:
        """Each text's ids; some `part` characters are worked on at a time, or one longer text."""
        out, own, size = [], [], 0
        for t in texts:
            own.append(t)
            size += len(t)
            if size > part:
                out += self._encode(own)
                own, size = [], 0
        return out + self._encode(own)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        bounds = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)].astype(np.int64)
        odd = set((np.searchsorted(bounds, np.flatnonzero((cp >= _LIMIT) | ((cp >= 0x1C) & (cp <= 0x1F))), side="right") - 1).tolist())
        for i, t in enumerate(texts):
            if i in odd or SPECIAL in t:
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                plain.append(i)
        whole = "".join(texts[i] for i in plain)
        bounds = np.r_[0, np.cumsum([len(texts[i]) for i in plain], dtype=np.int64)].astype(np.int64)
        if not whole:
            for i in plain:
                out[i] = np.zeros(0, np.uint32)
            return out
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        starts = split(cp, bounds)
        at = np.r_[0, np.cumsum(1 + (cp >= 0x80))].astype(np.int64)  # of each character among the bytes
        data = pa.py_buffer(whole.encode())
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at[np.r_[starts, len(cp)]]), data]).dictionary_encode()
        distinct, back = pieces.dictionary.to_pylist(), np.asarray(pieces.indices)
        if len(self.known) + len(distinct) > self.most:
            self._clear()
        if new := [p for p in distinct if p not in self.known]:
            self._learn(new)
        where = np.fromiter((self.known[p] for p in distinct), np.int64, len(distinct))
        at, sizes = self.at[where][back], self.sizes[where][back]
        total = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        ids = self.ids[np.repeat(at - total[:-1], sizes) + np.arange(total[-1])]
        cuts = total[np.searchsorted(starts, bounds)]
        for k, i in enumerate(plain):
            out[i] = ids[cuts[k] : cuts[k + 1]]
        return out


_encoders: dict[str | None, Encoder] = {}


def encoder(vocabulary: str | None = None) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
