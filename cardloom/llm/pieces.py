"""Vectorised pre-tokenisation and a bounded table of piece encodings.

Byte-level BPE never merges across pieces, the matches of the splitting pattern.  Texts repeat their
pieces, so a batch is split with array operations, each distinct piece is encoded once by whatever
encoder the caller names, and the ids of the texts are gathered from the table.

Keys of 64 bits find a piece in the table; its bytes are then compared, so equal keys alone decide nothing.
Long texts are handled in segments of about CHUNK bytes, so besides the text and its ids a worker holds
arrays of a few times that size, however long the text is.  (A single piece, such as a run of letters
without end, goes to the encoder whole.)
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points with the Unicode property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Bytes of text handled at a time; a longer text makes a chunk of its own, which is cut into segments.
CHUNK = 2 << 20
#: Bytes (or words) over which a hash rolls before it starts anew.
STEP = 1 << 17
#: The table keeps no piece of more bytes, and is emptied when it holds so many ids, or bytes of pieces.
KEEP, MOST_IDS, MOST_BYTES = 1024, 1 << 23, 1 << 25
#: Longer pieces are keyed by a cryptographic digest instead of the rolling hash.
LONG = 64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


@cache
def classes() -> np.ndarray:
    """Class of each code point."""
    first = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


@cache
def byte_values(salt: int = 0) -> np.ndarray:
    name = b"piece %d" if not salt else b"piece %%d, %d" % salt
    digest = b"".join(hashlib.sha256(name % i).digest()[:8] for i in range(256))
    return np.frombuffer(digest, np.uint64).copy()


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1, modulo 2**64."""
    made = []
    for x in (BASE, INVERSE):
        a = np.full(n, x, np.uint64)
        a[0] = 1
        made.append(np.multiply.accumulate(a))
    return made[0], made[1]


def rolling(values: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """A hash of values[s : s + size] for each s in start (ascending)."""
    out = np.empty(len(start), np.uint64)
    size = np.broadcast_to(size, len(start))
    up, down = powers(STEP + (1 << int(size.max(initial=LONG)).bit_length()))
    a = 0
    while a < len(start):
        first = int(start[a])
        b = int(np.searchsorted(start, first + STEP))
        part = values[first : int((start[a:b] + size[a:b]).max())]
        rolled = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=rolled[1:])
        at = start[a:b] - first
        out[a:b] = (rolled[at + size[a:b]] - rolled[at]) * down[at]
        a = b
    return out


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = classes()
    out = table[:128][buf & 0x7F]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = buf[lead].astype(np.uint32)
        wide = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.uint8, copy=False)
        c1, c2, c3 = ((wide[lead + k] & 0x3F).astype(np.uint32) for k in (1, 2, 3))
        two, three = b < 0xE0, (b >= 0xE0) & (b < 0xF0)
        point = np.where(two, (b & 0x1F) << 6 | c1, np.where(three, (b & 0x0F) << 12 | c1 << 6 | c2, (b & 7) << 18 | c1 << 12 | c2 << 6 | c3))
        kind = table[np.minimum(point, 0x10FFFF)]
        out[lead] = kind
        for k, have in ((1, slice(None)), (2, ~two), (3, b >= 0xF0)):
            out[np.minimum(lead[have] + k, len(out) - 1)] = kind[have]
    return out


def piece_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the matches of the splitting pattern start, for texts buf[offsets[i]:offsets[i+1]]."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64)
    kind = byte_classes(buf)
    cut = np.zeros(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[n] = True
    cut |= edge
    runs = np.flatnonzero(cut)  # the last is n
    start, end = runs[:-1], runs[1:]
    of = kind[start]
    keep = cut.copy()
    # White space before other text leaves its last character: a space joins what follows, others stand alone.
    inner = (of == SPACE) & ~edge[end]
    stop = end[inner]
    last = stop - 1
    for _ in range(3):
        last = np.where((buf[last] & 0xC0) == 0x80, last - 1, last)
    keep[last] = True
    keep[stop[buf[last] == 0x20]] = False
    # Contractions: a lone apostrophe that no space precedes, with letters after it.
    lone = np.flatnonzero((of == OTHER) & (end - start == 1) & (buf[start] == 0x27) & keep[start] & ~edge[end])
    if len(lone):
        lone = lone[of[lone + 1] == LETTER]
        at, stop = end[lone], end[lone + 1]
        a = buf[at]
        b = np.where(at + 1 < stop, buf[np.minimum(at + 1, n - 1)], 0)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        size = np.where(one, 1, np.where(two, 2, 0))
        hit = size > 0
        keep[at[hit]] = False
        keep[(at + size)[hit]] = True
    return np.flatnonzero(keep[:n])


def piece_keys(buf: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit key of each piece, start ascending; each salt gives keys of its own."""
    size = end - start
    key = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):  # bytes are turned into values step by step
        b = int(np.searchsorted(start, start[a] + STEP))
        least = np.minimum(size[a:b], LONG)
        first = int(start[a])
        key[a:b] = rolling(byte_values(salt)[buf[first : int((start[a:b] + least).max())]], start[a:b] - first, least)
        a = b
    key ^= size.astype(np.uint64) << np.uint64(56)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    for i in np.flatnonzero(size > LONG):
        key[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([salt])).digest(), "little")
    key[key == 0] = 1  # 0 marks a free slot
    return key


class PieceTable:
    """Open-addressing table from piece key to code; forgets everything when it is full, so memory is bounded."""

    PROBES = 12

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros((1 << self.bits) + self.PROBES, np.uint64)
        self.codes = np.full((1 << self.bits) + self.PROBES, -1, np.int32)
        self.size = 0

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Codes, -1 for those not held."""
        at = self.slot(keys)
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for k in range(self.PROBES):
            held = self.keys[at[left] + k]
            hit = held == keys[left]
            out[left[hit]] = self.codes[at[left[hit]] + k]
            left = left[~hit & (held != 0)]
            if not len(left):
                break
        return out

    def add(self, keys: np.ndarray, codes: np.ndarray) -> None:
        """keys: distinct and not held.  A key that finds no slot is left out."""
        at, left = self.slot(keys), np.arange(len(keys))
        for k in range(self.PROBES):
            free = left[self.keys[at[left] + k] == 0]
            self.keys[at[free] + k] = keys[free]
            won = self.keys[at[free] + k] == keys[free]
            won = free[won]
            self.codes[at[won] + k] = codes[won]
            placed = np.zeros(len(keys), bool)
            placed[won] = True
            left = left[~placed[left]]
            if not len(left):
                break
        self.size += len(keys) - len(left)


class PieceEncoder:
    """encode_pieces takes distinct pieces as bytes and gives their ids.

    specials: strings that are cut out of a text before it is split into pieces; encode_pieces gets them whole.
    """

    def __init__(self, encode_pieces: Callable[[list[bytes]], list[list[int]]], bits: int = 21, specials: tuple[bytes, ...] = ()):
        self.encode_pieces, self.table = encode_pieces, PieceTable(bits)
        self.specials = re.compile(b"|".join(re.escape(x) for x in sorted(specials, key=len, reverse=True))) if specials else None
        self.forget()

    def forget(self) -> None:
        self.table.clear()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.raw, self.held = np.zeros(1 << 16, np.uint8), 0
        self.known = 0
        self.begin, self.count, self.at, self.size = (np.zeros(1 << 16, np.int32) for _ in range(4))

    def _grow(self, name: str, need: int) -> np.ndarray:
        a = getattr(self, name)
        if len(a) < need:
            a = np.concatenate([a, np.zeros(max(need - len(a), len(a) // 2), a.dtype)])
            setattr(self, name, a)
        return a

    def _same(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Whether each piece has the bytes that its code stands for."""
        same = self.size[codes] == size
        s, n, at = start[same], size[same], self.at[codes[same]].astype(np.int64)
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum()))
        differ = np.flatnonzero(self.raw[np.repeat(at - first, n) + step] != buf[np.repeat(s - first, n) + step])
        same[np.flatnonzero(same)[np.searchsorted(first, differ, "right") - 1]] = False
        return same

    def _encode(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """New codes for these pieces."""
        pieces = [buf[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        ids = self.encode_pieces(pieces)
        count, size = np.fromiter(map(len, ids), np.int64, len(ids)), end - start
        total, length = int(count.sum()), int(size.sum())
        self._grow("flat", self.used + total)[self.used : self.used + total] = np.fromiter((x for y in ids for x in y), np.uint32, total)
        self._grow("raw", self.held + length)[self.held : self.held + length] = np.frombuffer(b"".join(pieces), np.uint8)
        a, b = self.known, self.known + len(ids)
        for name, values in (("begin", self.used + np.cumsum(count) - count), ("count", count), ("at", self.held + np.cumsum(size) - size), ("size", size)):
            self._grow(name, b)[a:b] = values
        self.used, self.held, self.known = self.used + total, self.held + length, b
        return np.arange(a, b, dtype=np.int32)

    def codes(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The code of each piece, encoding those not held yet."""
        if self.table.size > 0.6 * (1 << self.table.bits) or self.used > MOST_IDS or self.held > MOST_BYTES:
            self.forget()
        keys, size = piece_keys(buf, start, end), end - start
        codes = self.table.find(keys)
        # Pieces that the table doesn't keep, or whose key is that of another piece, get codes for themselves.
        alone = size > KEEP
        known = np.flatnonzero((codes >= 0) & ~alone)
        alone[known[~self._same(buf, start[known], size[known], codes[known])]] = True
        miss = np.flatnonzero((codes < 0) & ~alone)
        if len(miss):
            new, first, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            fresh = self._encode(buf, start[miss[first]], end[miss[first]])
            self.table.add(new, fresh)
            codes[miss] = fresh[back]
            alone[miss[~self._same(buf, start[miss], size[miss], codes[miss])]] = True
        rest = np.flatnonzero(alone)
        if len(rest):
            codes[rest] = self._encode(buf, start[rest], end[rest])
        return codes

    def starts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pieces of the texts start, specials cut out first."""
        spans = []
        if self.specials is not None:
            data = buf.tobytes()
            if self.specials.search(data):
                bounds = offsets.tolist()
                spans = [m.span() for a, b in zip(bounds[:-1], bounds[1:], strict=True) for m in self.specials.finditer(data, a, b)]
        if not spans:
            return piece_starts(buf, offsets)
        first, last = np.array(spans, np.int64).T
        start = piece_starts(buf, np.unique(np.concatenate([offsets, first, last])))
        of = np.searchsorted(first, start, "right") - 1
        return start[(of < 0) | (start == first[of]) | (start >= last[of])]

    def coded(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all pieces of the texts, and where those of each text start and end."""
        start = self.starts(buf, offsets)
        codes = self.codes(buf, start, np.append(start[1:], len(buf))) if len(start) else np.empty(0, np.int32)
        return codes, np.searchsorted(start, offsets)

    def gathered(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these codes, and where those of each start and end."""
        count = self.count[codes].astype(np.int64)
        bound = np.concatenate([[0], np.cumsum(count)])
        return self.flat[np.repeat(self.begin[codes] - bound[:-1], count) + np.arange(bound[-1])], bound

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where the ids of each text start and end."""
        if len(offsets) == 2 and len(buf) > 2 * CHUNK:
            parts = [self.gathered(self.coded(buf[a:b], np.array([0, b - a]))[0])[0] for a, b in segments(buf)]
            flat = np.concatenate(parts)
            return flat, np.array([0, len(flat)])
        codes, pieces = self.coded(buf, offsets)
        flat, bound = self.gathered(codes)
        return flat, bound[pieces]


LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def segments(buf: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of a long text, each but the last of at least `size` bytes, that no piece and no special string crosses.

    A cut is before a space between two ASCII letters, where a piece always starts; text without such a
    place stays in one range.
    """
    a, n = 0, len(buf)
    while a < n:
        b, at = n, a + size
        while at < n - 1:
            part = buf[at - 1 : at + (1 << 16)]
            hit = np.flatnonzero((part[1:-1] == 0x20) & LETTERS[part[:-2]] & LETTERS[part[2:]])
            if len(hit):
                b = at + int(hit[0])
                break
            at += len(part) - 2
        yield a, b
        a = b


def text_chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of texts; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, bounds, data = texts.buffers()
    offsets = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


@cache
def byte_letters() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + rest.index(b)) for b in range(256)]


def locate(name: str) -> str:
    """The place of a tokenizer file on this machine: a path as it stands, a bare name among the public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def library_encoder(name: str, bits: int = 21, specials: bool = True) -> PieceEncoder:
    """Distinct pieces go through the tokenizers library's model; kept for the life of a Python worker.

    specials: added tokens of the file are cut out of texts first, as the library does; else they are plain text.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(locate(name))
    model, added = tokenizer.model, tokenizer.get_added_tokens_decoder() if specials else {}
    if any(t.lstrip or t.rstrip or t.single_word or " " in t.content for t in added.values()):
        raise ValueError("an added token that takes in its neighbours, or holds a space")
    letters, special = dict(enumerate(byte_letters())), {t.content.encode(): i for i, t in added.items()}

    def encode(pieces: list[bytes]) -> list[list[int]]:
        return [[special[p]] if p in special else [t.id for t in model.tokenize(p.decode("latin-1").translate(letters))] for p in pieces]

    return PieceEncoder(encode, bits, tuple(special))
