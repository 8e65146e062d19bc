"""Splits texts in pre-tokens as the byte-level BPE pattern does, over flat code-point arrays.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Its matches
are runs of one character class with three adjustments, each of which is a vector operation on run
borders; no regular expression engine runs.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np

from foliant.llm.spans import SpanIndex, span_hashes

#: The characters with the Unicode property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


def borders(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Starts of all pre-tokens. points: code points of all texts, end to end; doc_starts: where texts begin."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[doc_starts[doc_starts < n]] = True
    first[n] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    begins = np.flatnonzero(start)
    a, b = begins[:-1], begins[1:]
    # a run of white space that a text goes on after: its last character stands alone or leads the next run
    runs = (kind[a] == SPACE) & ~first[b]
    sa, sb = a[runs], b[runs]
    start[sb - 1] = True
    leads = points[sb - 1] == 0x20
    joined = sb[leads]
    start[joined] = False
    # a lone apostrophe that begins a pre-token takes the letters of a contraction
    lone = (b - a == 1) & (points[a] == 0x27) & ~first[b]
    p = a[lone]
    p = p[start[p]]
    if len(p):
        p = p[kind[p + 1] == LETTER]
        one = points[p + 1]
        more = (p + 2 < n) & ~first[np.minimum(p + 2, n)]
        two = np.where(more, points[np.minimum(p + 2, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        k = np.where(single, 1, np.where(double, 2, 0))
        p, k = p[k > 0], k[k > 0]
        start[p + 1] = False
        rest = p + 1 + k
        inside = rest[(rest < n)]
        inside = inside[~first[inside]]
        start[inside] |= kind[inside] == LETTER
    return np.flatnonzero(start[:n])


def split(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts end to end, as a string and as code points; borders of all pre-tokens (the last ends the
    last one); and the number of pre-tokens before each text (and after the last)."""
    flat = "".join(texts)
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)
    starts = borders(points, ends[:-1])
    return flat, points, np.append(starts, len(points)), np.searchsorted(starts, ends)


class WordCache:
    """Token ids of distinct pre-tokens, kept between batches up to a number of entries and of characters of long ones.

    Pre-tokens are told apart by two 64-bit hashes and their length; those of over HASHED characters by
    their text.
    """

    HASHED, LONG_CHARS = 200, 1 << 22

    def __init__(self, encode, limit: int = 500_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index, self.long, self.long_chars = SpanIndex(), {}, 0
        self.flat, self.offsets, self.n = np.empty(1 << 20, np.uint16), np.zeros(1 << 17, np.int64), 0

    def _add(self, words: list[str]) -> None:
        ids, lengths = self.encode(words)
        used, n = int(self.offsets[self.n]), self.n + len(words)
        if len(ids) and ids.max() > 65_535 and self.flat.dtype == np.uint16:
            self.flat = self.flat.astype(np.uint32)
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat) + len(ids), self.flat.dtype)])
        if n >= len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros(n, np.int64)])
        self.flat[used : used + len(ids)] = ids
        self.offsets[self.n + 1 : n + 1] = used + np.cumsum(lengths)
        self.n = n

    def codes(self, flat: str, points: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Dense codes of all pre-tokens; those not yet known are encoded together."""
        if self.n > self.limit or self.long_chars > self.LONG_CHARS:
            self.clear()
        starts, ends = borders[:-1], borders[1:]
        k1, k2 = span_hashes(points, starts, ends)
        codes = np.empty(len(starts), np.int64)
        short = ends - starts <= self.HASHED
        if self.long or not short.all():
            far = np.flatnonzero(~short)
            words = [flat[i:j] for i, j in zip(starts[far].tolist(), ends[far].tolist())]
            new = [w for w in dict.fromkeys(words) if w not in self.long]
            self.long.update(zip(new, range(self.n, self.n + len(new))))
            if new:
                self._add(new)
                self.long_chars += sum(map(len, new))
            codes[far] = [self.long[w] for w in words]
        near = np.flatnonzero(short)
        got = self.index.find(k1[near], k2[near])
        lost = np.flatnonzero(got < 0)
        if len(lost):
            at = near[lost]
            _, one, back = np.unique(k1[at] ^ (k2[at] << np.uint64(1)), return_index=True, return_inverse=True)
            one = at[one]
            self.index.n = self.n
            self.index.add(k1[one], k2[one])
            got[lost] = self.n + back
            self._add([flat[i:j] for i, j in zip(starts[one].tolist(), ends[one].tolist())])
        codes[near] = got
        return codes

    def ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of coded words end to end, and the number of ids before each word (and after the last)."""
        first = self.offsets[codes]
        lengths = self.offsets[codes + 1] - first
        before = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(lengths, out=before[1:])
        where = np.repeat(first - before[:-1], lengths)
        where += np.arange(before[-1])
        return self.flat[where], before


_CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str, span: int):
    """A long text in pieces of about ``span`` characters, cut before a lone blank, where a pre-token always begins."""
    at = 0
    while len(text) - at > span:
        cut = _CUT.search(text, at + span)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_texts(texts: list[str], cache: WordCache, span: int = 1 << 19):
    """Yields (index of text, its token ids), processing whole texts in groups of about ``span`` characters and longer
    texts in pieces of that size."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > 2 * span:
            parts = []
            for piece in pieces(texts[i], span):
                flat, points, borders_, _ = split([piece])
                parts.append(cache.ids(cache.codes(flat, points, borders_))[0])
            yield i, np.concatenate(parts)
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= span):
            size += len(texts[j])
            j += 1
        flat, points, borders_, at = split(texts[i:j])
        ids, before = cache.ids(cache.codes(flat, points, borders_))
        edges = before[at].tolist()
        for k in range(j - i):
            yield i + k, ids[edges[k] : edges[k + 1]]
        i = j
