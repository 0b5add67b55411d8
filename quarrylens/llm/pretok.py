"""Vectorised byte-level pre-tokenisation.

The public pattern cuts a text into contractions, letter runs, digit runs and
other runs, each with at most one leading space, and runs of whitespace. The
pieces tile the text, so it suffices to find where pieces start: all of it
follows from character classes and their neighbours, over a whole slice of
texts at once.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np

from .textbytes import span_hash

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Characters with the White_Space property.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers of Unicode 16 that Python's tables lack.
_NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
_NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Words longer than this in bytes get a cryptographic hash.
LONG = 512
_classes = None


def classes() -> np.ndarray:
    """Class of each code point."""
    global _classes
    if _classes is None:
        kind = {"L": LETTER, "N": NUMBER}
        got = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        for kind_of, new in ((LETTER, _NEW_LETTERS), (NUMBER, _NEW_NUMBERS)):
            for a, b in new:
                got[a : b + 1] = kind_of
        got[_WHITE] = SPACE
        _classes = got
    return _classes


def starts(cp: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """True where a piece starts. ``cp``: code points of texts set end to end;
    ``edge``: true at each text's first code point."""
    n = len(cp)
    cls = classes()[cp]
    white = cls == SPACE
    out = edge.copy()
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(cls[1:], cls[:-1], out=change[1:])
    change |= edge
    out |= change & white  # a run of whitespace
    run = np.flatnonzero(change & ~white)
    inner = run[~edge[run]]
    after_white = inner[white[inner - 1]]
    out[inner] = True
    out[after_white - 1] = True  # the last whitespace character leaves its run
    spaced = after_white[cp[after_white - 1] == 0x20]
    out[spaced] = edge[spaced]  # one space joins the run that follows it
    # contractions: a lone apostrophe that starts a piece, then letters
    quote = run[(cp[run] == 0x27) & out[run]]
    quote = quote[quote + 1 < n]
    quote = quote[(cls[quote + 1] == LETTER) & ~edge[quote + 1]]
    if len(quote):
        first = cp[quote + 1]
        two = np.minimum(quote + 2, n - 1)
        second = np.where((quote + 2 < n) & ~edge[two], cp[two], 0)
        short = np.isin(first, [ord(c) for c in "stmd"])
        long = ~short & (((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l")))
        for which, size in ((short, 2), (long, 3)):
            at = quote[which]
            out[at + 1] = False
            rest = at + size
            rest = rest[rest < n]
            rest = rest[(cls[rest] == LETTER) & ~edge[rest]]
            out[rest] = True
    return out


def words(raw: np.ndarray, at: np.ndarray, special: bytes | None = None):
    """Pieces of the rows of ``raw``: first byte, end, 64-bit hash, row, and
    whether the piece is the special token's text (cut out before all else)."""
    z = np.zeros(0, np.int64)
    if not len(raw):
        return z, z, np.zeros(0, np.uint64), z, np.zeros(0, bool)
    blob = raw.tobytes()
    cuts = at
    found = []
    if special and special in blob:
        for m in re.finditer(re.escape(special), blob):
            row = int(np.searchsorted(at, m.start(), "right"))
            if m.end() <= at[row]:
                found.append((m.start(), m.end()))
        cuts = np.unique(np.concatenate([at, np.array(found, np.int64).ravel()]))
    cp = np.frombuffer(blob.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cp) == len(raw):
        where = None
        edge = np.zeros(len(cp) + 1, bool)
        edge[cuts] = True
    else:
        lead = (raw & 0xC0) != 0x80
        where = np.flatnonzero(lead)
        mark = np.zeros(len(raw) + 1, bool)
        mark[cuts] = True
        edge = np.append(mark[where], True)
    s = np.flatnonzero(starts(cp, edge[:-1]))
    if where is not None:
        s = where[s]
    e = np.append(s[1:], len(raw))
    is_special = np.zeros(len(s), bool)
    if found:
        lo, hi = np.array(found, np.int64).T
        which = np.searchsorted(lo, s, "right") - 1
        inside = (which >= 0) & (s < hi[np.maximum(which, 0)])
        head = inside & (s == lo[np.maximum(which, 0)])
        e[head] = hi[which[head]]
        is_special = head
        keep = ~inside | head
        s, e, is_special = s[keep], e[keep], is_special[keep]
    h = span_hash(raw, s, e)
    for k in np.flatnonzero(e - s > LONG):
        h[k] = int.from_bytes(hashlib.blake2b(blob[s[k] : e[k]], digest_size=8).digest(), "little")
    return s, e, h, np.searchsorted(at, s, "right") - 1, is_special
