"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A word is a maximal run of ASCII letters and digits and of characters beyond
ASCII, in lower case. Punctuation and spaces beyond ASCII (:data:`SEPARATORS`)
part words, and each character of the scripts written without spaces
(:data:`ALONE`) is a word.
"""

from __future__ import annotations

import hashlib

import numpy as np

_PRIME = 0x100000001B3
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: ranges of characters beyond ASCII that end a word, and of those that are words by themselves, as in a character class
SEPARATORS = "\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u303f\uff01-\uff0f\uff1a-\uff20"
ALONE = "\u3040-\u30ff\u3400-\u9fff"
#: longer words, in bytes, are hashed one by one
LONG_WORD = 512
#: bytes that stand for the end of a text and of a line; neither is part of a word
TEXT_END, LINE_END = 0, 10


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some UTF-8 bytes start and stop; the bytes end with one that is no word's."""
    inside = _IN_WORD[data]
    alone = np.zeros(0, np.int64)
    at = np.flatnonzero(data >= 0xC2)  # lead bytes beyond ASCII
    if len(at):
        lead, next_, third = data[at], data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
        two = (lead == 0xC2) & ~np.isin(next_, (0xAA, 0xB5, 0xBA))
        three = (lead == 0xE2) & ((next_ == 0x80) | (next_ == 0x81) & (third < 0xB0)) | (lead == 0xE3) & (next_ == 0x80)
        three |= (lead == 0xEF) & (next_ == 0xBC) & ((third > 0x80) & (third < 0x90) | (third > 0x99) & (third < 0xA1))
        for k in range(3):
            inside[at[three] + k] = False
        for k in range(2):
            inside[at[two] + k] = False
        # U+3040 to U+30FF and U+3400 to U+9FFF
        alone = at[(lead > 0xE3) & (lead < 0xEA) | (lead == 0xE3) & ((next_ > 0x80) & (next_ < 0x84) | (next_ > 0x8F))]
    edge = inside[1:] != inside[:-1]
    if len(alone):
        cut = np.unique(np.concatenate([alone, alone + 3]))
        cut = cut[(cut > 0) & inside[cut] & inside[cut - 1]]
        both = np.sort(np.concatenate([np.flatnonzero(edge) + 1, cut, cut]))  # such a cut ends a word and starts one
    else:
        both = np.flatnonzero(edge) + 1
    if inside[0]:
        both = np.concatenate([[0], both])
    return both[::2], both[1::2]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, their start among all bytes, the bytes, and where each text ends in them."""
    raw = [t.lower().encode("utf-8", "replace").replace(b"\0", b" ") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    joined = b"\0".join(raw) + b"\0" * 9
    padded = np.frombuffer(joined, np.uint8)
    data = padded[:-8]
    starts, stops = _words(data)
    sizes = stops - starts
    eights = np.ndarray((len(data),), "<u8", joined, 0, (1,))  # the eight bytes from each place on
    out = mixed((eights[starts] & _LOW_BYTES[np.minimum(sizes, 8)]) + sizes.astype(np.uint64))
    done, left = 8, np.flatnonzero(sizes > 8)
    while len(left) and done < LONG_WORD:
        more = eights[starts[left] + done] & _LOW_BYTES[np.minimum(sizes[left] - done, 8)]
        out[left] = mixed(out[left] * np.uint64(_PRIME) + more)
        done += 8
        left = left[sizes[left] > done]
    for i in left.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(joined[starts[i] : stops[i]], digest_size=8).digest(), "little")
    return out, starts, data, ends


def shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, text by text; how many each text has; a digest of each text's words in order.

    A text with fewer words is one shingle of them all; one without words has none.
    """
    words, starts, _, ends = word_hashes(texts)
    n = np.diff(np.searchsorted(starts, ends), prepend=0)
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.cumsum(n) - n
    place = (np.arange(len(words)) - first[owner]).astype(np.uint64)
    whole = np.zeros(len(texts), np.uint64)
    if len(words):
        some = n > 0
        whole[some] = np.add.reduceat(mixed(words + mixed(place)), first[some])
    whole = mixed(whole + n.astype(np.uint64))
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    total = np.zeros(len(words), np.uint64)
    for k in range(width):
        m = max(0, len(words) - k)
        total[:m] = total[:m] * np.uint64(_PRIME) + words[k : k + m]
    keep = place.astype(np.int64) < (n - width + 1)[owner]
    short = (n > 0) & (n < width)
    values = mixed(total)
    if short.any():
        values[first[short]] = whole[short]
        keep[first[short]] = True
    return values[keep], count, whole
