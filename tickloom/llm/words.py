"""64-bit hashes of words and word grams, whole batches at a time."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240101)
_BYTE = _RANDOM.integers(1, 2**63, 256, "u8") | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Powers for letters of a word; letters beyond begin anew, which only words of over 64k bytes notice.
_POWER = np.cumprod(np.full(1 << 16, _STEP, "u8"), dtype="u8")
_GRAM = _RANDOM.integers(1, 2**63, 64, "u8") | np.uint64(1)
#: Letters and digits of ASCII, and all bytes of other characters.
WORD_BYTES = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
#: All but the white space of ASCII.
SPACED_BYTES = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def hashed(texts: list[bytes], inside: np.ndarray = WORD_BYTES, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words in order, and the index of each text's first word (and the end).

    Words are runs of the bytes that ``inside`` marks. Texts are hashed about ``chunk`` bytes at a time.
    """
    parts, firsts, own, held, n = [], [np.zeros(1, "i8")], [], 0, 0
    for k, t in enumerate(texts):
        own.append(t)
        held += len(t)
        if held >= chunk or k == len(texts) - 1:
            h, at = _hashed(own, inside)
            parts.append(h)
            firsts.append(at[1:] + n)
            n, own, held = n + len(h), [], 0
    return np.concatenate(parts) if parts else np.zeros(0, "u8"), np.concatenate(firsts)


def _hashed(texts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), "u1")
    word = inside[data]
    first = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    if not len(first):
        return np.zeros(0, "u8"), np.zeros(len(texts) + 1, "i8")
    last = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    at = np.zeros(len(data), "i4")
    at[first] = first
    np.maximum.accumulate(at, out=at)
    place = np.arange(len(data), dtype="i4") - at
    values = _BYTE[data] * _POWER[place & 0xFFFF]
    values[~word] = 0
    h = mixed(np.add.reduceat(values, first) + (last - first).astype("u8"))
    ends = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(first, ends)


def lowered(texts: list[str | None]) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "replace") for t in texts]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on, shorter by k - 1."""
    if len(h) < k:
        return np.zeros(0, "u8")
    n = len(h) - k + 1
    out = np.zeros(n, "u8")
    for i in range(k):
        out += h[i : i + n] * _GRAM[i]
    return mixed(out)
