"""Token ids of whole texts, by a public tokenizer and a bounded cache of words.

The pre-tokenizer of ``word_bpe_49k.json`` never joins what white space parts, so a text's ids are those of its chunks between
spaces, one after the other. Each worker keeps the ids of the chunks that it has met (a bounded table), and asks the
tokenizers library for new ones only, many in one call. A tokenizer of another layout (``by_words``) encodes whole texts.
"""

from __future__ import annotations

import functools
import json
import os
import zlib

import numpy as np

END_ID = 1
#: Marks of ASCII, of which a run behind a word is a piece of its own.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: The layout for which words can be encoded one by one.
NORMALIZERS, REPLACED, ENDING = ["NFC", "Replace", "Lowercase"], "\\s+", "</w>"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(tokenizer) -> bool:
    """Whether white space always parts tokens, lower case is the only change of letters, and words end in ids of their own."""
    said = json.loads(tokenizer.to_str())
    normal, pieces, model = said["normalizer"] or {}, said["pre_tokenizer"] or {}, said["model"]
    steps, parts = normal.get("normalizers", []), pieces.get("pretokenizers", [])
    return (
        [x["type"] for x in steps] == NORMALIZERS and steps[1]["pattern"] == {"Regex": REPLACED} and steps[1]["content"] == " "
        and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": PIECES} and parts[0]["invert"] and parts[0]["behavior"] == "Removed"
        and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
        and model["type"] == "BPE" and model["end_of_word_suffix"] == ENDING and not model["continuing_subword_prefix"] and not model["dropout"]
        and all(x["special"] and x["content"].startswith("<|") for x in said["added_tokens"]) and not said["post_processor"]
    )


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``cache``: the most chunks kept in each of two generations.
    """

    def __init__(self, path: str, cache: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cache, self.new, self.old = cache, {}, {}
        self.by_words = by_words(self.tokenizer)
        if not self.by_words:
            return
        # the same merges without the normalizer, for lower-case words of letters alone
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(ENDING)]] = True

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """A word's last id is one that ends words, and no other is; that parts the ids of a line of words."""
        groups = [words[i : i + 200] for i in range(0, len(words), 200)]
        out = {}
        for group, e in zip(groups, self.words.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            stops, data = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), ids.tobytes()
            out |= {w: data[a:b] for w, a, b in zip(group, [0, *stops], stops, strict=False)}
        return out

    def _encode_any(self, chunks: list[str]) -> dict[str, bytes]:
        return {c: np.array(e.ids, "<u4").tobytes() for c, e in zip(chunks, self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False))}

    def _learn(self, chunks: set[str], plain: bool) -> None:
        """``plain``: all chunks are lower case and of Latin-1 letters."""
        words, parts, other = set(), {}, []
        fresh = chunks.difference(self.old)
        known = list(chunks.difference(fresh))
        self.new.update(zip(known, map(self.old.__getitem__, known)))
        if not plain:
            other, fresh = list(fresh), ()
        for c in fresh:
            if c.isalpha():
                words.add(c)
            elif (w := c.rstrip(MARKS)).isalpha():  # letters, then marks without a letter between: two tokens before merges
                parts[c] = w, c[len(w) :]
                words.add(w)
            else:
                other.append(c)
        marks = {m for _, m in parts.values() if m not in self.new}
        words = [w for w in words if w not in self.new]
        self.new |= self._encode_words([w for w in words if w not in self.old])
        self.new |= {w: self.old[w] for w in words if w in self.old}
        self.new |= self._encode_any([*other, *marks.difference(other)])
        self.new |= {c: self.new[w] + self.new[m] for c, (w, m) in parts.items()}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text without an end id; null counts as empty."""
        if not self.by_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        split: tuple[list, list] = [], []
        out: list[bytes] = [b""] * len(texts)
        for k, t in enumerate(texts):
            t, plain = t or "", True
            try:  # elsewhere lower() and the library may differ by letter
                t.isascii() or t.encode("latin-1")
                plain = "<|" not in t
            except UnicodeEncodeError:
                plain = False
            t = t.lower() if plain else t
            split[plain].append((k, t.replace("\n", " ").replace("\t", " ").split(" ")))
        if len(self.new) > self.cache:
            self.old, self.new = self.new, {}
        for plain, rows in enumerate(split):
            kinds = set().union(*(s for _, s in rows))
            self._learn(kinds.difference(self.new), bool(plain))
            names = list(kinds)
            own = dict(zip(names, map(self.new.__getitem__, names)))  # small, so the many look-ups stay in the processor's cache
            for k, s in rows:
                out[k] = b"".join(map(own.__getitem__, s))
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that later tasks find its cache."""
    return Encoder(path)


def documents_ids(path: str, texts: list[str | None], end_id: int = END_ID) -> list[np.ndarray]:
    """Arrays of each document's ids with the end id; null counts as empty."""
    end = np.array([end_id], "<u4").tobytes()
    return [np.frombuffer(b + end, "<u4") for b in encoder(path).encode(texts)]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())
