"""Subword ids of the public word-level vocabulary, word by word.

That tokenizer never joins characters across white space, so a text's ids are the ids of its words one after the
other, and equal words have equal ids: each worker encodes a word once. The merges run in one call for many words,
with a character that is no letter, digit or space as the end-of-word mark. Words that hold that character or a
special token go to the library's own pipeline.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from staylens.llm.scan import Words

VOCABULARY = "word_bpe_49k.json"
# Words that a worker remembers before it starts anew; bounds its memory.
CACHE_WORDS = 1_000_000

_CHAR = "\x7f"
_MARK = _CHAR.encode()
_SUFFIX = "</w>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + i)] = b
    return out


class WordEncoder:
    """Ids of words (no ASCII white space inside), many words in one call."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        alphabet = _byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        # The mark joins the byte before it first of all (ids 256 to 511), then all goes by the order of the vocabulary.
        ranks = {}
        for token, i in vocab.items():
            ended = token.endswith(_SUFFIX) and token != _SUFFIX
            raw = bytes(alphabet[c] for c in (token.removesuffix(_SUFFIX) if ended else token))
            ranks[raw + _MARK if ended else raw] = i
        self.size = 1 + max(*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]))
        self.core = tiktoken.Encoding("words", pat_str=r"\S+|\n", mergeable_ranks=ranks, special_tokens={})
        self.newline = ranks[b"\n"]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.odd = regex.compile("|".join(map(regex.escape, [*special, _CHAR])))
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.at, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def ends_word(self) -> np.ndarray:
        """For each id, and one mark after the last, whether it ends a word."""
        out = np.ones(self.size + 1, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            out[i] = token.endswith(_SUFFIX)
        return out

    def pretokens(self, text: str) -> list[str]:
        """Normalised pieces that the merges never cross."""
        return self.pieces.findall(self._normal(text))

    @staticmethod
    def _normal(text: str) -> str:
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and the bounds of each word."""
        joined = "\n".join(words)
        odd = [i for i, w in enumerate(words) if self.odd.search(w)] if self.odd.search(joined) else []
        if odd:
            words = list(words)
            special = {i: np.array(self.library.encode(words[i], add_special_tokens=False).ids, np.uint32) for i in odd}
            for i in odd:
                words[i] = ""
            joined = "\n".join(words)
        marked = self.pieces.sub(r"\g<0>" + _CHAR + " ", self._normal(joined) + "\n")
        got = np.array(self.core.encode_ordinary(marked), np.uint32)
        breaks = np.flatnonzero(got == self.newline)
        ids = np.delete(got, breaks)
        bounds = np.concatenate(([0], breaks - np.arange(len(breaks))))
        if odd:
            parts = [special.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(words))]
            ids, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, bounds

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Remember new words; ``hashes`` is sorted and holds none that is known."""
        ids, bounds = self.encode(words)
        all_hashes = np.concatenate((self.hashes, hashes))
        order = np.argsort(all_hashes, kind="stable")
        self.hashes = all_hashes[order]
        self.at = np.concatenate((self.at, bounds[:-1] + len(self.flat)))[order]
        self.sizes = np.concatenate((self.sizes, np.diff(bounds).astype(np.int32)))[order]
        self.flat = np.concatenate((self.flat, ids))

    def of_words(self, words: Words, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the bounds of each word in them.

        ``raw`` holds the bytes as they were, since letters outside A-Z lower-case by their own rules.
        """
        if not len(words.hash):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        unique, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_WORDS:
            self._forget()
        place = np.searchsorted(self.hashes, unique)
        place[place == len(self.hashes)] = 0
        missing = self.hashes[place] != unique if len(self.hashes) else np.ones(len(unique), bool)
        if missing.any():
            text = raw.tobytes()
            at = first[missing]
            new = b"\n".join([text[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]).decode().split("\n")
            self._learn(unique[missing], new)
            place = np.searchsorted(self.hashes, unique)
        size = self.sizes[place][back].astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(size)))
        take = np.arange(bounds[-1]) + np.repeat(self.at[place][back] - bounds[:-1], size)
        return self.flat[take], bounds


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker and file."""
    return WordEncoder(path)
