"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library."""

from __future__ import annotations

import os

import numpy as np

END_ID = 2
#: ASCII marks that make a unit of their own behind letters.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts. The vocabulary drops white space and never joins characters across it, so a text's ids are
    those of its blank-separated words in order; each word is encoded once and remembered (up to ``limit`` words, then all
    are forgotten). Letters are one unit of the vocabulary, in either case, and so are the marks behind them, so a word's
    closing ASCII marks are coded apart, and words of letters alone are coded many in one call, A-Z and a-z as one: each
    ends in a token that closes a word."""

    limit = 1_200_000
    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.closes[k] = token.endswith("</w>")

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(c.ids, "<u4").tobytes() for c in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> None:
        """Put the ids of new words among the known ones."""
        known = self.known
        if len(known) + len(words) > self.limit:
            known.clear()
        letters, marked, rest = {}, [], []
        for w in words:
            stem = w.rstrip(MARKS)
            key = stem.lower()  # A-Z only
            if key not in letters:
                text = key.decode("utf-8", "replace")
                if not text.isalpha() or "İ" in text:  # small, it is a letter and a mark
                    rest.append(w)
                    continue
                if key not in known:
                    letters[key] = text
            if key != w:
                marked.append((w, key, w[len(stem):]))
        rest.extend({marks for *_, marks in marked if marks}.difference(known, rest))
        if letters and self.closes.any():
            ids = np.frombuffer(self._encode([" ".join(letters.values())])[0], "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(letters):
                raw, at = ids.tobytes(), 0
                for w, end in zip(letters, (4 * ends).tolist(), strict=True):
                    known[w] = raw[at:end]
                    at = end
        rest.extend(w for w in letters if w not in known)
        known.update(zip(rest, self._encode([w.decode("utf-8", "replace") for w in rest]), strict=True))
        for w, key, marks in marked:
            known[w] = known[key] + known[marks] if marks else known[key]

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each UTF-8 text its ids as little-endian unsigned 32-bit integers, with END_ID at the end."""
        end, get = np.array([END_ID], "<u4").tobytes(), self.known.get
        ids, open_places = [], []
        for text in texts:
            words = text.split()
            found = list(map(get, words))
            ids.append(found)
            for _ in range(found.count(None)):
                at = found.index(None, at + 1 if _ else 0)
                open_places.append((found, at, words[at]))
        if open_places:
            self.learn({w for *_, w in open_places})
            for found, at, w in open_places:
                found[at] = self.known[w]
        return [np.frombuffer(b"".join(found) + end, "<u4") for found in ids]
