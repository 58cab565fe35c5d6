"""Token ids of whole texts by a public tokenizer, with a bounded cache of words.

The vocabulary in use drops white space before it splits a text, so the ids of a text are the ids of
its white-space separated parts, one after the other.  Each part is encoded by the tokenizers library
once and kept; a part of ASCII or Latin-1 letters with punctuation after them goes straight to the
library's model, as normalizing, splitting and byte mapping have one possible result for it.  Whether a
vocabulary does it this way (lower case, byte letters) is tried on samples when it is loaded; with any
other one every part takes the library's whole path.
"""

from __future__ import annotations

import array
import os
import re
import string
import sys

from logweir.llm.hashing import forget

#: Letters that stand alone under NFC; ASCII punctuation after them is a piece of its own.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
PUNCTUATION = string.punctuation.encode()

#: Words on which the direct way is held against the library's.
SAMPLES = ("the", "The", "WORLD", "mañana", "ÉCOLE", "straße,", "naïve!?", "Über...", "end).", "x", "Q;", "internationalisation", "ÀÉÎÕÜ", "a(", "don-", "e&&", "ÿ%%%")


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ..."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(own))
    return out


class WordIds:
    """Little-endian unsigned 32-bit ids of texts.

    ``limit`` bounds each of the two generations of kept words, and so the memory.  ``split_words``
    must be False for a tokenizer whose ids depend on white space; then texts are encoded whole.
    """

    def __init__(self, path: str, limit: int = 300_000, longest: int = 40, split_words: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.longest, self.split_words = Tokenizer.from_file(path), limit, longest, split_words
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.pieces: dict[bytes, bytes] = {}
        self.plain = type(self.model).__name__ == "BPE" and split_words
        self.plain = self.plain and all(self._plain(w.encode()) == self._whole(w) for w in SAMPLES)
        self.hot = self._generation({})

    def _generation(self, old: dict) -> dict:
        outer = self

        class Words(dict):
            def __missing__(self, word: bytes) -> bytes:
                ids = old.get(word)
                if ids is None:
                    ids = outer.encode(word)
                if len(word) <= outer.longest:
                    self[word] = ids
                return ids

        return Words()

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        out = array.array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: bytes) -> bytes:
        """Ids of lower-case letters, or of punctuation; capitals and endings make many words of few of them."""
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) > self.limit:
                self.pieces.clear()
            text = piece.decode() if piece.isascii() else "".join(map(self.letters.__getitem__, piece))
            ids = self._bytes([t.id for t in self.model.tokenize(text)])
            if len(piece) <= self.longest:
                self.pieces[piece] = ids
        return ids

    def _plain(self, part: bytes) -> bytes | None:
        """Ids of letters with punctuation after them, or None for anything else."""
        letters = part.rstrip(PUNCTUATION)
        if letters.isalpha():  # ASCII alone
            small = letters.lower()
        else:
            text = letters.decode("utf-8", "replace")
            if not PLAIN.fullmatch(text):
                return None
            small = text.lower().encode()
        if len(letters) == len(part):
            return self._piece(small)
        return self._piece(small) + self._piece(part[len(letters) :])

    def encode(self, part: bytes) -> bytes:
        ids = self._plain(part) if self.plain else None
        return self._whole(part.decode("utf-8", "replace")) if ids is None else ids

    def ids(self, text: bytes | None) -> bytes:
        """Ids of one whole UTF-8 text; none for null."""
        if not text:
            return b""
        if not self.split_words:
            return self.encode(text)
        if len(self.hot) > self.limit:
            self.hot = self._generation(dict(self.hot))
        return b"".join(map(self.hot.__getitem__, text.split()))


_KEPT: dict[tuple, WordIds] = {}


def word_ids(path: str, split_words: bool = True) -> WordIds:
    """One encoder per Python worker, which serves many tasks."""
    forget("hashing", "_SEEN")
    if (path, split_words) not in _KEPT:
        _KEPT[path, split_words] = WordIds(path, split_words=split_words)
    return _KEPT[path, split_words]
