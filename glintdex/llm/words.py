"""How the public word-level BPE vocabulary cuts a text into words, and the ids that its own library gives each.

Fixed values come from the vocabulary file: its split pattern, its special tokens and its merges.  A text whose
characters all lie in a repertoire that Unicode normalisation leaves alone is cut by one compiled pattern; any other
text goes through the library's own normaliser and splitter.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np

from glintdex.llm.shared import kept_by_worker

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def _ranges(chars: Iterable[str]) -> str:
    """A character class's inside for ``chars``."""
    out, run = [], []
    for c in [*sorted(set(map(ord, chars))), None]:
        if run and (c is None or c != run[-1] + 1):
            out.append(re.escape(chr(run[0])) + ("-" + re.escape(chr(run[-1])) if len(run) > 1 else ""))
            run = []
        if c is not None:
            run.append(c)
    return "".join(out)


#: Latin and general punctuation: in composed form already, lower case character by character; U+0130 is not.
_PLAIN = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC) if c != 0x130]
_LOW = [c.lower() for c in _PLAIN]
_L, _N = (_ranges(c for c in _LOW if unicodedata.category(c)[0] == k) for k in "LN")
_S = _ranges(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0]))
_UNUSUAL = re.compile(f"[^{_ranges(_PLAIN)}]")
_PLAIN_WORDS = re.compile(f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^{_S}{_L}{_N}]+")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class Splitter:
    """Cuts texts as the vocabulary file at ``path`` says; special tokens stay whole."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        pattern = self.file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.special = {x["content"]: x["id"] for x in self.file["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, self.special)))

    def _plain(self, text: str) -> list[str]:
        if not _UNUSUAL.search(text):
            return _PLAIN_WORDS.findall(text.lower())
        return [w for w, _ in self.cut.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def split(self, text: str | None) -> list[str]:
        """The words of a whole text; a null has none."""
        if not text:
            return []
        if "<|" not in text or not self.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._plain(text[at:])


class Memo(dict):
    """Computed values by word; at most twice ``most`` of them, the least recent half forgotten first."""

    def __init__(self, compute: Callable[[str], object], most: int = 150_000):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        self[word] = value
        return value

    def tidy(self) -> None:
        """Between texts: forgets what was not used of late."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class WordIds:
    """Ids of whole texts, word by word; the new words of many texts are encoded together, and words are remembered.

    ``many`` gives each word's ids as little-endian unsigned 32-bit numbers.
    """

    def __init__(self, splitter: Splitter, many: Callable[[list[str]], list[bytes]], most: int = 200_000):
        self.splitter, self.many, self.most = splitter, many, most
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        if len(self.recent) > self.most:
            self.older, self.recent = self.recent, {}
        cut = [self.splitter.split(x) for x in texts]
        new = set().union(*cut).difference(self.recent)
        known = new & self.older.keys()
        self.recent.update((w, self.older[w]) for w in known)
        new = sorted(new - known, key=len)
        self.recent.update(zip(new, self.many(new), strict=True))
        return [b"".join(map(self.recent.__getitem__, words)) for words in cut]


class LibraryIds:
    """Ids of whole texts by the tokenizers library, which encodes each word once while it is remembered."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        self.letters = byte_symbols()
        self.memo = Memo(self._encode)

    def _encode(self, word: str) -> bytes:
        if word in self.splitter.special:
            return np.array([self.splitter.special[word]], "<u4").tobytes()
        found = self.splitter.library.model.tokenize("".join(map(self.letters.__getitem__, word.encode("utf-8"))))
        return np.array([t.id for t in found], "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        self.memo.tidy()
        return b"".join(map(self.memo.__getitem__, self.splitter.split(text)))


def library_ids(path: str) -> LibraryIds:
    """One for each worker process and vocabulary."""
    return kept_by_worker(("library ids", path), lambda: LibraryIds(path))
