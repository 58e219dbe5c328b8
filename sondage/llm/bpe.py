"""Token ids of whole texts, equal to those of the ``tokenizers`` library for a file.

The library is several times too slow for a corpus, so it takes only the texts outside of
the rules below (special strings, other scripts).  Plain Latin texts go to ``tiktoken``,
built from the vocabulary and merges of the same file.

The library merges listed pairs; tiktoken merges neighbours whose joined bytes are a token.
The two agree if every token is what its own bytes are merged to: until a token's rank,
nothing outside of its span has touched the span, so it holds the listed pair or none.
Tokens that their own bytes don't give (the library is asked) are never made and left out.

ByteBpe   byte-level files without normalizer
WordBpe   files that drop white space, lower-case, and mark word ends: a byte that plain
          texts don't hold stands for the mark, put after every piece of the text
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer, models

END = "\x01"  # stands for the mark of a word's end
# Latin letters (composed, and such as lower-case to one letter), common signs, plain white space
PLAIN = regex.compile(r"[\t-\r -~¡-¬®-įı-ɏ‐-‧€]*")
SIGNS = "".join(chr(c) for c in (*range(0x21, 0x250), *range(0x2010, 0x2028), 0x20AC)
                if PLAIN.fullmatch(chr(c)) and unicodedata.category(chr(c))[0] != "L")


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies use for each byte, as letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _File:
    pattern = ""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        model, letters = spec["model"], _byte_letters()
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""

        def named(token: str) -> str:
            return token.removesuffix(suffix) + END if suffix and token.endswith(suffix) else token

        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        # in order of rank: bytes, bytes with the mark, merges
        made = [(None, c) for c in sorted(letters, key=letters.get)]
        made += [((c, END), c + suffix) for c in sorted(letters, key=letters.get)] * bool(suffix)
        made += [((named(a), named(b)), a + b) for a, b in merges]
        names = dict.fromkeys([named(t) for _, t in made] + [END])
        own = models.BPE(vocab={t: i for i, t in enumerate(names)}, merges=[pair for pair, _ in made if pair])
        ranks: dict[bytes, int] = {}
        self.ids = np.full(len(made), -1, np.int64)
        for rank, (pair, token) in enumerate(made):
            name = named(token)
            if pair is None or [t.value for t in own.tokenize(name)] == [name]:
                data = bytes(1 if c == END else letters[c] for c in name)
                if ranks.setdefault(data, rank) == rank:
                    self.ids[rank] = vocab[token]
        if suffix:
            self.ids[1] = -1  # a mark without a piece
        self.same = bool((self.ids == np.arange(len(made))).all())
        self.fast = tiktoken.Encoding("file", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def marked(self, text: str) -> str:
        return text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for t in texts:
            if PLAIN.fullmatch(t) is None or any(s in t for s in self.special):
                out.append(self.by_library(t))
            else:
                ids = self.fast.encode_to_numpy(self.marked(t), disallowed_special=())
                if not self.same:
                    ids = self.ids[ids]
                    ids = ids[ids >= 0]
                out.append(ids.astype("<u4").tobytes())
        return out


class ByteBpe(_File):
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class WordBpe(_File):
    pattern = f"[^{END}]+{END}|{END}"
    pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    signs = re.compile(f"[{re.escape(SIGNS)}]+")

    def __init__(self, path: str):
        super().__init__(path)
        self.known: dict[str, str] = {}

    def _signs(self, m: re.Match) -> str:
        run = m.group()
        if run not in self.known:
            if len(run) > 16:
                return END + END.join(self.pieces.findall(run)) + END
            if len(self.known) > 100_000:
                self.known = {}
            self.known[run] = END + END.join(self.pieces.findall(run)) + END
        return self.known[run]

    def marked(self, text: str) -> str:
        """The text with a mark after every piece, and some more marks, which give no ids."""
        text = text.lower()
        if "'" in text:  # an apostrophe's piece may hold the letters after it
            return END.join([*self.pieces.findall(text), ""])
        text = self.signs.sub(self._signs, text)
        for c in " \n\t\r\x0b\x0c":
            text = text.replace(c, END)
        return text + END


_LOADED: dict[str, _File] = {}


def encoder(path: str) -> _File:
    """The tokenizer of a file, built once per Python worker."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            words = json.load(f)["model"].get("end_of_word_suffix")
        _LOADED[path] = (WordBpe if words else ByteBpe)(path)
    return _LOADED[path]
