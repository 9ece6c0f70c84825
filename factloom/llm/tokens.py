"""Encoding whole texts by tokenizer files of the `tokenizers` library, in Python workers.

The ids are those the `tokenizers` library gives. Its per-call cost is several times that of tiktoken's merge loop, so
a file's vocabulary is handed to that loop where this gives the same ids (the tests compare both): byte-level files
over whole texts, files with word ends over distinct words; whatever doesn't fit goes through the library itself.
`texts` takes all of a text as ordinary; `with_added` reads the added tokens of a file (<|endoftext|>) where a text holds
them, as the library does by default.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np

from factloom.llm.common import MARKS, WordCache

#: Stands for the end of a word in the merge loop; words that hold it go through the library.
WORD_END = "\0"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones as they are, others from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _library(path: str, ordinary: bool):
    """The file's tokenizer; with `ordinary`, added tokens in a text are encoded as any other characters."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if ordinary:
        tokenizer.encode_special_tokens = True
    return tokenizer


class _Added:
    """Texts that hold an added token's content go through the library at its default, all others through `texts`."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            added = json.load(source)["added_tokens"]
        self.path, self.contents = path, [t["content"] for t in added]
        #: Such tokens are sought in the normalised text, which isn't at hand
        self.sought_normalised = any(t["normalized"] for t in added)
        self.default = None

    def with_added(self, texts: list[str | None]) -> list[bytes]:
        held = [i for i, t in enumerate(texts) if t and (self.sought_normalised or any(c in t for c in self.contents))]
        if not held:
            return self.texts(texts)
        self.default = self.default or _library(self.path, ordinary=False)
        rest = list(texts)
        for i in held:
            rest[i] = None
        out = self.texts(rest)
        for i, e in zip(held, self.default.encode_batch_fast([texts[i] for i in held], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


def _vocabulary(path: str, word_end: str) -> dict[bytes, int]:
    """Tokens as bytes; the mark of a word's end becomes WORD_END."""
    with open(path, encoding="utf-8") as source:
        model = json.load(source)
    special = {t["content"] for t in model["added_tokens"]}
    letters = byte_letters()
    out = {}
    for token, i in model["model"]["vocab"].items():
        if token not in special:
            ended = bool(word_end) and token.endswith(word_end)
            out[bytes(letters[c] for c in (token.removesuffix(word_end) if ended else token)) + WORD_END.encode() * ended] = i
    return out


class ByteLevel(_Added):
    """A byte-level file without normaliser, its pattern that of the rank files."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        super().__init__(path)
        self.merge = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=_vocabulary(path, ""), special_tokens={})

    def texts(self, texts: list[str | None]) -> list[bytes]:
        encode = self.merge.encode_to_numpy
        return [encode(t, disallowed_special=()).astype("<u4", copy=False).tobytes() if t else b"" for t in texts]


class WordLevel(_Added):
    """A file that lower-cases, drops white space and marks word ends."""

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        self.library = _library(path, ordinary=True)
        vocabulary = _vocabulary(path, "</w>")
        self.merge = tiktoken.Encoding(path, pat_str=f"[^{WORD_END}]+{WORD_END}", mergeable_ranks=vocabulary, special_tokens={})
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END.encode())]] = True
        self.ends[vocabulary[WORD_END.encode()]] = False
        self.cache = WordCache(self._words, leading=False)
        self.texts = self.cache.texts

    def _words(self, words: list[str]) -> list[bytes]:
        """A core of letters, lower-cased, and the marks after it are a pre-token each; other words aren't fast."""
        pieces, parts, slow = [], [], []
        for i, word in enumerate(words):
            # Latin letters lower-case one by one, and their composed forms are normal already
            core = word.rstrip(MARKS)
            lower = core.lower()
            if lower.isalpha() and (core.isascii() or max(core) < "ɐ"):
                pieces.append(lower)
                if len(core) < len(word):
                    pieces.append(word[len(core) :])
                    parts.append(2)
                else:
                    parts.append(1)
            else:
                parts.append(0)
                slow.append(i)
        flat = self.merge.encode_to_numpy(WORD_END.join([*pieces, ""]), disallowed_special=()).astype("<u4", copy=False)
        cuts = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(self.ends[flat]) + 1])
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(parts, dtype=np.int64)])
        bounds = (4 * cuts[at]).tolist()
        ids = flat.tobytes()
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        found = self.library.encode_batch_fast([words[i] for i in slow], add_special_tokens=False) if slow else []
        for i, e in zip(slow, found, strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=4)
def byte_level(path: str, pattern: str) -> ByteLevel:
    return ByteLevel(path, pattern)


@lru_cache(maxsize=4)
def word_level(path: str) -> WordLevel:
    return WordLevel(path)
