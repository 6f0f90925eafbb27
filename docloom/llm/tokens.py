"""Cached public tokenizers. A worker loads a vocabulary once, by its path."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

#: Words whose ids a worker remembers; beyond that it starts anew.
CACHE_WORDS = 400_000
_ADJACENT = re.compile(r"\s\s")


class _Ids(dict):
    """word -> ids as bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = self.encode(word)
        return found


class ByteBpe:
    """Ids of ``byte_bpe_50k.json`` as tokenizers gives them, little-endian uint32.

    Its pre-tokens never cross a single space or line end between two other
    characters, so a text without adjacent white space is encoded word by word
    from a cache; any other text is encoded whole.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.json_path = json_path
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        whole = lambda text: np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
        self.whole = whole
        self.spaced = _Ids(lambda word: whole(" " + word))
        self.leading = _Ids(whole)
        self.line_end = whole("\n")

    @functools.cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def ids(self, text: str) -> bytes:
        if self.SPECIAL in text:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if _ADJACENT.search(text):
            return self.whole(text)
        lines = []
        for line in text.split("\n"):
            words = line.split(" ")
            first = self.leading[words[0]]
            lines.append(first + b"".join(map(self.spaced.__getitem__, words[1:])))
        return self.line_end.join(lines)


@functools.lru_cache(maxsize=2)
def byte_bpe(json_path: str, ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(json_path, ranks_path, pattern)


class PieceBpe:
    """Ids of a sentencepiece model, word by word, as little-endian uint16."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(self.size)])
        self.words = _Ids(lambda word: np.array(self.model.encode(word, num_threads=1), dtype="<u2").tobytes())

    def ids(self, words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype="<u2")


@functools.lru_cache(maxsize=2)
def piece_bpe(model_path: str) -> PieceBpe:
    return PieceBpe(model_path)
