"""What a token is: a run of characters other than white space, or an entry of a vocabulary file."""

from __future__ import annotations

import functools


class WhiteSpace:
    """Tokens between white space; a window joins its tokens by single spaces."""

    def count(self, text: str) -> int:
        return len(text.split())

    def windows(self, text: str, max_tokens: int, overlap: int) -> list[tuple[str, int]]:
        words = text.split()
        cuts = [words[a:b] for a, b in spans(len(words), max_tokens, overlap)]
        return [(" ".join(part), len(part)) for part in cuts]


class Vocabulary:
    """Tokens of a vocabulary in the tokenizers library's format; strings of special tokens are one token each.

    A window is a slice of the text from where the token before it ends, so it breaks no character, and its tokens are counted
    anew, as borders may join differently.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)

    def count(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False).ids)

    def windows(self, text: str, max_tokens: int, overlap: int) -> list[tuple[str, int]]:
        ends = [b for _, b in self.model.encode(text, add_special_tokens=False).offsets]
        cuts = [text[ends[a - 1] if a else 0 : ends[b - 1] if b < len(ends) else len(text)] for a, b in spans(len(ends), max_tokens, overlap)]
        return [(part, self.count(part)) for part in cuts if part]


def spans(n: int, max_tokens: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of max_tokens, each overlap short of the end of the one before, the last ending with the text."""
    return [(k, min(k + max_tokens, n)) for k in range(0, max(1, n - overlap), max_tokens - overlap)]


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> WhiteSpace | Vocabulary:
    """The tokenizer of a vocabulary file, that of white space for an empty path; loaded once in a process."""
    return Vocabulary(path) if path else WhiteSpace()
