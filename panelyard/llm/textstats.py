"""Counts of one text that the quality rules start from."""

from __future__ import annotations

from collections import Counter

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"


def counts(text: str) -> tuple[int, int, int, int, int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated 3-word windows, lines with a word,
    distinct words, capitals, digits (the last two of ASCII)."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0, 0, 0, 0)
    word_chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    lines = repeated = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            if line in seen:
                repeated += 1
            else:
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    in_repeats = 0
    if len(set(windows)) < len(windows):
        many = {w for w, c in Counter(windows).items() if c > 1}
        covered = 0  # positions below this are counted
        for i, w in enumerate(windows):
            if w in many:
                in_repeats += i + 3 - max(i, covered)
                covered = i + 3
    capitals = _capitals(raw)
    return n, word_chars, symbols, repeated, in_repeats, lines, len(set(words)), capitals, _digits(raw)


_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"


def _capitals(raw: bytes) -> int:
    return len(raw) - len(raw.translate(None, _CAPITALS))


def _digits(raw: bytes) -> int:
    return len(raw) - len(raw.translate(None, _DIGITS))
