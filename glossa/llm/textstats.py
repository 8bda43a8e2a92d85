"""Statistics of one text, on its UTF-8 bytes; shared by the quality rules and the classifier.

``bytes.split()`` cuts at exactly space, tab, line feed, vertical tab, form feed and carriage return,
the white space of the contracts, and the ``translate`` calls count character classes at C speed.
"""

from __future__ import annotations

from collections import Counter

SYMBOLS = b"#*$%&|<>"
SPACE_BYTES = b" \t\n\r\x0b\x0c"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
PUNCT = b"!\"'(),-./:;?@[]_`{}~+=^\\"
#: Bytes that continue a code point; the others start one.
CONTINUES = bytes(range(128, 192))

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_punct", "n_wide", "n_marks")


def _without(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three words that the text holds twice or more, first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {k for k, n in Counter(windows).items() if n > 1}
    total = covered_to = 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, covered_to)
            covered_to = i + 3
    return total


def duplicate_lines(data: bytes) -> tuple[int, int]:
    """(lines with a word, those of them equal to an earlier line); lines end at line feeds only."""
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def stats(text: str | None) -> tuple[int, ...]:
    """The values of NAMES; a null text counts as empty."""
    data = (text or "").encode()
    words = data.split()
    n_lines, n_dup = duplicate_lines(data)
    starts = data.translate(None, CONTINUES)
    return (
        len(words),
        len(starts.translate(None, SPACE_BYTES)),
        _without(data, SYMBOLS),
        n_dup,
        repeated_words(words) if len(words) > 3 else 0,
        n_lines,
        len(set(words)),
        _without(data, UPPER),
        _without(data, DIGITS),
        _without(data, PUNCT),
        len(starts) - len(data.translate(None, bytes(range(128, 256)))),
        data.count(b"!!") + data.count(b"??"),
    )
