"""Per-document statistics on raw UTF-8 bytes, shared by the rule learner and the classifier."""

from __future__ import annotations

from collections import Counter

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
PUNCTUATION = b"!?;:,.\"'()[]{}=+-_/\\@^~`"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars", "n_lines", "n_upper", "n_digits", "n_punct", "n_bangs", "n_distinct_words", "n_short_lines"]


def less(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of `width` words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : i + n] for i in range(width)), strict=True))
    if len(set(windows)) == n:
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def document_stats(raw: bytes | None) -> tuple[int, ...]:
    """BASE then MORE. Null counts as the empty text; the whole text counts, whatever its length."""
    raw = raw or b""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(raw) - less(raw, CONTINUATION + SPACES),
        less(raw, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(raw) - less(raw, CONTINUATION),
        len(lines),
        less(raw, UPPER),
        less(raw, DIGITS),
        less(raw, PUNCTUATION),
        raw.count(b"!"),
        len(set(words)),
        sum(len(x) < 30 for x in lines),
    )


def ratios(s: dict) -> dict:
    """Scale-free statistics from columns named as in BASE and MORE; works on numbers, arrays and Spark columns alike."""
    words, chars, lines = s["n_words"] + 1.0, s["n_chars"] + 1.0, s["n_lines"] + 1.0
    return {
        "n_words": s["n_words"] * 1.0,
        "mean_word_chars": s["word_chars"] / words,
        "symbol_ratio": s["n_symbols"] / words,
        "dup_line_ratio": s["n_dup_lines"] / lines,
        "repeat_word_ratio": s["n_repeat_words"] / words,
        "upper_ratio": s["n_upper"] / chars,
        "digit_ratio": s["n_digits"] / chars,
        "punct_ratio": s["n_punct"] / chars,
        "bang_ratio": s["n_bangs"] / words,
        "distinct_ratio": s["n_distinct_words"] / words,
        "words_per_line": s["n_words"] / lines,
        "short_line_ratio": s["n_short_lines"] / lines,
    }
