"""Normalised words of texts."""

from __future__ import annotations

import re
import unicodedata

#: Code points that show nothing: format characters, fillers and variation selectors.
UNSEEN_RANGES = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x0600, 0x0605), (0x061C, 0x061C), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x115F, 0x1160),
    (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F),
    (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF),
)

UNSEEN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSEEN_RANGES) + "]")
_WORD = re.compile(r"[^\W_]+")


def normal_words(text: str | None) -> list[str]:
    """Runs of letters and digits after Unicode compatibility folding, without case and invisible characters.

    Null and empty texts have no words.
    """
    if not text:
        return []
    if text.isascii():
        return _WORD.findall(text.lower())
    folded = unicodedata.normalize("NFKC", UNSEEN.sub("", text)).casefold()
    return _WORD.findall(UNSEEN.sub("", unicodedata.normalize("NFKC", folded)))
