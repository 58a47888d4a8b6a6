"""Text normalisation shared by the operators of this subpackage (Python side, whole texts)."""

from __future__ import annotations

import html
import re
import unicodedata

TAG = re.compile(r"<[^<>]*>")
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words apart from letter case, punctuation, spacing, markup and entities."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = re.sub("[­​-‏⁠﻿]", "", text)
    return WORD.findall(text.casefold())


def edit_distance(a: list, b: list, most: int) -> int:
    """Word edits from a to b, or most + 1 if there are more: the band of 2 * most + 1 diagonals only."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    big = most + 1
    prev = [j if j <= most else big for j in range(m + 1)]
    for i in range(1, n + 1):
        lo, hi = max(1, i - most), min(m, i + most)
        cur = [big] * (m + 1)
        cur[0] = i if i <= most else big
        x, best = a[i - 1], big
        for j in range(lo, hi + 1):
            c = prev[j - 1] if x == b[j - 1] else 1 + min(prev[j - 1], prev[j], cur[j - 1])
            cur[j] = c
            if c < best:
                best = c
        if best > most and cur[0] > most:
            return big
        prev = cur
    return min(prev[m], big)
