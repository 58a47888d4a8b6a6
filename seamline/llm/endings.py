"""How texts end: a stack automaton over quotes, brackets, markup and escapes, and counts over the
whole corpus of which words can stand at the end of a sentence, line or text.

A word sequence (names and numbers as classes) is counted each time it occurs and each time it is
final: before a terminator or line break, or at the end of a text. What is cut off ends in sequences
that elsewhere go on; what is whole without a full stop ends in sequences that elsewhere end too.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_L = "[^\\W\\d_\u0300-\u036f\u0900-\u0963\u0970-\u097f]|[\u0300-\u036f\u0900-\u0963\u0970-\u097f]"
TOKEN = re.compile(rf"(?:{_L})+(?:['’\-](?:{_L})+)*|\d+(?:[./:]\d+)*|[.!?…।。？！]+|\n")
ENTITY = re.compile(r"&(?:#x?[0-9a-fA-F]+|[a-zA-Z]+);")
MARK = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^<>]*?(/?)>")
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr"}
TERMINATED = re.compile(r"[.!?…।。？！]['\"”’»)\]}*_\s]*$")
#: markup, signs and hearts behind the end
BEHIND = re.compile(r"(?:</?[a-zA-Z][^<>]*>|[\s‍️☀-➿\U0001f000-\U0001faff])+$")
#: a closing ellipsis, bare or in brackets, marks an open end; behind a quote that is closed it is the author's
ELLIPSIS = re.compile(r"\s*(?:[\[(]\s*(?:…|\.{3,})\s*[\])]|…|\.{3,})\s*$")
BROKEN = re.compile(r"(?:�+|&#?[a-zA-Z0-9]{0,8}|<(?:[/!a-zA-Z][^<>]{0,200})?|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|%[0-9A-Fa-f]|[,;(\[{])$")


def word_class(w: str) -> str:
    if w[0].isdigit():
        return "0"
    if w[0].isupper():
        return "A" if len(w) == 1 else "Aa"
    return w.casefold()


def folded(w: str) -> str:
    """the word with the case of its first letter: what starts sentences is told apart from what ends them"""
    low = w.casefold()
    return low[:1].upper() + low[1:] if w[0].isupper() else low


def is_word(t: str) -> bool:
    return t[0] not in ".!?…।。？！\n"


def sequences(tokens: list[str], i: int) -> tuple[str, str, str, str, str]:
    """the word at i as it stands; by class the last one, two and three words; the sentence's first word with the last class"""
    c = [word_class(tokens[i])]
    j = i - 1
    while j >= 0 and is_word(tokens[j]):
        c.append(word_class(tokens[j]))
        j -= 1
    head = tokens[j + 1].casefold() if len(tokens[j + 1]) > 1 else "^"
    while len(c) < 3:
        c.append("^")
    return "0 " + folded(tokens[i]), "1 " + c[0], f"2 {c[1]} {c[0]}", f"3 {c[2]} {c[1]} {c[0]}", f"4 {head} {c[0]}"


def resolved(text: str) -> str:
    """entities as their characters or a place holder, trailing blanks off"""
    if "&" in text:
        text = text.replace("&quot;", '"').replace("&#39;", "'").replace("&#x27;", "'").replace("&amp;", "&")
        text = text.replace("&hellip;", "…").replace("&#8230;", "…").replace("&#x2026;", "…")
        text = ENTITY.sub("-", text)
    return text.rstrip()


def unmarked(text: str) -> tuple[str, bool]:
    """(resolved, without the ellipsis at its end and the markup and signs behind that; whether there was one)"""
    s = resolved(text)
    if "…" not in s and "..." not in s:
        return s, False
    bare = BEHIND.sub("", s)
    m = ELLIPSIS.search(bare)
    return (bare[: m.start()], True) if m else (s, False)


def plain(text: str) -> str:
    """resolved, markup as blanks, a mark of omission and a broken end off: only words and ends matter here"""
    text = BROKEN.sub("", unmarked(text)[0])
    if "<" in text:
        text = re.sub(r"<(?:br|p|div|li)\s*/?>", "\n", text)
        text = re.sub(r"</?[a-zA-Z][^<>]*>", " ", text)
    return text


def unclosed(text: str) -> list[str]:
    """What is open at the end of the text, by a stack: markup and brackets; a straight quote toggles.
    A closer without its opener is passed over; a sentence's end drops what was opened in earlier lines."""
    stack: list[str] = []
    for m in re.finditer(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^<>]*?(/?)>|[(\[{)\]}\"“”\n]", text):
        t = m.group(0)
        if m.group(2):
            name = m.group(2).lower()
            if m.group(1):
                if name in stack:
                    while stack and stack.pop() != name:
                        pass
            elif not m.group(3) and name not in VOID:
                stack.append(name)
        elif t == "\n":
            stack = [x for x in stack if x.isalpha()]
        elif t in "([{":
            stack.append(t)
        elif t in ")]}":
            want = {")": "(", "]": "[", "}": "{"}[t]
            if want in stack:
                while stack and stack.pop() != want:
                    pass
        elif t in '"“”':
            if '"' in stack and t != "“":
                while stack and stack.pop() != '"':
                    pass
            elif t != "”":
                stack.append('"')
    return stack


def is_terminated(text: str) -> bool:
    """ends in a terminator, behind which quotes, brackets, markup, signs and hearts may follow; a closing ellipsis is none"""
    if unmarked(text)[1]:
        return False
    s = BEHIND.sub("", text)
    s = plain(s)
    return bool(TERMINATED.search(s))


def sequence_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """distinct texts -> (seq, n, final): occurrences other than at a text's end, and those before a terminator or line break.

    Each task adds up its batches before anything is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: dict[str, int] = defaultdict(int)
            final: dict[str, int] = defaultdict(int)
            for text in b["text"]:
                tok = TOKEN.findall(plain(text))
                c1 = c2 = head = "^"
                for w, nxt in zip(tok, tok[1:]):
                    if not is_word(w):
                        c1 = c2 = head = "^"
                        continue
                    c = word_class(w)
                    low = w.casefold()
                    if c1 == "^" and len(w) > 1:
                        head = low
                    own = ("0 " + (low if c == low else folded(w)), "1 " + c, f"2 {c1} {c}", f"3 {c2} {c1} {c}", f"4 {head} {c}")
                    for s in own:
                        n[s] += 1
                    if not is_word(nxt):
                        for s in own:
                            final[s] += 1
                    c1, c2 = c, c1
            yield pd.DataFrame({"seq": list(n), "n": list(n.values()), "final": [final.get(k, 0) for k in n]})

    c = texts.select(F.col(column).alias("text")).mapInPandas(run, "seq string, n long, final long")
    return c.groupBy("seq").agg(F.sum("n").alias("n"), F.sum("final").alias("final"))


def end_of(text: str) -> tuple[str, str, str, str, str] | None:
    """the sequences at the end of a text; null if it has no word"""
    tok = TOKEN.findall(plain(text))
    for i in range(len(tok) - 1, -1, -1):
        if is_word(tok[i]):
            return sequences(tok, i)
    return None
