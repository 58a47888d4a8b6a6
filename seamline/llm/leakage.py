"""Evaluation passages inside corpus documents, whole or in good part.

Q-gram lemma filtering: texts become streams of letters and digits only, so case, punctuation,
spacing, line breaks and markup vanish. All q-grams of a document are looked up in the index of the
items' q-grams; shared ones are counted in overlapping diagonal bands. An edit of a word destroys at
most (its length + q - 1) q-grams, so a region that keeps within the edit budget retains a known
share of its q-grams: bands below that are dropped. What is left is chained into stretches, and the
words of each stretch are aligned in a band around its diagonal.

The items are the stated query set: they are read in blocks of `block_chars` characters, each block
an index of a few MB in every task, and each block is held against all documents. No document is
compared with another, nothing is shuffled.

Defined results: null, empty and blank texts hold nothing; an item of fewer than 8 words must occur
whole; repeated documents each come out; repeated items too; other columns are dropped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from seamline.llm.texts import TAG
from seamline.session import spread

Q = 8
BAND = 64
#: the share of an item's words that must be there, in at most two stretches, and of a stretch's words that must agree
COVER, AGREE = 0.5, 0.75
#: the share of an item's q-grams left when half of it is there and one word in ten is changed, with room
KEPT = 0.15

_BROKEN = re.compile(r"([^\W\d_])-[ \t]*\n[ \t>|*]*(?=[^\W\d_])")
_QUOTED = re.compile(r"^[ \t]*[>|*]+[ \t]?", re.M)
_WORD = re.compile(r"[^\W_]+")


def stream(text: str | None) -> tuple[str, list[str], list[int]]:
    """(all letters and digits in lower case, the words, the start of each word in the first)"""
    if not text:
        return "", [], []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if "\n" in text:
        text = _BROKEN.sub(r"\1", text)
    if not text.isascii():
        text = re.sub("[­​‌‍⁠﻿]", "", text)
    w = _WORD.findall(text.casefold())
    at, n = [], 0
    for x in w:
        at.append(n)
        n += len(x)
    return "".join(w), w, at


def _grams(codes: np.ndarray) -> np.ndarray:
    """a hash of the Q codes from each place on"""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(Q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    return h


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Index:
    """The q-grams of the items: sorted hashes, and for each its (item, place)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, self.at, self.size = [], [], [], []
        self.short: dict[str, list[int]] = {}  # items of fewer letters than a q-gram has, by their first word
        hs, its, ps = [], [], []
        for item_id, text in items:
            s, w, at = stream(text)
            if not w:
                continue
            g = _grams(_codes(s))
            hs.append(g)
            its.append(np.full(len(g), len(self.ids), np.int32))
            ps.append(np.arange(len(g), dtype=np.int32))
            if len(s) < Q:
                self.short.setdefault(w[0], []).append(len(self.ids))
            self.ids.append(item_id)
            self.words.append(w)
            self.at.append(np.array([*at, len(s)]))
            self.size.append(len(s))
        h = np.concatenate(hs) if hs else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.item = (np.concatenate(its) if its else np.empty(0, np.int32))[order]
        self.place = (np.concatenate(ps) if ps else np.empty(0, np.int32))[order]
        self.hash, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.size = np.array(self.size, np.int64)

    def candidates(self, streams: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(document, item, places in the document, places in the item) of pairs that keep enough q-grams in bands."""
        if not len(self.hash):
            return
        lens = np.array([len(s) for s in streams], np.int64)
        starts = np.concatenate([[0], np.cumsum(lens)])
        g = _grams(_codes("".join(streams)))
        pos = np.arange(len(g), dtype=np.int64)
        doc = np.searchsorted(starts, pos, side="right") - 1
        k = np.searchsorted(self.hash, g)
        k[k == len(self.hash)] = 0
        hit = (self.hash[k] == g) & (pos + Q <= starts[doc + 1])
        pos, doc, k = pos[hit], doc[hit], k[hit]
        if not len(pos):
            return
        n = self.first[k + 1] - self.first[k]
        rep = np.repeat(np.arange(len(k)), n)
        inner = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        row = self.first[k][rep] + inner
        d, it, pi, pd_ = doc[rep], self.item[row].astype(np.int64), self.place[row].astype(np.int64), (pos - starts[doc])[rep]
        # overlapping bands: each hit counts in two, half a band apart
        band = (pd_ - pi + (1 << 40)) // (BAND // 2)
        pair = d * len(self.ids) + it
        keys = np.concatenate([pair * (1 << 42) + band, pair * (1 << 42) + band - 1]) if pair.max(initial=0) < (1 << 20) else None
        if keys is None:
            _, pair_no = np.unique(pair, return_inverse=True)
            keys = np.concatenate([pair_no * (1 << 42) + band, pair_no * (1 << 42) + band - 1])
        _, inv, cnt = np.unique(keys, return_inverse=True, return_counts=True)
        m = len(pair)
        best = np.maximum(cnt[inv[:m]], cnt[inv[m:]])
        # a short item has fewer q-grams than the least that counts in a longer one
        keep = best >= np.minimum(np.maximum(6, 0.05 * self.size[it]), np.maximum(self.size[it] - Q + 1, 1))
        pair, pd_, pi, it = pair[keep], pd_[keep], pi[keep], it[keep]
        order = np.lexsort((pd_, pi, pair))
        pair, pd_, pi, it = pair[order], pd_[order], pi[order], it[order]
        u, first = np.unique(pair, return_index=True)
        last = np.append(first[1:], len(pair))
        for p, a, b in zip(u, first, last):
            i = int(p % len(self.ids))
            if len(np.unique(pi[a:b])) >= min(KEPT * self.size[i], max(1, self.size[i] - Q + 1)):
                yield int(p // len(self.ids)), i, pd_[a:b], pi[a:b]


def _chains(pd_: np.ndarray, pi: np.ndarray) -> list[list[tuple[int, int]]]:
    """Hits in the order of the item -> stretches in which the diagonal wanders little and no gap is wide."""
    open_: list[list[tuple[int, int]]] = []
    for d, i in zip(pd_.tolist(), pi.tolist()):
        best = None
        for c in open_:
            ld, li = c[-1]
            if i > li and d > ld and i - li <= 90 and d - ld <= 90 and abs((d - i) - (ld - li)) <= 40:
                if best is None or abs((d - i) - (ld - li)) < abs((d - i) - (best[-1][0] - best[-1][1])):
                    best = c
        if best is None:
            open_.append([(d, i)])
        else:
            best.append((d, i))
    return sorted(open_, key=len, reverse=True)


def _agree(a: list[str], b: list[str], band: int) -> int:
    """Most words of a that meet an equal word of b in order, off the stretched diagonal by `band` words at most."""
    n, m = len(a), len(b)
    slope = m / max(n, 1)
    prev = [0] * (m + 1)
    for i in range(1, n + 1):
        mid = int(i * slope)
        lo, hi = max(1, mid - band), min(m, mid + band)
        cur = prev[:]
        x = a[i - 1]
        run = cur[lo - 1]
        for j in range(lo, hi + 1):
            v = prev[j - 1] + 1 if x == b[j - 1] else (prev[j] if prev[j] > run else run)
            cur[j] = v
            run = v
        for j in range(hi + 1, m + 1):
            if cur[j] >= run:
                break
            cur[j] = run
        prev = cur
    return prev[m]


def held_words(index: Index, i: int, words: list[str], at: np.ndarray, pd_: np.ndarray, pi: np.ndarray) -> int:
    """How many of item i's words the document holds in its two best stretches, of all there are. A stretch of the item
    that lies within one already found adds nothing and is not aligned, so repeats cost nothing."""
    iw, ia = index.words[i], index.at[i]
    least = min(3, int(index.size[i]) - Q + 1)
    got: list[tuple[int, int]] = []
    for c in _chains(pd_, pi):
        if len(c) < least:
            break
        i0, i1 = int(np.searchsorted(ia, c[0][1], "left")), int(np.searchsorted(ia, c[-1][1] + Q, "right")) - 1
        if i1 - i0 < 1 or any(a <= i0 and i1 <= b for a, b in got):
            continue
        d0, d1 = np.searchsorted(at, c[0][0], "left"), np.searchsorted(at, c[-1][0] + Q, "right") - 1
        if d1 - d0 >= 1 and _agree(iw[i0:i1], words[d0:d1], 12) >= AGREE * (i1 - i0):
            got.append((i0, i1))
    best = 0
    for x, (a, b) in enumerate(got):
        best = max(best, b - a, *(b - a + d - c - max(0, min(b, d) - max(a, c)) for c, d in got[:x]))
    return best


def whole_items(index: Index, words: list[str]) -> set[int]:
    """the items of fewer letters than a q-gram has that occur whole"""
    return {i for k, w in enumerate(words) for i in index.short.get(w, ()) if words[k : k + len(index.words[i])] == index.words[i]}


def leaks(docs: DataFrame, items: DataFrame, block_chars: int = 4_000_000, shares: bool = False) -> DataFrame:
    """(item_id, doc_id) [, share]: every document that holds at least half of the item's words in one or two stretches."""
    spark = docs.sparkSession
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in items.filter("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").toLocalIterator():
        if size > block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((r["item_id"], r["text"]))
        size += len(r["text"])
    schema = "item_id long, doc_id long, share double"
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = Index(shared.value)
            for b in batches:
                ids = b["doc_id"].tolist()
                for lo in range(0, len(ids), 1000):
                    split = [stream(x) for x in b["text"].iloc[lo : lo + 1000]]
                    rows = []
                    for d, i, pd_, pi in index.candidates([s[0] for s in split]):
                        n = held_words(index, i, split[d][1], np.array([*split[d][2], len(split[d][0])]), pd_, pi)
                        share = n / len(index.words[i])
                        if share >= (COVER if len(index.words[i]) >= 8 else 1.0) or shares:
                            rows.append((index.ids[i], ids[lo + d], share))
                    if index.short:
                        rows += [(index.ids[i], ids[lo + d], 1.0) for d, x in enumerate(split) for i in whole_items(index, x[1])]
                    yield pd.DataFrame(rows, columns=["item_id", "doc_id", "share"])

        got = spread(docs.select("doc_id", "text").filter("length(trim(text)) > 0")).mapInPandas(run, schema)
        out = got if out is None else out.unionByName(got)
    return out if shares else out.select("item_id", "doc_id")


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per split of the items: how many there are, how many leaked, and into how many documents."""
    from pyspark.sql import functions as F

    hit = leaks(docs, items).groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs"))
    return items.select("item_id", "split").join(hit, "item_id", "left").groupBy("split").agg(F.count("*").alias("n_items"), F.count("docs").alias("n_leaked"), F.coalesce(F.sum("docs"), F.lit(0)).alias("n_docs"))
