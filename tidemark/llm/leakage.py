"""Evaluation texts in training text.

The test items, cut into overlapping segments, form a BM25 inverted index whose terms are pairs of neighbouring words; every
passage of the corpus is a query against it, answered by block-max WAND with all segments above their threshold. A segment's
threshold is the least score that a case within it can have, so nothing is lost however long, frequent or repetitive it is.
What is retrieved is verified by an alignment of words. The corpus is read in place; only the index travels.

A case is a stretch of at least `least` item words whose first and last word the text holds, with at most one edit in per_edit words.
Why segments suffice: let such a stretch have n words and e edits. It can be cut between two of its matches, what lies between left
out; the parts have no more edits to a word than the whole, so one of them keeps the condition. Both have `least` words as
long as n - e >= 2 * least. So a case exists if and only if a short one does, of longest(least, per_edit) words at most.
"""

from __future__ import annotations

import bisect
import html
import math
import pickle
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

_TAG = re.compile(r"<[/!a-zA-Z][^<>]{0,200}>")
_BREAK = re.compile(r"(?<=\w)-[ \t]*\r?\n[>\s]*(?=\w)")
_WORD = re.compile(r"[a-z0-9]+")
_FOLD = str.maketrans({"’": "'", "‘": "'", "œ": "oe", "æ": "ae", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "­": None, "​": None, "‌": None, "‍": None, "﻿": None})


def words(text: str) -> list[str]:
    """The words of a text: case, accents, punctuation, spacing, markup and line breaks (with hyphens) do not count."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "-" in text:
        text = _BREAK.sub("", text)
    text = text.lower().replace("*", "").replace("_", " ").replace("`", "")
    if not text.isascii():
        text = text.translate(_FOLD)
        text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return _WORD.findall(text)


def longest(least: int, per_edit: int) -> int:
    """The most item words of a case that holds no shorter one."""
    return max(n for n in range(least, 3 * least) if n - n // per_edit < 2 * least)


class Index:
    """BM25 over bigrams of segments of the items; scores are in units of the segment's threshold, with the maximum of each block of postings.

    A segment of 2 * longest words begins every `longest` + 1 words, so that any case of at most `longest` item words lies within one. Segments whose threshold a single pair could reach (what they share with others leaves them
    no telling pairs) are found by the runs of words that every case holds unchanged, which is as exact.
    """

    K1, B, BLOCK = 1.2, 0.75, 32

    def __init__(self, items: list[tuple[int, str]], least: int = 20, per_edit: int = 6):
        self.least, self.per_edit, self.longest, self.run = least, per_edit, longest(least, per_edit), sure_run(least, per_edit)
        self.vocabulary: dict[str, int] = {}
        self.ids, self.segments = [], []
        for i, text in items:
            t = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], dtype=np.int64)
            for first in range(0, len(t) - least + 1, self.longest + 1):
                self.ids.append(i)
                self.segments.append(t[first : first + 2 * self.longest])
        self.size = max(1, len(self.vocabulary))
        self._runs: dict[int, np.ndarray] = {}
        pairs = [t[:-1] * self.size + t[1:] for t in self.segments]
        frequency = Counter(k for p in pairs for k in np.unique(p).tolist())
        mean, n = sum(map(len, pairs)) / max(1, len(pairs)) or 1.0, len(pairs)
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.by_run: dict[int, list[int]] = defaultdict(list)
        for no, p in enumerate(pairs):
            norm = self.K1 * (1 - self.B + self.B * len(p) / mean)
            score = {k: math.log(1 + (n - frequency[k] + 0.5) / (frequency[k] + 0.5)) * tf * (self.K1 + 1) / (tf + norm) for k, tf in Counter(p.tolist()).items()}
            bound = least_score(p, np.array([score[k] for k in p.tolist()]), least, per_edit)
            if bound <= max(score.values()):
                for k in self.runs_of(no).tolist():
                    self.by_run[k].append(no)
                continue
            for k, x in score.items():
                postings[k].append((no, x / bound))
        self.terms = np.array(sorted(postings), dtype=np.int64)
        self.docs, self.scores, self.most, self.block_most = [], [], [], []
        for term in self.terms.tolist():
            docs, score = [d for d, _ in postings[term]], [x for _, x in postings[term]]
            self.docs.append(docs)
            self.scores.append(score)
            self.most.append(max(score))
            self.block_most.append([max(score[i : i + self.BLOCK]) for i in range(0, len(score), self.BLOCK)])

    def runs_of(self, n: int) -> np.ndarray:
        """Keys of the segment's runs of words that any case holds one of, kept once computed."""
        if n not in self._runs:
            self._runs[n] = np.unique(_runs(self.segments[n], self.run))
        return self._runs[n]

    def numbers(self, text: list[str]) -> np.ndarray:
        """The text in word numbers, -1 for words of no item."""
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in text], dtype=np.int64)

    def hits(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the text's pairs that are terms, and these terms."""
        if len(t) < 2 or not len(self.terms):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        key = np.where((t[:-1] >= 0) & (t[1:] >= 0), t[:-1] * self.size + t[1:], -1)
        at = np.minimum(np.searchsorted(self.terms, key), len(self.terms) - 1)
        place = np.flatnonzero(self.terms[at] == key)
        return place, at[place]

    def above(self, terms: list[int], threshold: float) -> dict[int, float]:
        """Block-max WAND: every segment whose score for the query is the threshold at least."""
        lists = [[self.docs[t], self.scores[t], self.most[t], self.block_most[t], 0] for t in terms]
        out: dict[int, float] = {}
        while lists:
            lists.sort(key=lambda c: c[0][c[4]])
            total, pivot = 0.0, -1
            for n, c in enumerate(lists):
                total += c[2]
                if total >= threshold:
                    pivot = n
                    break
            if pivot < 0:
                break
            doc = lists[pivot][0][lists[pivot][4]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][4]] == doc:
                pivot += 1
            # the bound by the blocks that hold doc
            bound, past = 0.0, None
            for c in lists[: pivot + 1]:
                at = bisect.bisect_left(c[0], doc, c[4])
                if at < len(c[0]):
                    block = at // self.BLOCK
                    bound += c[3][block]
                    end = c[0][min(len(c[0]), (block + 1) * self.BLOCK) - 1] + 1
                    past = end if past is None else min(past, end)
            if bound >= threshold:
                if lists[0][0][lists[0][4]] == doc:
                    score = sum(c[1][c[4]] for c in lists[: pivot + 1] if c[0][c[4]] == doc)
                    if score >= threshold:
                        out[doc] = score
                target = doc + 1 if lists[0][0][lists[0][4]] == doc else doc
            else:
                # no item up to the end of the nearest block, or to the next list's item, can reach the threshold
                target = past if past is not None else doc + 1
                if pivot + 1 < len(lists):
                    target = min(target, lists[pivot + 1][0][lists[pivot + 1][4]])
                target = max(target, doc + 1)
            for c in lists[: pivot + 1]:
                if c[0][c[4]] < target:
                    c[4] = bisect.bisect_left(c[0], target, c[4])
            lists = [c for c in lists if c[4] < len(c[0])]
        return out


def least_score(pairs: np.ndarray, score: np.ndarray, least: int, per_edit: int) -> float:
    """The least sum of scores of distinct pairs that a case within the segment shares with a text.

    An edit breaks two pairs at most: of every stretch, all distinct pairs but the 2e that weigh most. Of the lengths that allow e
    edits only the shortest counts, as more words only add pairs.
    """
    where: dict[int, int] = {}
    last = np.array([(where.get(k, -1), where.__setitem__(k, i))[0] for i, k in enumerate(pairs.tolist())])
    out = math.inf
    for e in range(least // per_edit, longest(least, per_edit) // per_edit + 1):
        n = max(least, e * per_edit) - 1  # pairs of the stretch
        if n > len(pairs):
            break
        first = np.arange(len(pairs) - n + 1)[:, None]
        at = first + np.arange(n)
        weight = np.where(last[at] >= first, 0.0, score[at])  # a repeated pair counts once
        kept = np.sort(weight, axis=1)[:, : max(0, n - 2 * e)]
        out = min(out, float(kept.sum(axis=1).min()))
    return out


def aligned(item: np.ndarray, text: np.ndarray, least: int, per_edit: int) -> bool:
    """Whether text holds `least` consecutive words of item with at most one in per_edit changed, dropped or added, the first and last unchanged.

    Exact: for every place of the item at which a stretch may begin, the least edits of its first m words against any stretch of
    the text that begins with the same word, for all places at once, m growing to `longest`.
    """
    n, far = len(item), 1 << 20
    if n < least or not len(text):
        return False
    ramp = np.arange(len(text) + 1, dtype=np.int32)
    d = np.full((n - least + 1, len(text) + 1), far, dtype=np.int32)
    d[:, 1:][item[: len(d), None] == text[None, :]] = 0
    d = np.minimum.accumulate(d - ramp, axis=1) + ramp
    for m in range(2, min(n, longest(least, per_edit)) + 1):
        d = d[: n - m + 1]
        other = item[m - 1 : m - 1 + len(d), None] != text[None, :]
        if m >= least and int((d[:, :-1] + other * far).min()) * per_edit <= m:
            return True
        new = d + 1  # a word of the item dropped
        np.minimum(new[:, 1:], d[:, :-1] + other, out=new[:, 1:])
        d = np.minimum.accumulate(new - ramp, axis=1) + ramp  # words added
    return False


def sure_run(least: int, per_edit: int) -> int:
    """Words that any stretch within the condition holds unchanged in a row: e edits leave e + 1 runs."""
    return max(1, min(math.ceil((n - n // per_edit) / (n // per_edit + 1)) for n in range(least, least * per_edit + 1)))


def _runs(t: np.ndarray, r: int) -> np.ndarray:
    """Keys of r words in a row; wrapping around is harmless, as equal runs keep equal keys."""
    if len(t) < r:
        return np.empty(0, dtype=np.int64)
    key = np.zeros(len(t) - r + 1, dtype=np.int64)
    known = np.ones(len(key), dtype=bool)
    for i in range(r):
        part = t[i : len(t) - r + 1 + i]
        key = key * np.int64(1_000_003) + part
        known &= part >= 0
    return np.where(known, key, -1)


def _leaks(index: Index, text: list[str], window: int, brute: bool = False) -> list[int]:
    """The ids of the items that leak into the text."""
    t, least, per_edit = index.numbers(text), index.least, index.per_edit
    if brute:
        return sorted({index.ids[n] for n, s in enumerate(index.segments) if aligned(s, t, least, per_edit)})
    out: set[int] = set()
    if len(t) < least - least // per_edit:
        return []
    place, term = index.hits(t)
    run = _runs(t, index.run)
    shared = [n for n, k in enumerate(run.tolist()) if k in index.by_run] if index.by_run else []
    step = window - index.longest - index.longest // per_edit  # any case lies within one window
    for first in range(0, max(1, len(t) - window + step), step):
        lo, hi = np.searchsorted(place, [first, first + window - 1])
        terms = sorted(set(term[lo:hi].tolist()))
        found = list(index.above(terms, 1 - 1e-9)) if sum(index.most[k] for k in terms) >= 1 - 1e-9 else []
        if shared:
            lo, hi = bisect.bisect_left(shared, first), bisect.bisect_left(shared, first + window - index.run + 1)
            found += sorted({n for i in shared[lo:hi] for n in index.by_run[int(run[i])]})
        for n in found:
            if index.ids[n] in out:
                continue
            # an exact check before the alignment: a run that every case holds unchanged
            if np.isin(run[first : first + window - index.run + 1], index.runs_of(n)).any() and aligned(index.segments[n], t[first : first + window], least, per_edit):
                out.add(index.ids[n])
    return sorted(out)


def find(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int = 20, per_edit: int = 6, window: int = 96, block_bytes: int = 4_000_000, blocks_a_pass: int = 8, brute: bool = False) -> DataFrame:
    """(doc_id, item_id) for each document that holds `least` words of an item in order, up to one in per_edit changed, dropped or added.

    Null ids or texts and empty texts hold nothing and are held by nothing; items shorter than `least` words cannot leak.
    Repeated rows of a table give a pair once; of an item with several texts the least counts. Documents are read whole, whatever
    their length. Other columns are ignored.

    items is a stated query set. Blocks of some block_bytes of its texts are indexed by tasks of their own, whatever their number, and
    broadcast; a pass over the documents meets blocks_a_pass of them, which bounds what a worker holds. Blocks and passes change no
    result, as a segment's threshold is exact in any block. brute: align every segment with every text, for tests.
    """
    if window <= longest(least, per_edit) * (1 + 1 / per_edit):
        raise ValueError("window is too short for the longest case")
    spark = docs.sparkSession
    ship(spark)
    held = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).groupBy(F.col(item_id).alias("_id")).agg(F.min(item_text).alias("_text"))
    size = held.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))

    def build(g: pd.DataFrame) -> pd.DataFrame:
        index = Index(sorted(zip(g["_id"].tolist(), g["_text"])), least, per_edit)
        return pd.DataFrame({"_index": [pickle.dumps(index, protocol=pickle.HIGHEST_PROTOCOL)]})

    dealt = held.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(blocks))).repartition(blocks, "_b")
    built = dealt.groupBy("_b").applyInPandas(build, "_index binary")
    shared = [spark.sparkContext.broadcast(bytes(r[0])) for r in built.toLocalIterator()]  # one block at a time
    docs = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(doc_id, text)
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}"
    out = spark.createDataFrame([], schema)
    for k in range(0, len(shared), blocks_a_pass):

        def scan(batches: Iterator[pd.DataFrame], part=shared[k : k + blocks_a_pass]) -> Iterator[pd.DataFrame]:
            indexes = [pickle.loads(b.value) for b in part]
            for b in batches:
                split = [words(t) for t in b[text]]
                found = [(d, i) for ix in indexes for d, t in zip(b[doc_id], split) for i in _leaks(ix, t, window, brute)]
                yield pd.DataFrame(found, columns=[doc_id, item_id])

        out = out.unionByName(docs.mapInPandas(scan, schema)) if k else docs.mapInPandas(scan, schema)
    return out.distinct()
