"""Periodic run detection on word sequences, through a grammar.

Each text's word ids are compressed by Re-Pair: the most frequent pair of
neighbouring symbols becomes a new symbol until no pair occurs twice; pairs
that no more frequent one overlaps are replaced in the same round.  A run lies
inside the least symbol that covers it and crosses the boundary between its two
halves, so runs are computed once per symbol, across that boundary, and
translated to every place where the symbol stands; what a neighbouring word
extends is left out there, as a larger symbol has the whole of it.  The start
symbol is halved recursively in the same way.

A run is a stretch of words with smallest period ``q``, at least ``max(least,
2 * q)`` long, that no neighbouring word extends.  Collapsing drops every word
that some run contains after its first ``q`` words.

Texts are worked on inside the scan, some megabytes at a time and each text as
a whole; nothing is shuffled.  Words are compared as such; extensions are found
by hashes and then compared word by word.

Defined results: NULL and empty texts have no words and no runs; rows that
repeat an id or a text are judged one by one; NULL ids are kept; an empty table
gives no rows; columns other than those named in ``keep`` are ignored, and
kept ones called like an added one are replaced by it.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.llm.arrow import BASE, mix, pieces, powers, record_batches, tidy, utf8
from triagelake.llm.names import fresh

LEAST = 12
# Bytes of text and candidate places worked on at once.
CHUNK = 2 << 20
BLOCK = 1 << 19
RUN = ("start", "length", "period")


def word_ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, equal only for equal words of one text, and where each text begins."""
    cuts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=cuts[1:])
    ids = np.empty(cuts[-1], np.int64)
    for t, a, b in zip(texts, cuts[:-1].tolist(), cuts[1:].tolist()):
        ids[a:b] = np.fromiter(map({}.setdefault, t, itertools.count(a)), np.int64, b - a)
    return ids, cuts


def repair(ids: np.ndarray, cuts: np.ndarray, least: int):
    """Re-Pair of every text at once.

    Returns the places ``left, middle, right`` of each symbol of ``least``
    words or more at its first place, the symbol and place of all its
    occurrences, and the boundaries that stay in the start symbols.
    """
    n = len(ids)
    outer = np.ones(n + 1, bool)
    symbol, at = ids, np.arange(n)
    width = np.ones(n, np.int64)
    # live[i]: symbols i and i + 1 stand together and their pair may occur again.
    live = np.ones(n, bool)
    live[cuts[1:][cuts[1:] > 0] - 1] = False
    top, nodes, places, made = max(n, 1), [], [], 0
    while True:
        i = np.flatnonzero(live)
        if not len(i):
            break
        pair = symbol[i] * top + symbol[i + 1]
        kinds, kind = np.unique(pair, return_inverse=True)
        # Of pairs that overlap themselves, every second one counts.
        follows = np.zeros(len(i), bool)
        follows[1:] = (i[1:] == i[:-1] + 1) & (kind[1:] == kind[:-1])
        t = np.arange(len(i))
        even = (t - np.maximum.accumulate(np.where(follows, 0, t))) % 2 == 0
        count = np.bincount(kind[even], minlength=len(kinds))
        again = count[kind] > 1
        # A pair that stands alone never becomes a part of one that does not.
        live[i[~again]] = False
        rank = np.empty(len(kinds), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(kinds))
        order = np.where(even & again, rank[kind], len(kinds))
        first = order < len(kinds)
        near = i[1:] == i[:-1] + 1
        first[1:] &= ~near | (order[1:] < order[:-1])
        first[:-1] &= ~near | (order[:-1] < order[1:])
        used = np.bincount(kind[first], minlength=len(kinds)) > 1
        first &= used[kind]
        if first.any():
            i, kind = i[first], (np.cumsum(used) - 1)[kind[first]]
            symbol, width = symbol.copy(), width.copy()
            left, middle = at[i], at[i + 1]
            right = middle + width[i + 1]
            outer[middle] = False
            symbol[i] = top + kind
            width[i] += width[i + 1]
            live[i] = live[i + 1]
            top += int(used.sum())
            keep = np.ones(len(symbol), bool)
            keep[i + 1] = False
            symbol, at, width, live = symbol[keep], at[keep], width[keep], live[keep]
            long = right - left >= least
            if long.any():
                some, one, mine = np.unique(kind[long], return_index=True, return_inverse=True)
                nodes.append(np.stack([left, middle, right])[:, long][:, one])
                places.append(np.stack([made + mine, left[long]]))
                made += len(some)
        # Symbols with nothing left to pair with stay as they are.
        paired = live.copy()
        paired[1:] |= live[:-1]
        symbol, at, width, live = symbol[paired], at[paired], width[paired], live[paired]
    none = np.zeros((3, 0), np.int64)
    return np.concatenate([none, *nodes], axis=1), np.concatenate([none[:2], *places], axis=1), outer


def halves(cuts: np.ndarray, outer: np.ndarray, least: int) -> np.ndarray:
    """The start symbols, halved again and again at their inner boundaries."""
    outer[cuts] = True
    edge = np.flatnonzero(outer)
    lo, hi = np.searchsorted(edge, cuts[:-1]), np.searchsorted(edge, cuts[1:])
    found = [np.zeros((3, 0), np.int64)]
    while len(lo):
        deep = (hi - lo > 1) & (edge[hi] - edge[lo] >= least)
        lo, hi = lo[deep], hi[deep]
        mid = (lo + hi) // 2
        found.append(np.stack([edge[lo], edge[mid], edge[hi]]))
        lo, hi = np.r_[lo, mid], np.r_[mid, hi]
    return np.concatenate(found, axis=1)


class Extend:
    """How far equal words go on around two places, by hashes of stretches."""

    def __init__(self, ids: np.ndarray):
        self.up = powers(len(ids) + 1)[0]
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix((ids + 1).astype(np.uint64) * np.uint64(BASE)) * self.up[: len(ids)], out=self.sums[1:])

    def same(self, a, n, q):
        """Whether ``n`` words from ``a`` and from ``a + q`` are equal."""
        s = self.sums
        return (s[a + n] - s[a]) * self.up[q] == s[a + q + n] - s[a + q]

    def __call__(self, at, q, limit, step):
        """Equal words after (``step`` 1) or before (-1) ``at`` and ``at + q``, at most ``limit``."""
        low, high = np.zeros_like(limit), limit.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            a, d = at[open_], q[open_]
            m = (low[open_] + high[open_] + 1) // 2
            ok = self.same(a if step > 0 else a - m, m, d)
            low[open_[ok]] = m[ok]
            high[open_[~ok]] = m[~ok] - 1
            open_ = open_[low[open_] < high[open_]]
        return low


def crossing(ids: np.ndarray, nodes: np.ndarray, least: int) -> np.ndarray:
    """``node, start, end, period`` of the runs across each node's middle."""
    extend, found = Extend(ids), [np.zeros((4, 0), np.int64)]
    most = (nodes[2] - nodes[0]) // 2
    # Large nodes go through their periods in parts.
    parts = np.maximum(1, -(-most // BLOCK))
    node = np.repeat(np.arange(len(most)), parts)
    begin = (np.arange(len(node)) - np.repeat(np.cumsum(parts) - parts, parts)) * BLOCK
    share = np.minimum(most[node] - begin, BLOCK)
    total = np.r_[0, np.cumsum(share)]
    i = 0
    while i < len(node):
        j = max(i + 1, int(np.searchsorted(total, total[i] + BLOCK, side="right")) - 1)
        n = np.repeat(np.arange(i, j), share[i:j])
        q = np.arange(len(n)) - (total[n] - total[i]) + begin[n] + 1
        n = node[n]
        left, middle, right = nodes[0, n], nodes[1, n], nodes[2, n]
        # Words a period apart agree one period before the middle, or just before it.
        for at, inside in ((middle - q, middle - q >= left), (middle - 1, middle - 1 + q < right)):
            hit = np.flatnonzero(inside)
            hit = hit[ids[at[hit]] == ids[at[hit] + q[hit]]]
            a, p, lo, hi = at[hit], q[hit], left[hit], right[hit] - q[hit]
            # They agree in six places on end at least.
            after = np.minimum(a + 1, hi - 1)
            before = np.maximum(a - 1, lo)
            more = (ids[after] == ids[after + p]) | (ids[before] == ids[before + p])
            hit, a, p, lo, hi = hit[more], a[more], p[more], lo[more], hi[more]
            start = a - extend(a, p, a - lo, -1)
            end = a + extend(a, p, hi - a, 1) + p
            ok = end - start >= np.maximum(least, 2 * p)
            found.append(np.stack([n[hit[ok]], start[ok], end[ok], p[ok]]))
        i = j
    runs = np.concatenate(found, axis=1)
    runs = runs[:, np.lexsort((runs[3], runs[2], runs[1], runs[0]))]
    # Of one stretch's periods the smallest.
    least_period = np.ones(runs.shape[1], bool)
    least_period[1:] = (runs[:3, 1:] != runs[:3, :-1]).any(axis=0)
    return runs[:, least_period]


def plain(ids: np.ndarray, least: int) -> np.ndarray:
    """``start, end, period`` of all runs of one text, by comparing it with itself at every shift."""
    found = {}
    for q in range(1, len(ids) // 2 + 1):
        same = np.r_[False, ids[q:] == ids[:-q], False]
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s + q >= max(least, 2 * q):
                found.setdefault((s, e + q), q)
    return np.array([(s, e, q) for (s, e), q in sorted(found.items())], np.int64).reshape(-1, 3).T


def all_runs(ids: np.ndarray, cuts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """``start, end, period`` of all runs of all texts, by start and period."""
    ruled, places, outer = repair(ids, cuts, least)
    nodes = np.concatenate([ruled, halves(cuts, outer, least)], axis=1)
    node, start, end, q = crossing(ids, nodes, least)
    # Hashes only proposed them.
    proposed = enumerate(zip(start.tolist(), end.tolist(), q.tolist()))
    wrong = [k for k, (s, e, p) in proposed if not np.array_equal(ids[s : e - p], ids[s + p : e])]
    # Every node stands at its own place, a symbol at all of its places.
    shift = np.concatenate([places[1] - ruled[0, places[0]], np.zeros(nodes.shape[1] - ruled.shape[1], np.int64)])
    owner = np.concatenate([places[0], np.arange(ruled.shape[1], nodes.shape[1])])
    order = np.argsort(owner, kind="stable")
    shift, many = shift[order], np.bincount(owner, minlength=nodes.shape[1])
    first = np.cumsum(many) - many
    times = many[node]
    k = np.repeat(np.arange(len(node)), times)
    by = shift[first[node[k]] + np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)]
    start, end, q = start[k] + by, end[k] + by, q[k]
    text = np.searchsorted(cuts, start, side="right") - 1
    low, high = cuts[text], cuts[text + 1]
    whole = (start == low) | (ids[np.maximum(start - 1, 0)] != ids[np.maximum(start - 1, 0) + q])
    after = np.minimum(end, len(ids) - 1)
    whole &= (end == high) | (ids[after] != ids[after - q])
    runs = np.stack([start, end, q])[:, whole]
    bad = np.unique(np.searchsorted(cuts, nodes[0, node[wrong]], side="right") - 1)
    if len(bad):
        t = np.searchsorted(cuts, runs[0], side="right") - 1
        again = [plain(ids[cuts[b] : cuts[b + 1]], least) + np.array([[cuts[b]], [cuts[b]], [0]]) for b in bad]
        runs = np.concatenate([runs[:, ~np.isin(t, bad)], *again], axis=1)
    runs = runs[:, np.lexsort((runs[1], runs[2], runs[0]))]
    once = np.ones(runs.shape[1], bool)
    once[1:] = (runs[:, 1:] != runs[:, :-1]).any(axis=0)
    return runs[:, once]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats."""
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, end, q in runs:
            drop[start + q] += 1
            drop[end] -= 1
        keep = np.cumsum(drop[:-1]) == 0
        words = list(itertools.compress(words, keep.tolist()))
    return b" ".join(words)


def detect(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST) -> DataFrame:
    """``keep`` columns, ``n_words``, ``runs`` by start and period, and the ``collapsed`` text."""
    added = ("n_words", "runs", "collapsed")
    keep = [c for c in keep if c not in added]
    body = fresh("body", keep)
    df = df.select(*keep, F.col(text).alias(body))
    run = T.StructType([T.StructField(c, T.LongType()) for c in RUN])
    schema = T.StructType([df.schema[c] for c in keep]).add("n_words", T.LongType())
    schema = schema.add("runs", T.ArrayType(run)).add("collapsed", T.StringType())

    def task(batches):
        for batch in record_batches(batches):
            data, off = utf8(batch.column(body))
            for i, j in pieces(off, CHUNK):
                texts = [data[off[r] : off[r + 1]].tobytes().split() for r in range(i, j)]
                ids, cuts = word_ids(texts)
                start, end, q = all_runs(ids, cuts, least)
                mine = np.searchsorted(start, cuts)
                runs = list(zip(start.tolist(), end.tolist(), q.tolist()))
                kept = [
                    collapsed(t, [(s - c, e - c, p) for s, e, p in runs[a:b]])
                    for t, c, a, b in zip(texts, cuts.tolist(), mine[:-1].tolist(), mine[1:].tolist())
                ]
                base = np.repeat(cuts[:-1], np.diff(mine))
                flat = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - start), pa.array(q)], names=list(RUN))
                part = batch.slice(i, j - i)
                yield pa.record_batch(
                    [
                        *[part.column(c) for c in keep],
                        pa.array(np.diff(cuts)),
                        pa.ListArray.from_arrays(pa.array(mine.astype(np.int32)), flat),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=schema.names,
                )

    return df.mapInArrow(tidy(task), schema)
