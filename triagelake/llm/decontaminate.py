"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into windows of two sizes that start every few
characters, so a verbatim quote of ``LONGEST_MISS`` + 1 characters holds a
whole window wherever it starts.  A window of ``m`` characters that occurs in
a text with at most ``k`` edits shares at least ``m + 1 - (k + 1) * q`` of its
q-grams with it, all on diagonals that differ by ``k`` at most.  Q-grams that
a text shares with an item are counted in diagonal bands that overlap by half,
and in bands with enough of them window by window; windows that reach the
bound are verified by a banded alignment.  All texts are compared with the
stated set of items, in blocks of bounded size.

An item that fits one large window is compared as a whole, and its small
windows count verbatim only.  Items under ``LEAST`` characters count verbatim
as a whole.  Letters are compared without case and white space as one kind.
Spans are in code points, the end exclusive; the edits of a place are the
least of its largest windows.

Defined results: NULL, empty and blank texts and items match nothing; repeated
rows are reported each; an empty table gives no rows; only the named columns
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.llm.arrow import bounds as bounds_of
from triagelake.llm.arrow import record_batches, tidy

Q = 8
WINDOW, HOP = 100, 50
QUOTE, STRIDE = 50, 10
LONGEST_MISS = QUOTE + STRIDE - 2
RATE = 0.08
LEAST = 24
# Twice the most edits of a window, so that half a band holds all its diagonals.
BAND = 16
BLOCK_CHARS = 2_000_000
CHUNK = 1 << 18
MOST_HITS = 1 << 21
FILTER_BITS = 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def case_table() -> np.ndarray:
    """Lower case of every two-byte character that has one of one character."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        low = chr(c).lower()
        table[c] = 32 if chr(c).isspace() else ord(low) if len(low) == 1 else c
    return table


def codes(text: str, table: np.ndarray) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < len(table), table[np.minimum(c, len(table) - 1)], c)


def grams(c: np.ndarray) -> np.ndarray:
    """Every q-gram as eight folded bytes in one number."""
    x = (c % np.uint32(251)).astype(np.uint64) + np.uint64(1)
    x[c == 0] = 0
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step)) if len(x) > step else x[:0]
    return x


def windows_of(n: int) -> list[tuple[int, int, int]]:
    """``start, size, edits`` of the windows of an item of ``n`` characters, by start."""
    if n < LEAST:
        return [(0, n, 0)]
    out = set()
    for size, stride in ((WINDOW, HOP), (QUOTE, STRIDE)):
        last = max(0, n - size)
        edits = int(min(n, size) * RATE) if n > WINDOW or n <= size else 0
        out |= {(s, min(n, size), edits) for s in (*range(0, last, stride), last)}
    return sorted(out)


class Index:
    """The windows of a block of items, and the items' q-grams in order."""

    def __init__(self, items: list[tuple[int, str]]):
        self.table = case_table()
        self.items, body, window, gram, item, offset = [], [], [], [], [], []
        short, at = {}, 0
        for name, text in items:
            c = codes(text or "", self.table)
            if (c == 32).all():
                continue
            if len(c) < Q:
                short.setdefault(len(c), []).append((name, c))
                continue
            g = grams(c)
            gram.append(g)
            item.append(np.full(len(g), len(self.items)))
            offset.append(np.arange(len(g)))
            window.append(np.array(windows_of(len(c)), np.int64))
            body.append(c)
            self.items.append((name, at))
            at += len(c)
        self.short = {n: self.short_index(some) for n, some in short.items()}
        if not self.items:
            return
        self.body, self.longest = np.concatenate(body), max(map(len, body))
        self.cut = np.cumsum([0, *map(len, window)])
        self.of = np.repeat(np.arange(len(window)), np.diff(self.cut))
        self.start, self.size, self.edits = np.concatenate(window).T.copy()
        self.least = np.maximum(1, self.size + 1 - (self.edits + 1) * Q)
        self.fewest = np.minimum.reduceat(self.least, self.cut[:-1])
        gram, item, offset = map(np.concatenate, (gram, item, offset))
        order = np.argsort(gram, kind="stable")
        self.gram, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.item, self.offset = item[order], offset[order]
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[self.slot(self.gram)] = True

    @staticmethod
    def short_index(some):
        """Items of one length under ``Q``: their starts of q-grams in order, names and characters."""
        g = np.array([grams(np.r_[c, np.zeros(Q - len(c), np.uint32)])[0] for _, c in some])
        order = np.argsort(g, kind="stable")
        return g[order], [some[i][0] for i in order], np.array([some[i][1] for i in order])

    def search_short(self, c, bounds):
        """Verbatim places of the items that have no q-gram."""
        g = grams(np.r_[c, np.zeros(Q - 1, np.uint32)])
        for n, (gram, names, body) in self.short.items():
            x = g & np.uint64((1 << 8 * n) - 1)
            low, high = np.searchsorted(gram, x), np.searchsorted(gram, x, side="right")
            for p in np.flatnonzero(high > low).tolist():
                row = int(np.searchsorted(bounds, p, side="right")) - 1
                for i in range(low[p], high[p]):
                    if (c[p : p + n] == body[i]).all():
                        yield row, names[i], int(p - bounds[row]), int(p - bounds[row] + n), 0, n

    @staticmethod
    def slot(gram: np.ndarray) -> np.ndarray:
        return ((gram * MULTIPLIER) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def search(self, c: np.ndarray, bounds: np.ndarray):
        """``(row, item, start, end, edits, size)`` of every verified place in joined texts.

        ``bounds`` are the rows' starts in ``c``; a zero stands between rows.
        """
        if self.short:
            yield from self.search_short(c, bounds)
        g = grams(c)
        if not len(g) or not self.items:
            return
        at = np.flatnonzero(self.seen[self.slot(g)])
        which = np.searchsorted(self.gram, g[at])
        which[which == len(self.gram)] = 0
        ok = self.gram[which] == g[at]
        bands = (len(c) + self.longest) // BAND + 2
        found = set()
        for pos, gram in self.parts(at[ok], which[ok]):
            n = self.count[gram]
            entry = np.repeat(self.first[gram] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            p, item, offset = np.repeat(pos, n), self.item[entry], self.offset[entry]
            diagonal = p - offset + self.longest
            row = np.searchsorted(bounds, p, side="right") - 1
            pair = (row * len(self.items) + item) * bands
            for shift in (0, BAND // 2):
                key = pair + (diagonal + shift) // BAND
                ordered = np.sort(key)
                cut = bounds_of(ordered)
                full = ordered[cut[:-1]]
                full = full[np.diff(cut) >= self.fewest[full // bands % len(self.items)]]
                if len(full):
                    near = np.searchsorted(full, key)
                    mine = full[np.minimum(near, len(full) - 1)] == key
                    found.update(self.reached(key[mine], offset[mine], bands, shift))
        for i in range(0, len(found := sorted(found)), 256):
            yield from self.verify(c, bounds, found[i : i + 256])

    def reached(self, key, offset, bands, shift):
        """``row, window, least diagonal`` of the windows with enough hits in a band."""
        order = np.lexsort((offset, key))
        key, offset = key[order], offset[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (offset[1:] != offset[:-1])]
        key, offset = key[new], offset[new]
        cut = bounds_of(key).tolist()
        for a, b in zip(cut[:-1], cut[1:]):
            pair, band = divmod(int(key[a]), bands)
            row, item = divmod(pair, len(self.items))
            first, last = self.cut[item], self.cut[item + 1]
            starts = self.start[first:last]
            some = slice(
                first + np.searchsorted(starts, offset[a] - WINDOW), first + np.searchsorted(starts, offset[b - 1], side="right")
            )
            start = self.start[some]
            hits = np.searchsorted(offset[a:b], start + self.size[some] - Q, side="right") - np.searchsorted(offset[a:b], start)
            low = band * BAND - shift - self.longest
            for w in (some.start + np.flatnonzero(hits >= self.least[some])).tolist():
                yield row, w, low + int(self.start[w])

    def parts(self, at, gram):
        """The hits in overlapping parts of bounded count, however repetitive the text."""
        reach = 2 * (WINDOW + BAND)
        if self.count[gram].sum() <= MOST_HITS or at[-1] - at[0] <= 4 * reach:
            yield at, gram
            return
        middle = (at[0] + at[-1]) // 2
        left, right = at <= middle + reach, at >= middle - reach
        yield from self.parts(at[left], gram[left])
        yield from self.parts(at[right], gram[right])

    def verify(self, c, bounds, places):
        """Banded alignment of windows to the text around their band, in step."""
        row, w, low = map(np.array, zip(*places))
        size, k = self.size[w], self.edits[w]
        slack = int(k.max())
        width = BAND + 2 * slack + 1
        at = np.array([self.items[i][1] for i in self.of[w]]) + self.start[w]
        pattern = self.body[np.minimum(at[:, None] + np.arange(int(size.max())), len(self.body) - 1)]
        first, last = bounds[row], np.r_[bounds, len(c) + 1][row + 1] - 1
        base = (low - slack)[:, None] + np.arange(width)
        one = 1 << 16
        ramp = np.arange(width, dtype=np.int32) * np.int32(one)
        cost = np.tile(np.arange(width, dtype=np.int32), (len(w), 1))  # edits, then where it began
        final = np.full((len(w), width), np.iinfo(np.int32).max, np.int32)
        live = np.arange(len(w))
        for i in range(pattern.shape[1]):
            if i % 8 == 0:  # what has too many edits, or was done, is left out from here
                on = (size[live] > i) & (cost.min(axis=1) >> 16 <= k[live])
                live, cost = live[on], cost[on]
                if not len(live):
                    break
                begin, from_, to = base[live], first[live][:, None], last[live][:, None]
            j = begin + i
            same = (j >= from_) & (j < to) & (c[np.clip(j, 0, len(c) - 1)] == pattern[live, i : i + 1].reshape(-1, 1))
            step = cost + np.where(same, np.int32(0), np.int32(one))
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + np.int32(one))
            cost = np.minimum.accumulate(step - ramp, axis=1) + ramp
            done = size[live] == i + 1
            final[live[done]] = cost[done]
        best = final.argmin(axis=1)
        value = final[np.arange(len(w)), best]
        edits, begin = value >> 16, value & (one - 1)
        for i in np.flatnonzero(edits <= k):
            start, end = base[i, begin[i]], base[i, best[i]] + size[i]
            start, end = max(start, first[i]), min(end, last[i])
            name = self.items[self.of[w[i]]][0]
            yield int(row[i]), name, int(start - first[i]), int(end - first[i]), int(edits[i]), int(size[i])


def merged(places):
    """Overlapping places of an item in a row joined; the least edits of their largest windows."""
    out = []
    for r, item, start, end, edits, size in sorted(places):
        if out and out[-1][:2] == [r, item] and start <= out[-1][3]:
            out[-1][3] = max(end, out[-1][3])
            out[-1][4], out[-1][5] = min((edits, size), tuple(out[-1][4:]), key=lambda x: (-x[1], x[0]))
        else:
            out.append([r, item, start, end, edits, size])
    return out


def item_blocks(benchmark: DataFrame, item: str, text: str, block_chars: int):
    """Lists of ``(item, text)`` of about ``block_chars`` characters, one at a time."""
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text"))
    items = items.where(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for b in range(blocks):
        yield [tuple(r) for r in items.where(block == b).distinct().collect()]


def leaks(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``key, item_id, start, end, edits`` of every place of an item in a text."""
    schema = T.StructType([documents.schema[key]])
    for name in ("item_id", "start", "end", "edits"):
        schema = schema.add(name, T.LongType())
    source = documents.select(F.col(key), F.col(text).alias("_text"))
    out = None
    for items in item_blocks(benchmark, item, item_text, block_chars):
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for batch, rows in scan(batches, Index(shared.value), "_text"):
                ids = batch.column(key).take(pa.array([r[0] for r in rows], pa.int64()))
                rest = [pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 5)]
                yield pa.record_batch([ids, *rest], names=schema.names)

        found = source.mapInArrow(tidy(run), schema)
        out = found if out is None else out.union(found)
    return out


def without_leaks(
    documents: DataFrame, benchmark: DataFrame, text: str = "text",
    item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``documents`` whose text holds no item."""
    for items in item_blocks(benchmark, item, item_text, block_chars):
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for batch, rows in scan(batches, Index(shared.value), text):
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in rows]] = False
                yield batch.filter(pa.array(keep))

        documents = documents.mapInArrow(tidy(run), documents.schema)
    return documents


def scan(batches, index: Index, column: str):
    """Batches with the places in their texts, many short texts searched at a time."""
    for batch in record_batches(batches, 8 << 20):
        texts = [t or "" for t in batch.column(column).to_pylist()]
        places, i = [], 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + len(texts[j]) <= CHUNK):
                n += len(texts[j]) + 1
                j += 1
            sizes = np.array([len(t) + 1 for t in texts[i:j]])
            c = codes("\0".join(t.replace("\0", " ") for t in texts[i:j]), index.table)
            found = index.search(c, np.r_[0, np.cumsum(sizes)[:-1]])
            places += [(i + r, *rest) for r, *rest in found]
            i = j
        yield batch, merged(places)
