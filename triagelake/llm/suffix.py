"""Exact substring dedup by suffix arrays built by induced sorting.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts
earlier: in a text of smaller id, or earlier in the same text.  Strings are
judged on the input and never cross texts.

A suffix array of all text would sort mostly what occurs once.  So every
window of ``LENGTH`` bytes is first filed under its anchor, the gram of least
hash in it, which is the same wherever the window occurs; the run of windows
of one anchor is a snippet.  Windows of an anchor that occurs once are unique.
Of snippets that are equal as a whole, all but the first are covered.  What
differs, mostly the ends of repeated passages, goes to shards by anchor; each
shard's bytes get a suffix array (classify suffixes, sort the leftmost-smaller
substrings and, by their names, the reduced string, then induce) and permuted
common prefixes, and windows that are neighbours in the array with a common
prefix of ``LENGTH`` are equal.  Anchors with more bytes than a shard, as those
at the ends of a very common passage, are not sorted: their windows are filed
under hashes of 128 bits of their own.

Defined results: NULL text is empty; rows of NULL id come first; texts of one
id are ordered by a hash of the text; rows equal in id and text count as one
row and get the same result; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.arrow import BYTE, bounds, mix, powers, record_batches, sorted_groups, tidy, utf8
from triagelake.session import checkpoint

LENGTH = 100
GRAM = 20
SLICE = 1 << 19
SHARD_BYTES = 1 << 20
# Windows that occur more often are joined by broadcast; there are few of them.
COMMON = 10_000
ANCHORS = "anchor long, content long, doc long, text_hash long, start long, windows long, found boolean"
FOUND = "doc long, text_hash long, start long, end long, anchor long"
NEVER = np.uint64(2**64 - 1)


# Suffix arrays


def ranks_by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string over a large alphabet."""
    n, rank, step = len(names), names.astype(np.int64), 1
    while True:
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:] if step < n else ahead[:0]
        key = rank * np.int64(n + 2) + ahead + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
        if new.max(initial=0) == n - 1:
            return order
        rank, step = new, 2 * step


def classify(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one is."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    following = np.searchsorted(change, np.arange(n - 1))
    at = change[np.minimum(following, len(change) - 1)]
    small = np.ones(n, bool)
    small[:-1] = text[at] < text[at + 1]
    return small


def induce(text, small, heads, ends, seeds):
    """Suffix array from the sorted ``seeds``, bucket by bucket.

    Suffixes of a bucket are handled in rounds: what they induce into their own
    bucket makes the next round, the rest is appended to its buckets in order.
    """
    n, letters = len(text), len(heads)
    array = np.full(n, -1, np.int64)
    by = text[seeds]
    tail = bounds_by(by, letters)
    front = heads.copy()

    def put(previous, pointer, sign):
        letter = text[previous]
        order = np.argsort(letter, kind="stable")
        letter, previous = letter[order], previous[order]
        count = np.bincount(letter, minlength=letters)
        within = np.arange(len(letter)) - np.repeat(np.cumsum(count) - count, count)
        array[pointer[letter] + sign * within] = previous
        pointer += sign * count

    present = np.flatnonzero(ends > heads)
    for c in present:
        done = heads[c]
        while done < front[c]:
            some, done = array[done : front[c]], front[c]
            previous = some[some > 0] - 1
            put(previous[~small[previous]], front, 1)
        some = seeds[tail[c] : tail[c + 1]]
        previous = some[some > 0] - 1
        put(previous[~small[previous]], front, 1)
    back = ends - 1
    for c in present[::-1]:
        done = ends[c] - 1
        # Suffixes of a bucket that are larger than the next stand before the rest.
        while True:
            low = back[c]
            if done <= low:
                break
            some, done = array[low + 1 : done + 1][::-1], low
            previous = some[some > 0] - 1
            put(previous[small[previous]], back, -1)
        some = array[heads[c] : front[c]][::-1]
        previous = some[some > 0] - 1
        put(previous[small[previous]], back, -1)
    array[0] = n - 1
    return array


def bounds_by(sorted_letters, letters):
    return np.searchsorted(sorted_letters, np.arange(letters + 1))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of small numbers that end in a unique least 0."""
    n, letters = len(text), int(text.max()) + 1
    small = classify(text)
    count = np.bincount(text, minlength=letters)
    ends = np.cumsum(count)
    heads = ends - count
    least = np.zeros(n, bool)
    least[1:] = small[1:] & ~small[:-1]
    places = np.flatnonzero(least)
    if len(places) < 2:
        return induce(text, small, heads, ends, places)
    seeds = places[np.argsort(text[places], kind="stable")]
    first = induce(text, small, heads, ends, seeds)
    sorted_ = first[least[first]]
    # Equal substrings up to the next such place, both included, share a name.
    number = np.full(n, -1, np.int64)
    number[places] = np.arange(len(places))
    size = np.r_[np.diff(places) + 1, 1]
    up, down = powers(n + 1)
    sums = np.r_[np.uint64(0), np.cumsum(mix(text.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)]
    of = mix((sums[places + size] - sums[places]) * down[places] + size.astype(np.uint64))
    of = of[number[sorted_]]
    names = np.empty(len(places), np.int64)
    names[number[sorted_]] = np.r_[0, np.cumsum(of[1:] != of[:-1])]
    order = ranks_by_doubling(names)
    return induce(text, small, heads, ends, places[order])


def common_prefixes(raw: np.ndarray, array: np.ndarray, whole: np.ndarray, most: int) -> np.ndarray:
    """By text place: the common prefix with the suffix before it in the array, ``most`` at most.

    Only for places that are ``whole``, with a whole one before them; else 0.
    """
    n = len(raw)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    before[~whole | ~whole[before]] = -1
    padded = np.r_[raw.astype(np.uint64), np.zeros(most + 8, np.uint64)]
    eight = padded.copy()
    for step in (1, 2, 4):
        eight = eight[:-step] | (eight[step:] << np.uint64(8 * step))
    common = np.zeros(n, np.int64)
    alive = np.flatnonzero(before >= 0)
    for done in range(0, most, 8):
        x, y = eight[alive + done], eight[before[alive] + done]
        differ = x ^ y
        equal = differ == 0
        if not equal.all():
            some = alive[~equal]
            common[some] = done + lowest_byte(differ[~equal])
            alive = alive[equal]
    common[alive] = most
    return np.minimum(common, most)


def lowest_byte(x: np.ndarray) -> np.ndarray:
    """Which byte of each number, from the least, is the first that isn't 0."""
    return np.bitwise_count((x & -x) - np.uint64(1)).astype(np.int64) // 8


# Anchors


def snippets(data: np.ndarray):
    """``anchor, content, start, windows`` of the runs of windows of a text."""
    out = []
    for a in range(0, len(data) - LENGTH + 1, SLICE):
        x = data[a : a + SLICE + LENGTH - 1]
        up, down = powers(len(x) + 1)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(BYTE[x] * up[: len(x)], out=sums[1:])
        n, span = len(x) - GRAM + 1, LENGTH - GRAM + 1
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[:n])
        # The place below the hash: the leftmost of equal grams is the anchor.
        placed = (grams & ~np.uint64(SLICE * 2 - 1)) | np.arange(n, dtype=np.uint64)
        rows = np.r_[placed, np.full(-n % span, NEVER)].reshape(-1, span)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        m = n - span + 1
        least = np.minimum(after[:m], before[span - 1 : span - 1 + m]) & np.uint64(SLICE * 2 - 1)
        cut = bounds(least)
        start, windows = cut[:-1], np.diff(cut)
        at = least[start].astype(np.int64)
        content = mix((sums[start + windows + LENGTH - 1] - sums[start]) * down[start])
        content = mix(content + ((at - start) * 1024 + windows).astype(np.uint64))
        out.append((grams[at], content, start + a, windows))
    return out


def first_of(doc, text_hash, start, *groups):
    """Order by groups, then by precedence; where a group begins; and what of
    it is neither its first row nor the same place as that."""
    order = np.lexsort((start, text_hash, doc, *groups[::-1]))
    head = np.zeros(len(order), bool)
    head[:1] = True
    for g in groups:
        g = g[order]
        head[1:] |= g[1:] != g[:-1]
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    same = (doc[order] == doc[lead]) & (text_hash[order] == text_hash[lead]) & (start[order] == start[lead])
    return order, head, ~same


def anchors(batches):
    """Snippets of texts; of equal ones within a batch, all but the first are found."""
    for batch in record_batches(batches, 16 << 20):
        data, off = utf8(batch.column("_text"))
        doc, text_hash = batch.column("doc").to_numpy(), batch.column("text_hash").to_numpy()
        parts, row = [], []
        for r in np.flatnonzero(np.diff(off) >= LENGTH).tolist():
            for part in snippets(data[off[r] : off[r + 1]]):
                parts.append(part)
                row.append(np.full(len(part[0]), r))
        if not parts:
            continue
        anchor, content, start, windows = (np.concatenate(x) for x in zip(*parts))
        row = np.concatenate(row)
        doc, text_hash = doc[row], text_hash[row]
        order, _, found = first_of(doc, text_hash, start, anchor, content)
        yield snippet_batch(anchor, content, doc, text_hash, start, windows, order[~found], False)
        # Found snippets that follow one another in a text are one place.
        at = np.sort(order[found])
        new = np.ones(len(at), bool)
        new[1:] = (row[at[1:]] != row[at[:-1]]) | (start[at[1:]] != start[at[:-1]] + windows[at[:-1]])
        run = at[new]
        total = np.add.reduceat(windows[at], np.flatnonzero(new)) if len(at) else windows[at]
        windows[run] = total
        spread = mix((start + doc).astype(np.uint64))
        yield snippet_batch(spread, content, doc, text_hash, start, windows, run, True)


def snippet_batch(anchor, content, doc, text_hash, start, windows, at, found):
    columns = [anchor[at].view(np.int64), content[at].view(np.int64), doc[at], text_hash[at], start[at], windows[at], np.full(len(at), found)]
    names = ["anchor", "content", "doc", "text_hash", "start", "windows", "found"]
    return pa.record_batch([pa.array(c) for c in columns], names=names)


def compare_snippets(batches):
    """Places found (NULL anchor), and snippets whose windows are to be compared."""
    for batch in passed_on(batches):
        if isinstance(batch, pa.RecordBatch):
            yield batch
            continue
        anchor, content, doc, text_hash, start, windows = (
            batch.column(c).to_numpy() for c in ("anchor", "content", "doc", "text_hash", "start", "windows")
        )
        order, head, found = first_of(doc, text_hash, start, anchor, content)
        yield places(doc[order][found], text_hash[order][found], start[order][found], windows[order][found], None)
        lead = order[head]
        cut = bounds(anchor[lead])
        many = np.repeat(np.diff(cut) > 1, np.diff(cut))
        lead = lead[many]
        yield places(doc[lead], text_hash[lead], start[lead], windows[lead], anchor[lead])


def passed_on(batches):
    """Places found already, as they come, and tables of the anchors that occur twice."""
    done = []

    def rest():
        for batch in batches:
            found = batch.column("found").to_numpy(zero_copy_only=False)
            if found.any():
                doc, text_hash, start, windows = (batch.column(c).to_numpy()[found] for c in ("doc", "text_hash", "start", "windows"))
                done.append(places(doc, text_hash, start, windows, None))
            yield batch.filter(pa.array(~found))

    for table in sorted_groups(rest(), "anchor"):
        yield from done
        done.clear()
        yield table
    yield from done


def places(doc, text_hash, start, windows, anchor):
    none = pa.nulls(len(doc), pa.int64()) if anchor is None else pa.array(anchor)
    return pa.record_batch(
        [*map(pa.array, (doc, text_hash, start, start + windows + LENGTH - 1)), none],
        names=["doc", "text_hash", "start", "end", "anchor"],
    )


def extract(batches):
    """The bytes of each text's snippets, with the shard they go to."""
    for batch in record_batches(batches, 4 << 20):
        out = {c: [] for c in ("shard", "doc", "text_hash", "start", "bytes")}
        for r in batch.to_pylist():
            body = unpacked(r)
            for w in r["wanted"]:
                out["shard"].append(w["shard"])
                out["doc"].append(r["doc"])
                out["text_hash"].append(r["text_hash"])
                out["start"].append(w["start"])
                out["bytes"].append(body[w["start"] : w["end"]])
        kinds = [pa.int64()] * 4 + [pa.binary()]
        yield pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


def compare_windows(batches):
    """Places of the windows that start earlier too, by each shard's suffix array."""
    for table in sorted_groups(batches, "shard"):
        cut = bounds(table.column("shard").to_numpy())
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            part = table.slice(s, e - s)
            doc, text_hash, start = (part.column(c).to_numpy() for c in ("doc", "text_hash", "start"))
            found = repeated(part.column("bytes").to_pylist(), doc, text_hash, start)
            if len(found[0]):
                yield found_places(*found)


def repeated(bodies: list[bytes], doc, text_hash, start):
    size = np.array([len(b) + 1 for b in bodies])
    first = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(b + b"\0" for b in bodies) + b"\0", np.uint8)
    text = raw.astype(np.int16) + np.int16(2)
    text[first + size - 1] = 1
    text[-1] = 0
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - first[row]
    whole = np.r_[at + LENGTH < size[row], False]
    array = suffix_array(text)
    common = common_prefixes(raw, array, whole, LENGTH)
    array = array[whole[array]]
    joined = common[array] >= LENGTH
    joined[:1] = False
    group = np.cumsum(~joined)
    many = np.zeros(len(array), bool)
    many[1:] |= joined[1:]
    many[:-1] |= joined[1:]
    array, group = array[many], group[many]
    r = row[array]
    place = start[r] + at[array]
    order, _, later = first_of(doc[r], text_hash[r], place, group)
    return doc[r][order][later], text_hash[r][order][later], place[order][later]


def found_places(doc, text_hash, place):
    """Windows at following places of a text as one place."""
    order = np.lexsort((place, text_hash, doc))
    doc, text_hash, place = doc[order], text_hash[order], place[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1]) | (place[1:] != place[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(place)] - 1
    return places(doc[first], text_hash[first], place[first], place[last] - place[first] + 1, None)


# Texts


def packed(batches):
    """Texts compressed, as they are moved twice."""
    for batch in batches:
        data, off = utf8(batch.column("_text"))
        size = np.diff(off)
        bodies = [pa.compress(data[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        yield pa.record_batch(
            [batch.column("doc"), batch.column("text_hash"), pa.array(size), pa.array(bodies, pa.binary())],
            names=["doc", "text_hash", "n_bytes", "body"],
        )


def unpacked(row) -> bytes:
    return pa.decompress(row["body"], row["n_bytes"], codec="zstd", asbytes=True) if row["n_bytes"] else b""


def merged(ranges):
    """Sorted ranges with overlapping and adjoining ones joined."""
    out = []
    for start, end in sorted((r["start"], r["end"]) for r in ranges or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return out


def cut_out(batches):
    """Each text without its places."""
    for batch in record_batches(batches, 4 << 20):
        doc, kept, removed, spans, size = [], [], [], [], []
        for r in batch.to_pylist():
            body, runs = unpacked(r), merged(r["ranges"])
            kept.append(b"".join(body[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(body)])))
            removed.append(sum(e - s for s, e in runs))
            spans.append([{"start": s, "end": e} for s, e in runs])
            size.append(len(body))
            doc.append(r["doc"])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch(
            [pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
            names=["doc", "n_bytes", "n_removed", "spans", "kept"],
        )


def repeated_windows(bodies: DataFrame, common: int) -> DataFrame:
    """Places of the windows of snippets that start earlier too, by hashes of the windows."""
    at = F.explode(F.sequence(F.lit(0), F.length("bytes") - LENGTH)).alias("_at")
    place = F.struct("doc", "text_hash", (F.col("start") + F.col("_at")).alias("start"))
    window = F.substr("bytes", F.col("_at") + 1, F.lit(LENGTH))
    windows = bodies.select("*", at).select(F.unhex(F.md5(window)).alias("window"), place.alias("place"))
    firsts = checkpoint(windows.groupBy("window").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1"))
    often = F.broadcast(firsts.where(F.col("n") > common))
    found = windows.join(often, "window").union(
        windows.join(often, "window", "left_anti").join(firsts.where(F.col("n") <= common), "window")
    )
    return found.where("place != first").select(
        "place.doc", "place.text_hash", "place.start", (F.col("place.start") + LENGTH).alias("end"), F.lit(None).cast("long").alias("anchor")
    )


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``key, n_bytes, n_removed, spans, kept``: removed runs and remaining bytes of every row."""
    least = F.lit(-(2**63))
    source = df.select(
        F.coalesce(F.col(key).cast("long"), least).alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text"),
    )
    dealt = source.mapInArrow(tidy(anchors), ANCHORS).repartition("anchor").sortWithinPartitions("anchor")
    found = checkpoint(dealt.mapInArrow(tidy(compare_snippets), FOUND))
    open_ = found.where("anchor is not null")
    total = open_.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    sizes = open_.groupBy("anchor").agg(F.sum(F.col("end") - F.col("start")).alias("_size"))
    large = checkpoint(sizes.where(F.col("_size") > shard_bytes))  # one a shard at most
    some_large = not large.isEmpty()
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    if some_large:
        open_ = open_.join(F.broadcast(large), "anchor", "left")
        shard = F.when(F.col("_size").isNull(), shard).otherwise(-1)
    wanted = F.struct(shard.cast("long").alias("shard"), "start", "end")
    wanted = open_.groupBy("doc", "text_hash").agg(F.collect_list(wanted).alias("wanted"))
    texts = source.mapInArrow(tidy(packed), "doc long, text_hash long, n_bytes long, body binary")
    once = texts.join(wanted, ["doc", "text_hash"]).dropDuplicates(["doc", "text_hash"])
    bodies = once.mapInArrow(tidy(extract), "shard long, doc long, text_hash long, start long, bytes binary")
    if some_large:
        bodies = checkpoint(bodies)
        found = found.where("anchor is null").unionByName(repeated_windows(bodies.where("shard = -1"), COMMON))
        bodies = bodies.where("shard >= 0")
    windows = bodies.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(compare_windows), FOUND)
    ranges = found.where("anchor is null").union(windows).groupBy("doc", "text_hash").agg(
        F.collect_list(F.struct("start", "end")).alias("ranges")
    )
    done = texts.join(ranges, ["doc", "text_hash"], "left").mapInArrow(
        tidy(cut_out), "doc long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    )
    return done.withColumn("doc", F.when(F.col("doc") != least, F.col("doc"))).withColumnRenamed("doc", key)
