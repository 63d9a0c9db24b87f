"""Packing of token sequences by bounded-space best fit.

Texts are tokenized, an end id is added, and only what is longer than a
sequence is cut.  A task keeps a fixed number of open sequences, filed by
free space in a bitset: a piece goes where it leaves least space, a full
sequence closes, and when too many are open the fullest closes first.  Each
task packs tens of thousands of pieces, the longest first, so that the
sequences left open at its end are few against those it filled.

Defined results: NULL and empty texts are the end id alone; rows that repeat
a key are packed each by itself; an empty table gives no rows; columns named
like the added ones are replaced by them.
"""

from __future__ import annotations

import gc
import os
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.llm.arrow import record_batches, tidy
from triagelake.llm.names import fresh

LENGTH, END_ID = 2048, 0
OPEN = 1 << 16
PIECES_PER_TASK = 100_000
# Words a worker process remembers, twice; each takes about 200 bytes.
CACHE = 600_000
# Of the white space that the tokenizer drops, what no other rule can see.
GAP = re.compile("[ \t\n\r]+")
# Other white space, which str.split() would cut at too.
OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Words of these characters are the same in every normal form, and are lower-cased one by one.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
# Fixed value: the tokenizer's own pattern, for lower-cased plain words.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
# The same over many words, one per line.
LINES = re.compile(f"\\n|{PARTS.pattern}")
# The tokenizer writes bytes as characters: these bytes as they are, the others from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
OTHERS = [b for b in range(256) if b not in SHOWN]
NAMES = {**{b: chr(b) for b in SHOWN}, **{b: chr(256 + i) for i, b in enumerate(OTHERS)}}
BYTES = {c: "".join(NAMES[b] for b in chr(c).encode()) for c in range(128, 256)}


class Encoder:
    """Token ids of texts; words are encoded once and remembered.

    The tokenizer never looks across white space, so a text's ids are those
    of its words in turn.  Plain words are cut into the tokenizer's parts
    here, and many parts are encoded as one text by the same merges; only a
    part's last token has the suffix of word ends, which tells the parts
    apart again.  With ``special``, words that hold a special token's string are
    left to the tokenizer, which gives that token's id; else they are ordinary text.
    """

    def __init__(self, path: str, cache: int = CACHE, special: bool = False):
        self.cache = cache
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        odd = [i for i, t in enumerate(texts) if OTHER_SPACE.search(t)]
        if odd:
            lists = split.to_pylist()
            for i in odd:
                lists[i] = GAP.split(texts[i])
            split = pa.array(lists, pa.list_(pa.large_string()))
        flat = split.flatten().dictionary_encode()
        words, at = flat.dictionary.to_numpy(zero_copy_only=False).tolist(), flat.indices.to_numpy()
        ids = list(map(self.known.get, words))
        gaps = [i for i, b in enumerate(ids) if b is None]
        if gaps:
            fresh = [words[i] for i in gaps]
            if len(self.known) + len(fresh) > self.cache:
                # What was known is asked once more before it is forgotten.
                self.before, self.known = self.known, {}
            if len(self.parts) + len(fresh) > self.cache:
                self.parts = {}
            known, before = self.known, self.before
            known.update((w, before[w]) for w in fresh if w in before)
            # Texts are asked before words, as hardly any has a special token.
            special = [s for s in self.special if any(s in t for t in texts)]
            self.learn([w for w in fresh if w not in known], special)
            for i in gaps:
                ids[i] = known[words[i]]
        body, ends = joined(ids, at)
        off = np.append(0, ends)[split.offsets.to_numpy()]
        return [body[a:b] for a, b in pairwise(off.tolist())]

    def learn(self, words: list[str], special: list[str]) -> None:
        known, parts, plain = self.known, self.parts, PLAIN.fullmatch
        # Empty words stand between and around white space.
        odd = [w for w in words if w and not plain(w) or special and any(s in w for s in special)]
        for i in range(0, len(odd), 4096):
            some = odd[i : i + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                known[w] = np.array(e.ids, "<u4").tobytes()
        if odd:
            words = [w for w in words if w not in known]
        if not words:
            return
        # A line per word, all cut at once.
        cut = pa.array(LINES.findall("\n".join(words).lower() + "\n")).dictionary_encode()
        names, at = cut.dictionary.to_numpy(zero_copy_only=False).tolist(), cut.indices.to_numpy()
        fresh = [p for p in names if p != "\n" and p not in parts]
        fresh.sort(key=str.isascii)  # few need their bytes written otherwise
        for i in range(0, len(fresh), 4096):
            some = fresh[i : i + 4096]
            line = " ".join(some)
            line = line if line.isascii() else line.translate(BYTES)
            ids = np.array(self.merges.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            body = ids.tobytes()
            parts.update(zip(some, [body[a:b] for a, b in pairwise([0, *(4 * ends).tolist()])], strict=True))
        body, ends = joined([b"" if p == "\n" else parts[p] for p in names], at)
        ends = ends[at == names.index("\n")]
        known.update(zip(words, [body[a:b] for a, b in pairwise([0, *ends.tolist()])], strict=True))


def kept_encoder(path: str, cache: int) -> Encoder:
    """The encoder of this worker process.  Spark runs many tasks in one, and
    what one of them learned the next one knows."""
    import tokenizers  # this module is pickled into every task, that one stays

    stat = os.stat(path)
    key = path, cache, stat.st_size, stat.st_mtime_ns
    kept = vars(tokenizers).setdefault("_triagelake_encoders", {})
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(path, cache, special=True)
    return kept[key]


def joined(values: list[bytes], at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids of ``values`` taken in the order ``at``, and where each taken one ends, in bytes."""
    size = np.fromiter(map(len, values), np.int64, len(values)) // 4
    start = np.cumsum(size) - size
    ids = np.frombuffer(b"".join(values), "<u4")
    many = size[at]
    ends = np.cumsum(many)
    place = np.repeat(start[at] - (ends - many), many) + np.arange(many.sum())
    return ids[place].tobytes(), 4 * ends


def pieces(
    df: DataFrame, tokenizer: str, text: str = "text", length: int = LENGTH, cache: int = CACHE
) -> DataFrame:
    """The other columns of ``df``, and ``piece, start, length, ids`` of each piece."""
    added = ["piece", "start", "length", "ids"]
    keep = [c for c in df.columns if c not in [*added, text]]
    body = fresh("_text", keep)
    schema = T.StructType([df.schema[c] for c in keep])
    for name, kind in zip(added, (T.IntegerType(), T.LongType(), T.LongType(), T.BinaryType())):
        schema = schema.add(name, kind)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encoder = kept_encoder(tokenizer, cache)
        gc.disable()  # millions of words are held, and nothing here refers to itself
        try:
            yield from cut(batches, encoder)
        finally:
            gc.enable()

    def cut(batches, encoder):
        for batch in record_batches(batches, 1 << 22):
            row, piece, ids = [], [], []
            texts = [t or "" for t in batch.column(body).to_pylist()]
            for r, b in enumerate(encoder.encode(texts)):
                b += end
                for p, at in enumerate(range(0, len(b), 4 * length)):
                    row.append(r)
                    piece.append(p)
                    ids.append(b[at : at + 4 * length])
            taken = batch.select(keep).take(pa.array(row, pa.int64()))
            start = pa.array(np.array(piece, np.int64) * length)
            size = pa.array(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
            columns = [*taken.columns, pa.array(piece, pa.int32()), start, size, pa.array(ids, pa.binary())]
            yield pa.record_batch(columns, names=[*keep, *added])

    return df.select(*keep, F.col(text).alias(body)).mapInArrow(tidy(run), schema)


class Bins:
    """Open sequences filed by free space; bit ``f`` is set where one has ``f`` free."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit = length, limit
        self.bits, self.filed, self.open, self.made = 0, [[] for _ in range(length + 1)], 0, 0

    def take(self, free: int) -> int:
        bin_ = self.filed[free].pop()
        self.open -= 1
        if not self.filed[free]:
            self.bits &= ~(1 << free)
        return bin_

    def put(self, size: int) -> tuple[int, int]:
        """The sequence and offset for a piece of ``size``."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self.take(free)
        else:
            bin_, free = self.made, self.length
            self.made += 1
        left = free - size
        if left:
            self.filed[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.limit:
                self.take((self.bits & -self.bits).bit_length() - 1)
        return bin_, self.length - free


def pack(rows: DataFrame, keys: list[str], length: int = LENGTH, limit: int = OPEN) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length``.

    ``keys`` spread the rows over tasks and order equal lengths.
    """
    rows = rows.drop("sequence_id", "offset")
    tasks = max(1, -(-rows.count() // PIECES_PER_TASK))
    schema = T.StructType(rows.schema.fields).add("sequence_id", T.LongType()).add("offset", T.LongType())

    def run(batches):
        bins, first = Bins(length, limit), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.put(n) for n in batch.column("length").to_pylist()]
            sequence = pa.array([first + b for b, _ in placed], pa.int64())
            offset = pa.array([o for _, o in placed], pa.int64())
            yield pa.record_batch([*batch.columns, sequence, offset], names=[*batch.schema.names, "sequence_id", "offset"])

    dealt = rows.repartition(tasks, *keys).sortWithinPartitions(F.desc("length"), *keys)
    return dealt.mapInArrow(tidy(run), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: ``sequence_id, ids``, from packed rows that kept their ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
