"""Secret scans, in DataFrame operations only.

Base kinds are found by pattern.  The method adds runs of token characters
that two character Markov models tell apart: one of random strings, one of
ordinary identifiers; a run is a secret when the log-likelihood ratio of its
transitions passes a threshold.  The models are transition counts of labelled
samples: on one side every value that the base patterns found, on the other
every word of the documents without base matches; some digests smooth the
first.  All documents count; words are counted before their characters are.

``detect`` scans the texts once for base spans, which are written with the
rows, learns from them, and adds the model's spans.  Work inside a text is
linear in its matches: places come from running sums, which are formed in
blocks because an array that grows by one is copied each time.

Spans are in code points, the end exclusive.  Defined results: NULL and empty
texts have no spans; repeated rows are scanned alike; a table without any
text gives a model of digests and no words; columns named ``spans`` are
replaced.
"""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.names import fresh
from triagelake.session import checkpoint

# Kinds and patterns of the result, in their order.
KINDS = ["assign", "access", "hex", "model"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_GATE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE, LEAST_ACCESS = 8, 16

RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
DIGESTS = 2_000
SMOOTHING = 0.5
LEAST_RATIO = 10.0
SPAN = "struct<start:int,rank:int,end:int,value:string>"
# Elements summed, and code points cut, at a time.
STEP, PIECE = 128, 4096
LAST = (1 << 31) - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` over each element and all before it, for an array of ints."""
    def chain(part: Column) -> Column:
        more = lambda acc, x: F.array_append(acc, op(F.element_at(acc, -1), x))
        return F.aggregate(F.slice(part, 2, STEP), F.slice(part, 1, 1), more)

    def joined(parts: Column) -> Column:
        more = lambda acc, x: F.array_append(acc, op(F.element_at(acc, -1), x))
        lasts = F.transform(parts, lambda p: F.element_at(p, -1))
        so_far = let(lasts, lambda e: F.aggregate(F.slice(e, F.lit(2), F.size(e)), F.slice(e, 1, 1), more))
        return let(so_far, lambda s: F.flatten(
            F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: op(F.get(s, i - 1), x))))
        ))

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int"))
        return F.transform(starts, lambda b: chain(F.slice(v, b * STEP + 1, STEP)))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), joined)).otherwise(v))


def matches(text: Column, pattern: str, rank: int) -> Column:
    """Spans of the leftmost non-overlapping matches of ``pattern``.

    Places come from the lengths of the matches and of the parts between.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    size = lambda z: F.length(z["0"]) + F.coalesce(F.length(z["1"]), F.lit(0))

    def placed(z: Column, end: Column) -> Column:
        start = end - F.length(z["1"])
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), z["1"].alias("value"))

    def spans(z: Column) -> Column:
        ends = running(F.transform(z, size), lambda a, x: a + x)
        whole = let(ends, lambda e: F.transform(z, lambda x, i: placed(x, F.get(e, i))))
        return F.filter(whole, lambda x: x["value"].isNotNull()).cast(f"array<{SPAN}>")

    return let(pairs, spans)


def gated(text: Column, gate: str, spans: Column) -> Column:
    return F.when(text.rlike(gate), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    value = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2))
    return F.array_sort(
        F.concat(
            gated(text, ASSIGN_GATE, F.filter(matches(text, ASSIGN, 0), lambda s: value(s) >= LEAST_VALUE)),
            gated(text, ACCESS, F.filter(matches(text, ACCESS, 1), lambda s: F.length(s["value"]) >= LEAST_ACCESS)),
            gated(text, HEX, matches(text, HEX, 2)),
        )
    )


def codes(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: F.ascii(c))


def transitions(samples: DataFrame) -> DataFrame:
    """``pair, random, ordinary``: counts of character pairs of ``value``, each ``n`` times, by ``is_random``."""
    arrays = samples.select("is_random", "n", codes(F.col("value")).alias("c")).where(F.size("c") > 1)
    pair = lambda c, i: c * 128 + F.get(F.col("c"), i + 1)
    pairs = F.transform(F.slice("c", F.lit(1), F.size("c") - 1), pair)
    count = lambda flag: F.sum(F.when(F.col("is_random") == F.lit(flag), F.col("n")).otherwise(0))
    return (
        arrays.select("is_random", "n", F.explode(pairs).alias("pair"))
        .groupBy("pair").agg(count(True).alias("random"), count(False).alias("ordinary"))
    )


def learned(texts: DataFrame) -> list[float]:
    """Log-likelihood ratio of each of the 128 x 128 character pairs, from ``body, base`` of all texts."""
    found = texts.select(F.explode("base").alias("s")).select(
        F.when(F.col("s.rank") == 0, F.regexp_extract("s.value", ASSIGN, 2)).otherwise(F.col("s.value")).alias("value"),
        F.lit(True).alias("is_random"),
    )
    words = texts.where(F.size("base") == 0).select(
        F.explode(F.regexp_extract_all("body", F.lit(r"[A-Za-z0-9+/_-]+"), F.lit(0))).alias("value"),
        F.lit(False).alias("is_random"),
    )
    digest = F.sha2(F.col("id").cast("string"), 256)
    forms = F.array(digest, F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), F.substring(F.upper(digest), 1, 20))
    digests = texts.sparkSession.range(DIGESTS).select(F.explode(forms).alias("value"), F.lit(True).alias("is_random"))
    values = found.union(words).union(digests).groupBy("value", "is_random").agg(F.count("*").alias("n"))
    counts = transitions(values).where("pair between 0 and 16383").collect()  # at most 16,384 rows
    rows = {True: [0.0] * 128, False: [0.0] * 128}
    cell = {True: [0.0] * 16384, False: [0.0] * 16384}
    for r in counts:
        for side, n in ((True, r["random"]), (False, r["ordinary"])):
            rows[side][r["pair"] // 128] += n
            cell[side][r["pair"]] = n
    log = lambda side, p: math.log((cell[side][p] + SMOOTHING) / (rows[side][p // 128] + 128 * SMOOTHING))
    return [round(log(True, p) - log(False, p), 2) for p in range(16384)]


def train(df: DataFrame, text: str = "text") -> list[float]:
    """The model of all texts of ``df``."""
    body = F.coalesce(F.col(text), F.lit(""))
    one = F.array(F.struct(body.alias("body"), base_spans(body).alias("base")))
    return learned(df.select(F.inline(one)))


def ratio(value: Column, model: Column) -> Column:
    """Sum of the model over the character pairs of ``value``."""
    pair = lambda c, i: F.get(c, i) * 128 + F.get(c, i + 1)
    total = lambda c: F.aggregate(
        F.sequence(F.lit(0), F.size(c) - 2), F.lit(0.0), lambda a, i: a + F.get(model, pair(c, i))
    )
    return F.transform(F.array(codes(value)), total)[0]


def find(df: DataFrame, model: list[float], text: str = "text", least: float = LEAST_RATIO) -> DataFrame:
    """Add ``spans``: base spans and the runs that the model adds beside them."""
    return added(*scanned(df, text), model, text, least)


def detect(df: DataFrame, text: str = "text", least: float = LEAST_RATIO) -> DataFrame:
    """``find`` with the model that ``df`` itself gives."""
    rows, base = scanned(df, text)
    rows = checkpoint(rows)
    model = learned(rows.select(F.coalesce(F.col(text), F.lit("")).alias("body"), F.col(base).alias("base")))
    return added(rows, base, model, text, least)


def scanned(df: DataFrame, text: str) -> tuple[DataFrame, str]:
    """The rows with their base spans, and the column that holds these."""
    df = df.drop("spans")
    base = fresh("_base", df.columns)
    # A generator of one row keeps the scans from being repeated where they are used.
    one = F.array(F.struct(base_spans(F.coalesce(F.col(text), F.lit(""))).alias("base")))
    return df.select("*", F.inline(one).alias(base)), base


def added(rows: DataFrame, base: str, model: list[float], text: str, least: float) -> DataFrame:
    """Base spans and those of the model."""
    body = F.coalesce(F.col(text), F.lit(""))
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    runs = F.filter(matches(body, RUN, 3), lambda s: ratio(s["value"], table) >= least)
    more = fresh("_runs", rows.columns)
    found = rows.select("*", F.inline(F.array(F.struct(gated(body, RUN, runs).alias("runs")))).alias(more))
    spans = F.when(F.size(more) == 0, F.col(base)).otherwise(apart(F.col(base), F.col(more)))
    return found.withColumn("spans", spans).drop(base, more)


def apart(base: Column, runs: Column) -> Column:
    """All base spans and the runs that overlap none, by start."""
    own = lambda s: s["rank"] < 3
    before = lambda spans: running(
        F.transform(spans, lambda s: F.when(own(s), s["end"]).otherwise(0)), lambda a, x: F.greatest(a, x)
    )
    after = lambda spans: F.reverse(running(
        F.reverse(F.transform(spans, lambda s: F.when(own(s), s["start"]).otherwise(LAST))), lambda a, x: F.least(a, x)
    ))
    clear = lambda s, ends, starts, i: own(s) | ((F.get(ends, i) <= s["start"]) & (F.get(starts, i) >= s["end"]))
    kept = lambda spans: let(before(spans), lambda ends: let(
        after(spans), lambda starts: F.filter(spans, lambda s, i: clear(s, ends, starts, i))
    ))
    return let(F.array_sort(F.concat(base, runs)), kept)


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span, or run of overlapping ones, replaced by ``mask``.

    Cutting at a code point walks to it from the start, so the text is cut
    into pieces first and what lies between spans is cut out of these.
    """
    starts = F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int"))
    cut = F.transform(starts, lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE)))

    def between(pieces: Column, low: Column, high: Column) -> Column:
        first = F.floor(low / PIECE).cast("int")
        some = F.array_join(F.slice(pieces, first + 1, F.floor(high / PIECE).cast("int") - first + 1), "")
        return F.substring(some, low - first * PIECE + 1, high - low)

    def shown(pieces: Column, ends: Column) -> Column:
        end = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
        parts = F.transform(spans, lambda s, i: F.when(s["start"] >= end(i), F.concat(between(pieces, end(i), s["start"]), F.lit(mask))))
        rest = between(pieces, F.element_at(ends, -1), F.length(text))
        return F.concat(F.array_join(parts, ""), rest)

    ends = running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    return F.when(F.size(spans) > 0, let(cut, lambda p: let(ends, lambda e: shown(p, e)))).otherwise(text)
