"""Text expressions: Column in, Column out, no Python UDF.

Patterns carry ``(?U)`` so that whitespace, word characters and word
boundaries follow Unicode whatever the Java version.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagelake.functions import fixed

TOKEN = r"[\p{L}\p{N}_]{2,}"
# What ``(?U)\s`` matches.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_ws(c: Column) -> Column:
    """Strip leading and trailing Unicode whitespace."""
    return F.btrim(c, F.lit(SPACES))


def collapse_ws(c: Column) -> Column:
    """Whitespace runs become one space; blank text becomes NULL."""
    return F.nullif(squeeze(c), F.lit(""))


def squeeze(c: Column) -> Column:
    """Whitespace runs become one space; blank text stays ``''``."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words; 0 for NULL and blank text."""
    found = F.array_remove(F.split(c, r"(?U)\s+"), "")
    return F.coalesce(F.array_size(found), F.lit(0)).cast("long")


def cap_words(c: Column, limit: int = fixed.MAX_WORDS) -> Column:
    """First ``limit`` words; text within the limit is left as it is."""
    return F.when(word_count(c) <= limit, c).otherwise(first_words(c, limit))


def first_words(c: Column, limit: int = fixed.MAX_WORDS) -> Column:
    """First ``limit`` words joined by one space, whatever the length."""
    return F.array_join(F.slice(words(c), 1, limit), " ")


def text_key(c: Column) -> Column:
    """Normalised text that decides whether two texts are the same."""
    return squeeze(F.lower(c))


def text_hash(c: Column) -> Column:
    """Fixed-width stand-in for ``text_key``, so shuffles move no text."""
    return F.sha2(text_key(c), 256)


def strip_markup(c: Column) -> Column:
    """Drop issue-tracker markup, then collapse; blank becomes NULL."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"(?i)\{code(:[^}]*)?\}|\{noformat\}", " ")
    return collapse_ws(F.regexp_replace(c, r"\[~[^\]]+\]", " "))


def project_key(c: Column) -> Column:
    """Upper-case key in front of the first hyphen; NULL when absent."""
    key = F.regexp_extract(c, r"^([A-Za-z0-9_]+)-", 1)
    return F.upper(F.nullif(key, F.lit("")))


def label_pattern(labels, numbered: bool = True) -> str:
    """One whole-word pattern for all labels, longest label first."""
    ordered = sorted({str(x) for x in labels}, key=lambda x: (-len(x), x))
    body = "|".join(re.escape(x) for x in ordered)
    return rf"(?iU)\b(?:{body})" + (r"(?:-\d+)?\b" if numbered else r"\b")


def strip_pattern(c: Column, pattern: str) -> Column:
    return squeeze(F.regexp_replace(c, pattern, " "))


def strip_placeholders(c: Column) -> Column:
    """Drop anonymisation masks such as ``ph_user``."""
    return strip_pattern(c, r"(?iU)\bph_\w+\b")


def sentences(c: Column) -> Column:
    """Non-blank sentences, split after ``.!?`` or at line breaks."""
    # As ``(?<=[.!?])\s+|\n+``, but looking back from whitespace alone.
    parts = F.split(c, r"(?U)\s(?<=[.!?]\s)\s*|\n+")
    return F.filter(F.transform(parts, trim_ws), lambda s: s != "")


def sentence_key(c: Column) -> Column:
    """Form used to compare sentences, never shown."""
    return squeeze(F.regexp_replace(F.lower(c), r"(?U)[^a-z0-9_\s]", " "))


def step_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", ""))


def strip_chars(c: Column, chars: str = fixed.EDGE_CHARS) -> Column:
    return F.btrim(c, F.lit(chars))


def trim_edges(c: Column, patterns=fixed.EDGE_PATTERNS) -> Column:
    """Remove greeting and sign-off fragments around a sentence."""
    for pattern in patterns:
        c = F.regexp_replace(c, "(?iU)" + pattern, "")
    return strip_chars(c)


def verb_pattern(verbs=fixed.ACTION_VERBS) -> str:
    return r"(?iU)\b(?:" + "|".join(verbs) + r")\b"


def is_actionable(
    sentence: Column,
    verbs=fixed.ACTION_VERBS,
    process_patterns=fixed.PROCESS_PATTERNS,
    min_words: int = fixed.MIN_STEP_WORDS,
) -> Column:
    """Long enough, names an action, and is not about process."""
    process = "(?iU)" + "|".join(f"(?:{p})" for p in process_patterns)
    return (
        (word_count(sentence) >= min_words)
        & ~sentence.rlike(process)
        & sentence.rlike(verb_pattern(verbs))
    )


def tokens(c: Column, stop_words=fixed.STOP_WORDS) -> Column:
    """Lower-case words of two or more characters without stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    if not stop_words:
        return found
    return F.filter(found, lambda t: ~t.isin(*stop_words))


def gate(
    c: Column,
    min_words: int = fixed.MIN_TICKET_WORDS,
    max_words: int = fixed.MAX_TICKET_WORDS,
) -> Column:
    """``struct(clean_text, error, truncated)`` for one incoming ticket."""
    text = F.coalesce(trim_ws(c), F.lit(""))
    n = word_count(text)
    error = F.when(text == "", F.lit(fixed.ERR_BLANK)).when(
        n < min_words,
        F.format_string(fixed.ERR_SHORT_TICKET, n, F.lit(min_words)),
    )
    clean = F.when(error.isNull(), cap_words(text, max_words))
    return F.struct(
        clean.alias("clean_text"),
        error.alias("error"),
        (error.isNull() & (n > max_words)).alias("truncated"),
    )


def json_object_text(c: Column) -> Column:
    """Outermost ``{...}`` of a text, or NULL."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def recover_json(c: Column, schema: str) -> Column:
    """Parse the text as JSON, else its outermost object, else NULL.

    ``try_parse_json`` decides whether a text is JSON at all, because
    ``from_json`` returns a struct of NULLs for text it cannot read.
    """
    direct = F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))
    inner = json_object_text(c)
    return F.coalesce(
        direct, F.when(F.try_parse_json(inner).isNotNull(), F.from_json(inner, schema))
    )
