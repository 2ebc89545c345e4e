"""Column functions for text: Python string semantics expressed with native Spark functions.

All functions take and return ``Column`` and stay inside whole-stage codegen (no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from learnlog import constants as K

# FIXED VALUE: the 29 code points Python's str.strip()/str.split() treat as whitespace
# (Spark's trim without arguments only removes U+0020), as a character set for trim/translate
# and as an RE2 class for the DuckDB oracle.
WS_CHARS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])

WS_CLASS_RE2 = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

DANGEROUS_CHARS = "<>&\"'"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def n_items(arr) -> Column:
    """Array length as bigint, null for a null array whatever the session's ANSI /
    ``sizeOfNull`` settings (legacy ``size`` would give -1). One reference to the input, so a
    projection over a page still collapses into the TakeOrderedAndProject."""
    return F.array_size(_c(arr)).cast("bigint")


def py_strip(x) -> Column:
    """``str.strip()`` with Unicode whitespace: ``trim`` with the whitespace set only touches
    the characters it removes (a regex would scan the whole text)."""
    return F.trim(_c(x), F.lit(WS_CHARS))


def collapse_ws(x) -> Column:
    """``" ".join(s.split())`` without a regex: every whitespace code point becomes a space
    (``translate``), the text is split on that one character (a non-regex split), empty
    tokens are dropped and the rest joined with single spaces."""
    spaced = F.translate(_c(x), WS_CHARS, " " * len(WS_CHARS))
    return F.array_join(F.array_remove(F.split(spaced, " "), ""), " ")


def sanitize(x) -> Column:
    """Collapse whitespace, drop ``< > & " '``, strip; null or empty gives ``""``.
    (A five-character regex class removes the characters faster than ``translate``, which
    looks every character up in a map.)"""
    c = _c(x)
    cleaned = py_strip(F.regexp_replace(collapse_ws(c), "[<>&\"']", ""))
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(cleaned)


def stripped_length(x) -> Column:
    return F.length(py_strip(x))


def text_reason(x) -> Column:
    """Validation message for an input text; ``""`` when valid."""
    c = _c(x)
    n = stripped_length(c)
    return (F.when(c.isNull() | (n == 0), F.lit(K.MSG_EMPTY_TEXT))
            .when(n < K.MIN_TEXT_LENGTH, F.lit(K.MSG_TEXT_TOO_SHORT))
            .when(n > K.MAX_TEXT_LENGTH, F.lit(K.MSG_TEXT_TOO_LONG))
            .otherwise(F.lit("")))


def text_is_valid(x) -> Column:
    return text_reason(x) == ""


def accepted_by_gate(x) -> Column:
    """Submit gate of the input form: stripped length strictly greater than 3."""
    return F.coalesce(stripped_length(x) > 3, F.lit(False))


def language_reason(x) -> Column:
    c = _c(x)
    return (F.when(c.isNull() | (stripped_length(c) == 0), F.lit(K.MSG_PICK_LANGUAGE))
            .when(~c.isin(*K.SUPPORTED_LANGUAGES), F.concat(F.lit(K.MSG_UNSUPPORTED_LANGUAGE), c))
            .otherwise(F.lit("")))


def exercise_type_reason(x) -> Column:
    c = _c(x)
    return (F.when(c.isNull() | ~c.isin(*K.EXERCISE_TYPES),
                   F.concat(F.lit(K.MSG_UNKNOWN_EXERCISE), F.coalesce(c, F.lit("None"))))
            .otherwise(F.lit("")))


def cut_with_ellipsis(x, n: int) -> Column:
    """First ``n`` characters plus ``...`` only when longer (preview, speech input)."""
    c = _c(x)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def preview(x) -> Column:
    return cut_with_ellipsis(x, K.PREVIEW_CHARS)


def tts_input(x) -> Column:
    return cut_with_ellipsis(x, K.TTS_MAX_CHARS)


def error_snippet(x) -> Column:
    """First 100 characters plus ``...`` always."""
    return F.concat(F.substring(_c(x), 1, K.ERROR_SNIPPET_CHARS), F.lit("..."))


def strip_prefixes(x, prefixes: list[str]) -> Column:
    """Remove each prefix at most once, in list order, re-stripping after each cut."""
    return F.aggregate(
        F.array(*[F.lit(p) for p in prefixes]),
        _c(x),
        lambda acc, p: F.when(acc.startswith(p), py_strip(F.substring(acc, F.length(p) + 1, 1 << 30)))
        .otherwise(acc),
    )


def in_steps(df, src: str, out: str, steps) -> "DataFrame":
    """Apply ``steps`` (Column -> Column) one projection at a time. A step that uses its
    input several times then reads a column instead of re-evaluating the previous steps
    (Catalyst does not inline a non-trivial expression that is referenced twice)."""
    cur, tmp = src, []
    for i, step in enumerate(steps):
        name = f"_{out}_s{i}"
        df = df.withColumn(name, step(F.col(cur)))
        tmp.append(name)
        cur = name
    return df.withColumn(out, F.col(cur)).drop(*tmp)


def _cut_front(fence):
    return lambda col: F.when(col.startswith(fence), F.substring(col, len(fence) + 1, 1 << 30)).otherwise(col)


def _cut_back(fence):
    return lambda col: F.when(col.endswith(fence), F.left(col, F.length(col) - len(fence))).otherwise(col)


FENCE_STEPS = [py_strip, _cut_front("```json"), _cut_back("```"), _cut_front("```"), _cut_back("```"),
               py_strip]


def strip_code_fences(x) -> Column:
    """Strip, then the four ordered fence cuts of a model reply, then strip again."""
    c = _c(x)
    for step in FENCE_STEPS:
        c = step(c)
    return c


def looks_like_json_object(x) -> Column:
    c = _c(x)
    return c.startswith("{") & c.endswith("}")


def nonblank_lines(x) -> Column:
    """Lines of a text that are not blank after strip (kept unstripped)."""
    return F.filter(F.split(_c(x), "\n"), lambda line: py_strip(line) != "")


def bullet_tips(x) -> Column:
    """Stripped lines starting with the bullet; the default line when there is none."""
    lines = F.transform(F.split(py_strip(x), "\n"), lambda line: py_strip(line))
    tips = F.filter(lines, lambda line: line.startswith(K.TIP_BULLET))
    return F.when(F.size(tips) > 0, tips).otherwise(F.array(F.lit(K.MSG_NO_TIPS)))


def contains_any(x, keywords: list[str]) -> Column:
    """Lower-cased text contains any keyword (substring, not word, semantics)."""
    return contains_any_lowered(F.lower(_c(x)), keywords)


def contains_any_lowered(lowered: Column, keywords: list[str]) -> Column:
    """The same of a text that is lower-cased already: one pass of one compiled pattern."""
    return lowered.rlike(any_of(keywords)) if keywords else F.when(lowered.isNotNull(), F.lit(False))


def any_of(keywords: list[str]) -> str:
    """A pattern that finds any of the keywords: their common beginnings are tried once, and a keyword
    that contains another is not needed."""
    tree: dict = {}
    for k in sorted(set(keywords), key=len):
        node = tree
        for c in k:
            if None in node:
                break  # a shorter keyword ends here
            node = node.setdefault(c, {})
        node[None] = {}

    def pattern(node: dict) -> str:
        if None in node:
            return ""
        parts = [_literal(c) + pattern(node[c]) for c in sorted(node)]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return pattern(tree)


def _literal(c: str) -> str:
    return c if c.isalnum() else f"\\x{{{ord(c):x}}}"


def is_language_question(x) -> Column:
    return F.coalesce(contains_any(x, K.LANGUAGE_KEYWORDS), F.lit(False))


def is_conversation_request(x) -> Column:
    return F.coalesce(contains_any(x, K.CONVERSATION_KEYWORDS), F.lit(False))


def route_question(x) -> Column:
    """refuse (off-topic) / conversation / explain. Each pattern runs over a text at most once."""
    return (F.when(is_language_question(x), F.when(is_conversation_request(x), F.lit("conversation"))
                   .otherwise(F.lit("explain")))
            .otherwise(F.lit("refuse")))


def refusal_text(language) -> Column:
    lang = _c(language)
    return F.format_string(K.REFUSAL_TEMPLATE, lang, lang)


def response_ok(x) -> Column:
    """A model reply counts as a success when non-empty and free of the word ``error``."""
    c = _c(x)
    return F.coalesce((F.length(c) > 0) & ~F.lower(c).contains("error"), F.lit(False))


def error_class(x) -> Column:
    lowered = F.lower(_c(x))
    expr = None
    for name, words in K.ERROR_CLASSES:
        cond = None
        for w in words:
            cond = lowered.contains(w) if cond is None else (cond | lowered.contains(w))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("other"))


def file_extension(name) -> Column:
    """Lower-cased text after the last dot; the whole name when there is no dot."""
    return F.lower(F.substring_index(_c(name), ".", -1))


def audio_ok(audio) -> Column:
    a = _c(audio)
    return F.coalesce(F.octet_length(a) >= K.MIN_AUDIO_SIZE_BYTES, F.lit(False))


def b64(binary) -> Column:
    """Base64 without the line breaks Spark's encoder may insert every 76 characters."""
    return F.regexp_replace(F.base64(_c(binary)), "[\r\n]", "")
