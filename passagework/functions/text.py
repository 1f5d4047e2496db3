"""Word, token and text-match expressions (built-in functions only)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_LETTER = r"[\p{L}\p{N}_]"


def strip(text: Column) -> Column:
    """Remove all Unicode white space at both ends (`trim` handles the space only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Lines split on single spaces, each line followed by a newline word; empty words are kept."""
    return F.flatten(
        F.transform(
            F.split(text, "\n", -1),
            lambda line: F.concat(F.split(line, " ", -1), F.array(F.lit("\n"))),
        )
    )


def estimated_tokens(word: Column) -> Column:
    """Offline estimate of one word's token count: '' is 0, newline is 1, else a quarter per letter."""
    return (
        F.when(word == "", F.lit(0))
        .when(word == "\n", F.lit(1))
        .otherwise(F.ceil(F.length(word) / 4).cast("int"))
    )


def text_tokens(text: Column) -> Column:
    """Estimated tokens of a whole text: the sum of `estimated_tokens` over its words.

    Every piece of up to four letters of a word, and every newline, becomes one
    letter; what is left after removing the spaces is counted. One more is for
    the newline that ends the last line. Needs no array of words.
    """
    pieces = F.regexp_replace(text, "[^ \n]{1,4}", "x")
    return (F.length(F.replace(pieces, F.lit(" "))) + 1).cast("bigint")


def term_words(term: str) -> list[str]:
    """Distinct lower-case words of a literal search term."""
    return sorted({w for w in re.split(r"[^\w]+", term.lower()) if w})


def has_word(text: Column, word: str) -> Column:
    """True when the lower-case `word` is a word of `text`.

    The substring test comes first and is cheap. The pattern starts with the
    literal and looks at its neighbours afterwards, so the regex engine skips
    to candidates instead of testing every position.
    """
    lowered = F.lower(text)
    literal = re.escape(word)
    exact = f"{literal}(?<!{WORD_LETTER}{literal})(?!{WORD_LETTER})"
    return F.contains(lowered, F.lit(word)) & F.rlike(lowered, F.lit(exact))


def text_match(text: Column, term: str) -> Column:
    """True when every word of `term` is a word of `text`; an empty term matches nothing."""
    wanted = term_words(term)
    if not wanted:
        return text.isNull() & F.lit(False)
    return reduce(lambda a, b: a & b, [has_word(text, word) for word in wanted])


def text_match_any(texts: list[Column], term: str) -> Column:
    """True when every word of `term` is a word of one of the `texts`."""
    wanted = term_words(term)

    def somewhere(word: str) -> Column:
        found = [F.coalesce(has_word(text, word), F.lit(False)) for text in texts]
        return reduce(lambda a, b: a | b, found)

    return reduce(lambda a, b: a & b, map(somewhere, wanted)) if wanted else F.lit(False)


# fixed values: bracket classes and word-boundary escapes whose spelling differs in Java regex
POSIX_CLASSES = {
    "alnum": r"\p{Alnum}",
    "alpha": r"\p{Alpha}",
    "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}",
    "digit": r"\p{Digit}",
    "graph": r"\p{Graph}",
    "lower": r"\p{Lower}",
    "print": r"\p{Print}",
    "punct": r"\p{Punct}",
    "space": r"\p{Space}",
    "upper": r"\p{Upper}",
    "xdigit": r"\p{XDigit}",
}
BOUNDARY_ESCAPES = {"m": r"\b(?=\w)", "M": r"\b(?<=\w)", "y": r"\b", "Y": r"\B"}


def java_regex(pattern: str) -> str:
    """Rewrite POSIX bracket classes and `\\m \\M \\y \\Y` for Java's regex dialect."""

    def escape(match: re.Match) -> str:
        return BOUNDARY_ESCAPES.get(match.group(1), match.group(0))

    pattern = re.sub(r"\\(.)", escape, pattern, flags=re.S)
    return re.sub(
        r"\[:(\w+):\]", lambda m: POSIX_CLASSES.get(m.group(1), m.group(0)), pattern
    )


def like_pattern(pattern: str) -> str:
    """Drop backslashes that escape an ordinary character, which `like` would reject."""
    return re.sub(r"\\([^%_])", lambda m: m.group(0) if m.group(1) == "\\" else m.group(1), pattern)


def similar_regex(pattern: str) -> str:
    """The Java regex of an SQL `SIMILAR TO` pattern."""
    out, in_class, escaped = [], False, False
    for ch in pattern:
        if escaped:
            out.append(re.escape(ch))
            escaped = False
        elif ch == "\\":
            escaped = True
        elif in_class:
            in_class = ch != "]"
            out.append(ch)
        elif ch == "[":
            in_class = True
            out.append(ch)
        elif ch in "%_":
            out.append(".*" if ch == "%" else ".")
        elif ch in ".^$":
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "(?s)^(?:" + java_regex("".join(out)) + r")\z"
