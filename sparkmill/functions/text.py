"""Column-level text helpers that keep Python string semantics on the JVM.

Everything here returns a ``Column`` built from Spark built-ins so it stays
inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import re
from re import _constants, _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``str.strip()`` removes every character for which ``str.isspace()``
# is true.  Derive the set by that rule (all such characters are below U+3001)
# instead of listing it, so it always matches the running interpreter.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def _class_escape(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in chars)


# The same set as a regex character class, spelled so that both Java and RE2
# accept it (``\x{HH}`` escapes).
WS_CLASS = "[" + _class_escape(PY_WHITESPACE) + "]"
# Python's Unicode ``\w`` (letters, numbers, underscore) and ``\d``.
WORD_CLASS = r"[\p{L}\p{N}_]"
DIGIT_CLASS = r"\p{Nd}"

# Java regex flags that make ``\b \d \w \s`` and case folding Unicode-aware,
# as they are for Python ``str`` patterns.
UNICODE = "(?U)"
UNICODE_NOCASE = "(?iU)"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: str | Column) -> Column:
    """``str.strip()``: trim the full Python whitespace set from both ends."""
    return F.call_function("btrim", col_of(c), F.lit(PY_WHITESPACE))


_WORD_SET = r"\p{L}\p{N}_"
_WS_SET = WS_CLASS[1:-1]
_WORD = "[" + _WORD_SET + "]"
# Python's \b and \B, written with lookaround over Python's word class.
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NOT_BOUNDARY = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
# How each class escape reads outside and inside a character class.  The
# whitespace set always differs (Python counts \x1c-\x1f); the word escapes
# differ only around the characters of WORD_DIFFERENCE.
_OUTSIDE_ALWAYS = {"s": WS_CLASS, "S": "[^" + _WS_SET + "]", "Z": r"\z"}
_INSIDE_ALWAYS = {"s": _WS_SET, "S": "[^" + _WS_SET + "]"}
_OUTSIDE_WORDS = {"w": _WORD, "W": "[^" + _WORD_SET + "]", "b": _BOUNDARY, "B": _NOT_BOUNDARY}
_INSIDE_WORDS = {"w": _WORD_SET, "W": "[^" + _WORD_SET + "]"}

# Characters whose word-ness differs between Java's Unicode ``\w`` and Python's:
# combining marks, connector punctuation other than "_", other numerics
# (superscripts, fractions), the zero-width joiners and alphabetic symbols
# (circled letters).  ``\d`` is the decimal digits in both.
WORD_DIFFERENCE = (r"[\p{M}[\p{Pc}&&[^_]]\p{No}\x{200C}\x{200D}[\p{So}&&\p{IsAlphabetic}]]")


def java_pattern(pattern: str, *, exact_words: bool = True) -> str:
    """Spell a Python ``re`` pattern (str semantics) for Java's engine.

    Python's own parser reads the pattern, so what is no Python pattern raises
    ``re.error`` when the plan is made; what Java's engine cannot say (a condition on a
    group, ASCII mode) raises ``ValueError`` then.  With ``exact_words`` the word
    escapes ``\\w \\W \\b \\B`` are written out as Python defines them
    (lookarounds: slower); without, Java's own Unicode versions are kept, which agree on
    every text free of ``WORD_DIFFERENCE`` characters.
    """
    tree = _parser.parse(pattern)
    flags = tree.state.flags
    if flags & (re.ASCII | re.LOCALE):
        raise ValueError("patterns in ASCII or locale mode are not supported")
    on = "".join(f for f, bit in _JAVA_FLAGS if flags & bit)
    return (f"(?{on})" if on else "") + _print(tree, exact_words)


_JAVA_FLAGS = (("i", re.IGNORECASE), ("m", re.MULTILINE), ("s", re.DOTALL))
_REPEATS = {_constants.MAX_REPEAT: "", _constants.MIN_REPEAT: "?", _constants.POSSESSIVE_REPEAT: "+"}
# The parser's codes are whole numbers that repeat from one kind of node to another: one table for each kind.
_CATEGORIES = {_constants.CATEGORY_DIGIT: "d", _constants.CATEGORY_NOT_DIGIT: "D", _constants.CATEGORY_SPACE: "s",
               _constants.CATEGORY_NOT_SPACE: "S", _constants.CATEGORY_WORD: "w", _constants.CATEGORY_NOT_WORD: "W"}
_BOUNDARIES = {_constants.AT_BOUNDARY: "b", _constants.AT_NON_BOUNDARY: "B"}
_ANCHORS = {_constants.AT_BEGINNING: "^", _constants.AT_BEGINNING_STRING: r"\A", _constants.AT_END: "$", _constants.AT_END_STRING: r"\z"}


def _literal(code: int) -> str:
    ch = chr(code)
    return ch if ch.isascii() and (ch.isalnum() or ch in " _,:;@%'<>=!/~") else f"\\x{{{code:X}}}"


def _escape(name: str, exact_words: bool, inside: bool) -> str:
    table = dict(_INSIDE_ALWAYS if inside else _OUTSIDE_ALWAYS)
    if exact_words:
        table.update(_INSIDE_WORDS if inside else _OUTSIDE_WORDS)
    return table.get(name, "\\" + name)


def _set(items, exact_words: bool) -> str:
    if len(items) == 1 and items[0][0] is _constants.CATEGORY:
        return _escape(_CATEGORIES[items[0][1]], exact_words, False)
    out = []
    for kind, value in items:
        if kind is _constants.NEGATE:
            out.append("^")
        elif kind is _constants.LITERAL:
            out.append(f"\\x{{{value:X}}}")
        elif kind is _constants.RANGE:
            out.append(f"\\x{{{value[0]:X}}}-\\x{{{value[1]:X}}}")
        else:
            out.append(_escape(_CATEGORIES[value], exact_words, True))
    return "[" + "".join(out) + "]"


def _print(tree, exact_words: bool) -> str:
    """The Java spelling of a parsed pattern, node by node."""
    c, out = _constants, []
    for kind, value in tree:
        if kind is c.LITERAL:
            out.append(_literal(value))
        elif kind is c.NOT_LITERAL:
            out.append(f"[^\\x{{{value:X}}}]")
        elif kind is c.ANY:
            out.append(".")
        elif kind is c.IN:
            out.append(_set(value, exact_words))
        elif kind is c.BRANCH:
            out.append("(?:" + "|".join(_print(x, exact_words) for x in value[1]) + ")")
        elif kind is c.SUBPATTERN:
            group, add, remove, inner = value
            if (add | remove) & (re.ASCII | re.LOCALE):
                raise ValueError("patterns in ASCII or locale mode are not supported")
            on, off = ("".join(f for f, bit in _JAVA_FLAGS if x & bit) for x in (add, remove))
            body = _print(inner, exact_words)
            head = f"?{on}{'-' + off if off else ''}:"
            out.append(f"({body})" if group is not None and head == "?:" else f"((?{on}{'-' + off if off else ''}:{body}))" if group is not None else f"({head}{body})")
        elif kind in _REPEATS:
            least, most, inner = value
            times = f"{{{least},{'' if most is c.MAXREPEAT else int(most)}}}"
            out.append(f"(?:{_print(inner, exact_words)}){times}{_REPEATS[kind]}")
        elif kind is c.ATOMIC_GROUP:
            out.append(f"(?>{_print(value, exact_words)})")
        elif kind in (c.ASSERT, c.ASSERT_NOT):
            direction, inner = value
            out.append(f"(?{'<' if direction < 0 else ''}{'=' if kind is c.ASSERT else '!'}{_print(inner, exact_words)})")
        elif kind is c.GROUPREF:
            out.append(f"(?:\\{value})")
        elif kind is c.FAILURE:
            out.append("(?!)")
        elif kind is c.AT and value in _ANCHORS:
            out.append(_ANCHORS[value])
        elif kind is c.AT and value in _BOUNDARIES:
            out.append(_escape(_BOUNDARIES[value], exact_words, False))
        else:
            raise ValueError(f"Java's patterns have no {str(kind).lower()}")
    return "".join(out)


def py_regex(pattern: str, ignore_case: bool = False, *, exact_words: bool = True) -> str:
    """A Python pattern ready for ``rlike``/``regexp_replace``: Java spelling plus
    flags (Unicode classes and case folding, only ``\\n`` ends a line)."""
    return ("(?idU)" if ignore_case else "(?dU)") + java_pattern(pattern, exact_words=exact_words)


def has_word_difference(c: str | Column) -> Column:
    """True where the text holds a character on which Java's and Python's ``\\w`` disagree."""
    return col_of(c).rlike(WORD_DIFFERENCE)


def python_regex_column(c: str | Column, build) -> Column:
    """Evaluate ``build(text, exact_words)`` exactly as Python ``re`` would.

    Rows free of ``WORD_DIFFERENCE`` characters (nearly all) use Java's native
    word escapes; the rest use the written-out Python definitions.  Both paths
    are compiled once; the choice is one character-class scan per row.
    """
    c = col_of(c)
    return F.when(has_word_difference(c), build(c, True)).otherwise(build(c, False))


def py_search(c: str | Column, pattern: str, ignore_case: bool = True) -> Column:
    """``re.search(pattern, s, re.IGNORECASE)`` as a boolean column (null on null)."""
    return python_regex_column(c, lambda t, exact: t.rlike(py_regex(pattern, ignore_case, exact_words=exact)))


def java_replacement(s: str) -> str:
    """Quote a literal replacement for ``regexp_replace`` (``$`` and ``\\`` are special)."""
    return s.replace("\\", "\\\\").replace("$", "\\$")


def ascii_ratio(c: str | Column) -> Column:
    """Share of code points below 128; 0.0 for the empty string (null on null)."""
    c = col_of(c)
    n = F.length(c)
    n_ascii = F.length(F.regexp_replace(c, r"[^\x00-\x7F]", ""))
    return F.when(n == 0, F.lit(0.0)).otherwise(n_ascii.cast("double") / n.cast("double"))


def normalize_newlines(c: str | Column) -> Column:
    """Universal newlines: ``\\r\\n`` and lone ``\\r`` become ``\\n``."""
    return F.regexp_replace(col_of(c), "\r\n?", "\n")


def split_lines(c: str | Column) -> Column:
    """``s.split('\\n')`` keeping empty pieces (limit -1)."""
    return F.split(col_of(c), "\n", -1)


def duck_ws_chars() -> str:
    """The Python whitespace set as a DuckDB string expression (for oracles)."""
    return "(" + " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"
