"""Text of formulas, LaTeX and code as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters that stand for brackets, glyphs that large brackets are built of (a run of one row is one bracket), and relations with their negated forms.
CONTROLS = {"\x10": "(", "\x11": ")"}
BUILT = {"\\begin{cases}": "\uf8f1\uf8f2\uf8f3\uf8f4", "(": "\uf8eb\uf8ec\uf8ed", ")": "\uf8f6\uf8f7\uf8f8"}
NEGATED = {"=": "≠", "<": "≮", ">": "≯", "∈": "∉", "≡": "≢", "∼": "≁", "⊆": "⊈", "⊂": "⊄"}
SLASH = "\u0338"
#: The styled letters and digits of mathematics, each with its plain form, by Unicode's compatibility rule.
STYLED = {c: p for c in map(chr, range(0x1D400, 0x1D800)) if len(p := unicodedata.normalize("NFKC", c)) == 1 and p != c}
#: What one character becomes, wherever it stands: brackets, plain letters, and nothing for control characters but tab and line feed. CASES stands for an open case until the end, EDGE for an end of line beside one.
CASES, EDGE = "\ue000", "\ue001"
SINGLE = {chr(k): "" for k in range(32) if chr(k) not in "\t\n"} | CONTROLS | {g: k if len(k) == 1 else CASES for k, row in BUILT.items() for g in row} | STYLED


def spaced_lines(text: Column) -> Column:
    """Runs of blanks to one, lines trimmed, blank lines to one, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), " ?\\n ?", "\n"), "\\n{3,}", "\n\n"), "^[ \\n]+|[ \\n]+$", "")


def _each_to_one(text: Column, mapping: dict[str, str]) -> Column:
    """One translation; what maps to nothing comes last, as translate wants it."""
    order = sorted(mapping, key=lambda c: mapping[c] == "")
    return F.translate(text, "".join(order), "".join(mapping[c] for c in order))


def _struck(text: Column) -> Column:
    """Relations that a slash strikes out (it comes after its sign, or before it where none is there) as negated ones; other slashes go. What stands before a slash is the end of a piece."""
    signs = "".join(NEGATED)
    after = F.regexp_replace(text, f"(?<![{signs}]){SLASH} ?([{signs}])", f"$1{SLASH}")
    pieces = F.split(after, SLASH)
    negated = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.concat(F.substring(p, 1, F.length(p) - 1), _each_to_one(F.right(p, F.lit(1)), NEGATED)))
    return F.concat(F.array_join(negated, ""), F.element_at(pieces, -1))


def math_text(text: Column) -> Column:
    """Text of formulas as PDF files give it, with plain letters: bracket glyphs, styled letters, struck relations; open cases are closed."""
    runs = "|".join(f"([{row}])[{row}]+" for row in BUILT.values())
    parted = F.regexp_replace(F.regexp_replace(text, runs, "$1$2$3"), "([\\x{1D400}-\\x{1D7FF}])(?=[A-Za-z])|([A-Za-z])(?=[\\x{1D400}-\\x{1D7FF}])", "$1$2 ")
    t = F.replace(_each_to_one(parted, SINGLE), F.lit(CASES), F.lit("\\begin{cases}"))
    # a begin or end stands on a line of its own, once if repeated; with nothing between them a blank line is left
    t = F.regexp_replace(t, "\\s*(\\\\(?:begin|end)\\{cases\\})(?:\\s*\\1)*\\s*", f"{EDGE}$1{EDGE}")
    t = F.regexp_replace(t, f"\\\\begin\\{{cases\\}}{EDGE}+\\\\end\\{{cases\\}}", "\n")
    t = spaced_lines(_struck(F.regexp_replace(t, f"{EDGE}+", "\n")))
    missing = F.regexp_count(t, F.lit("\\\\begin\\{cases\\}")) - F.regexp_count(t, F.lit("\\\\end\\{cases\\}"))
    return F.concat(t, F.repeat(F.lit("\n\\end{cases}"), F.greatest(F.lit(0), missing)))


def tidy(text: Column) -> Column:
    """Ends of lines and of the text trimmed, blank lines to one."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[ \\t\\r]+\\n", "\n"), "\\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def latex_text(text: Column) -> Column:
    """LaTeX that can stand in a display block: no dollar signs but escaped ones, tables as arrays."""
    t = F.trim(F.replace(tidy(text), F.lit("$$"), F.lit("")))
    t = F.regexp_replace(t, "(^|[^\\\\])\\$", "$1")
    return F.replace(F.replace(t, F.lit("\\begin{tabular}"), F.lit("\\begin{array}")), F.lit("\\end{tabular}"), F.lit("\\end{array}"))


def latex_blocks(text: Column) -> Column:
    """Each formula of a text as a display block of its own."""
    parts = F.filter(F.transform(F.split(latex_text(text), "\\s*---FORMULA---\\s*"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("$$\n"), p, F.lit("\n$$"))), "\n\n")


def code_text(text: Column) -> Column:
    """Code without the fence around it, tabs as four blanks, without blank lines at its ends and without the indent that all its lines share."""
    body = F.regexp_replace(F.regexp_replace(text, "^\\s*```[A-Za-z0-9_-]*\\n", ""), "\\n?```\\s*$", "")
    lines = F.transform(F.split(F.replace(body, F.lit("\t"), F.lit("    ")), "\n"), lambda x: F.rtrim(x))
    shared = F.coalesce(F.array_min(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.length(x) - F.length(F.ltrim(x)))), F.lit(0))
    return F.regexp_replace(F.array_join(F.transform(lines, lambda x: F.substring(x, shared + 1, F.length(x))), "\n"), "^\\n+|\\n+$", "")
