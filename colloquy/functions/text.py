"""Column-level text helpers (all JVM-side expressions, no Python UDFs)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that make up a "word" for whole-word matching: Unicode letters,
# digits and underscore (the rule Python's ``\b`` applies to str patterns).
WORD_CHARS = r"\p{L}\p{N}_"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regex_quote(term: str) -> str:
    """Escape every non-alphanumeric character so ``term`` matches literally
    (valid for Java and RE2 alike)."""
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in term)


def whole_word_pattern(term: str) -> str:
    """Regex matching ``term`` only where it is not glued to other word
    characters. Explicit look-arounds keep the rule independent of the JDK's
    ``\\b`` definition."""
    return f"(?<![{WORD_CHARS}]){regex_quote(term)}(?![{WORD_CHARS}])"


def contains_word(text: str | Column, term: str) -> Column:
    return col_(text).rlike(whole_word_pattern(term))


def contains_any(text: str | Column, needles: Iterable[str]) -> Column:
    """Case-sensitive substring test against any needle (SQL ``LIKE '%x%'``)."""
    cond = F.lit(False)
    for n in needles:
        cond = cond | col_(text).contains(F.lit(n))
    return cond


def first_match(text: str | Column, terms: Iterable[str], labels: Iterable[str] | None = None,
                lower: bool = True) -> Column:
    """Label of the first term (in list order) contained in ``text``.

    Compiles a dictionary into one CASE chain: a projection with no join and
    no shuffle, evaluated inside whole-stage codegen. Returns NULL when no
    term matches.
    """
    terms = list(terms)
    labels = list(labels) if labels is not None else terms
    subject = F.lower(col_(text)) if lower else col_(text)
    out = None
    for term, label in zip(terms, labels):
        needle = term.lower() if lower else term
        cond = subject.contains(F.lit(needle))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out if out is not None else F.lit(None).cast("string")


def strip_ws(c: str | Column) -> Column:
    """Remove leading and trailing whitespace, Unicode blanks included
    (``str.strip``); Spark's ``trim`` removes spaces only."""
    return F.regexp_replace(col_(c), r"(?U)^\s+|\s+$", "")


def python_title(c: str | Column) -> Column:
    """``str.title()``: upper-case a letter that follows a non-letter, lower-case
    every other letter. ``initcap`` splits on spaces only, so 'foo-bar 3com'
    would become 'Foo-bar 3com' instead of 'Foo-Bar 3Com'."""
    chars = F.split(F.lower(col_(c)), "")
    titled = F.transform(
        chars,
        lambda ch, i: F.when((i == 0) | ~F.element_at(chars, F.greatest(i, F.lit(1))).rlike(r"^\p{L}$"),
                             F.upper(ch)).otherwise(ch),
    )
    return F.when(col_(c).isNull(), F.lit(None).cast("string")).otherwise(F.array_join(titled, ""))


def iso_to_timestamp(c: str | Column) -> Column:
    """ISO-8601 text (``...Z`` or with an offset) to a UTC wall-clock
    TIMESTAMP_NTZ; empty or unparsable text gives NULL."""
    parsed = F.try_to_timestamp(F.nullif(col_(c), F.lit("")))
    return parsed.cast("timestamp_ntz")


def local_part(email: str | Column) -> Column:
    """Text before the first '@' (the whole string if there is none)."""
    return F.substring_index(col_(email), "@", 1)


def domain_part(email: str | Column) -> Column:
    """Text between the first and the second '@' (``email.split('@')[1]``),
    NULL when there is no '@'."""
    return F.get(F.split(col_(email), "@"), 1)


def domain_label(email: str | Column) -> Column:
    """First dot-separated label of the domain."""
    return F.substring_index(domain_part(email), ".", 1)


def display_name(host: str | Column) -> Column:
    """Host display name: local part split on '.', each piece with its first
    character upper-cased, joined by spaces."""
    pieces = F.split(local_part(host), r"\.")
    return F.array_join(
        F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))),
        " ")


def label_with_ellipsis(c: str | Column, n: int) -> Column:
    """First ``n`` characters followed by '...' (always appended)."""
    return F.concat(F.substring(col_(c), 1, n), F.lit("..."))


def py_float_text(c: str | Column) -> Column:
    """Text of a double as Python prints it for the common cases: integral
    values keep one decimal ('12.0'), others use the shortest round-trip form;
    NULL prints as 'None'."""
    x = col_(c).cast("double")
    integral = x == F.floor(x)
    return (F.when(x.isNull(), F.lit("None"))
            .when(integral & (F.abs(x) < 1e16), F.format_string("%.1f", x))
            .otherwise(x.cast("string")))


def py_text(c: str | Column) -> Column:
    """Text of a string column as Python's f-string prints it (NULL -> 'None')."""
    return F.coalesce(col_(c).cast("string"), F.lit("None"))


def template_parts(template: str) -> list[tuple[str, str | None]]:
    """Split 'a {x} b' into [('a ', 'x'), (' b', None)]."""
    import re
    out, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        out.append((template[pos:m.start()], m.group(1)))
        pos = m.end()
    out.append((template[pos:], None))
    return out


def render_template(template: str, floats: tuple[str, ...] = ()) -> Column:
    """Fill ``{name}`` placeholders with column values as Python's f-string
    prints them (``floats`` name the double columns)."""
    pieces = []
    for text, name in template_parts(template):
        if text:
            pieces.append(F.lit(text))
        if name:
            pieces.append(py_float_text(name) if name in floats else py_text(name))
    return F.concat(*pieces)
