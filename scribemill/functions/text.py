"""Text columns: cleaning, capping, keys and templates (all native expressions)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from scribemill.functions.answers import let

# Bracketed stage notes removed from transcripts, in this order.
STAGE_NOTES = ("applause", "laughter", "crosstalk")
# Limits of the corpus and of one generation prompt, in characters.
MIN_TEXT_CHARS = 200
MAX_PROMPT_CHARS = 6000
TRUNCATION_NOTE = "\n\n[truncated]"
# Chat control tokens of the instruction template.
CONTROL_TOKENS = r"\[/?INST\]|</?s>"

# The characters that Python's str.strip and str.split take as whitespace.
SPACE_CHARS = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def py_strip(c: Column) -> Column:
    """Strip both ends the way ``str.strip`` does (``trim`` only drops U+0020)."""
    return F.btrim(c, F.lit(SPACE_CHARS))


# Most texts need none of the replacements below. A plain substring test is many
# times faster than a regular expression that finds nothing, so it comes first.
# Generated code computes the repeated inner expressions once.


def remove_notes(c: Column, notes: Sequence[str] = STAGE_NOTES) -> Column:
    """Delete bracketed notes in any letter case, one pass per note, in order.

    Separate passes matter: deleting an inner note may complete an outer one.
    """
    out = c
    for note in notes:
        out = F.regexp_replace(out, rf"\[(?iu:{re.escape(note)})\]", "")
    return F.when(c.contains("["), out).otherwise(c)


def squeeze_space(c: Column) -> Column:
    """At most one empty line, then runs of blanks to one space, then strip."""
    c = F.when(c.contains("\n\n\n"), F.regexp_replace(c, r"\n{3,}", "\n\n")).otherwise(c)
    # A single space already is what it becomes, so only other runs are matched.
    loose = c.contains("  ") | c.contains("\t")
    return py_strip(F.when(loose, F.regexp_replace(c, r"[ \t]{2,}|\t", " ")).otherwise(c))


def clean_text(c: Column, notes: Sequence[str] = STAGE_NOTES) -> Column:
    return squeeze_space(remove_notes(c, notes))


def truncate(c: Column, max_chars: int = MAX_PROMPT_CHARS, note: str = TRUNCATION_NOTE) -> Column:
    """Cap at ``max_chars`` code points; only a text that was cut gets the note."""
    return F.when(F.length(c) > max_chars, F.concat(F.substring(c, 1, max_chars), F.lit(note))).otherwise(c)


def title_key(c: Column) -> Column:
    """Key under which two titles count as one: lower-case ASCII letters, digits, single spaces."""
    kept = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))
    return F.regexp_replace(kept, r"\s+", " ")


def title_matches(c: Column, contains: Sequence[str] = (), starts_with: Sequence[str] = ()) -> Column:
    """True where the lower-cased, stripped title has any of the phrases."""
    low = py_strip(F.lower(c))
    hit = F.lit(False)
    for phrase in contains:
        hit = hit | low.contains(phrase)
    for phrase in starts_with:
        hit = hit | low.startswith(phrase)
    return hit


def render(template: str, missing: str = "Unknown", **fields: Column) -> Column:
    """Fill ``{name}`` places of ``template`` with columns; null renders as ``missing``.

    Braces inside the column values stay as they are.
    """
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(fields[name].cast("string"), F.lit(missing)))
    return F.concat(*parts)


def strip_control_tokens(c: Column) -> Column:
    """Remove chat control tokens in any letter case in one pass, then strip."""
    found = c.contains("[") | c.contains("<")
    return py_strip(F.when(found, F.regexp_replace(c, f"(?iu){CONTROL_TOKENS}", "")).otherwise(c))


def _required(c: Column, name: str) -> Column:
    return F.coalesce(c, F.raise_error(F.lit(f"training example without {name}")).cast("string"))


def chat_text(instruction: Column, output: Column) -> Column:
    """One training text in the chat template; a missing part fails the job."""
    return F.concat(
        F.lit("<s>[INST] "),
        _required(instruction, "instruction"),
        F.lit(" [/INST] "),
        _required(output, "output"),
        F.lit("</s>"),
    )


def py_float_text(c: Column) -> Column:
    """A double as Python prints it: the fewest digits that read back as the same number.

    Positional from 1e-4 up to 1e16, else in the ``1e-05`` style. A double has at
    most one decimal of up to 15 digits, so where Spark's text has no more it is the
    shortest; otherwise 15, 16 and 17 digits are tried. Numbers near zero have fewer digits to begin with.
    Between 1e-3 and 1e7 Spark's text is positional too, and a short one is taken as it is.
    """
    usual = (F.abs(c) >= 1e-3) & (F.abs(c) < 1e7) & (F.length(c.cast("string")) <= 16)

    def shortest(digits: range) -> Column:
        forms = [F.format_string(f"%.{n}e", c) for n in digits]
        return F.coalesce(*[F.when(form.cast("double") == c, form) for form in forms[:-1]], forms[-1])

    def mantissa(text: Column) -> Column:
        return F.translate(F.split_part(F.lower(text), F.lit("e"), F.lit(1)), "-", "")

    def trimmed(digits: Column) -> Column:
        return F.rtrim(F.ltrim(digits, F.lit("0")), F.lit("0"))

    def chosen(plain: Column) -> Column:
        short = F.length(trimmed(F.translate(mantissa(plain), ".", ""))) <= 15
        return F.when(F.abs(c) < 2.3e-308, shortest(range(17))).when(short, plain).otherwise(shortest(range(14, 17)))

    def places(text: Column) -> Column:
        parts = F.split(mantissa(text), "[.]")
        power = F.coalesce(F.split_part(F.lower(text), F.lit("e"), F.lit(2)).try_cast("int"), F.lit(0))
        digits = F.concat(parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
        return F.struct(digits.alias("digits"), (F.length(parts[0]) - 1 + power).alias("power"))

    def leading(place: Column) -> Column:
        zeros = F.length(place["digits"]) - F.length(F.ltrim(place["digits"], F.lit("0")))
        return F.struct(trimmed(place["digits"]).alias("digits"), (place["power"] - zeros).alias("power"))

    def printed(number: Column) -> Column:
        digits, power = number["digits"], number["power"]
        sign = F.when(c < 0, "-").otherwise("")
        size = F.abs(power).cast("string")
        size = F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size)
        more = F.substring(digits, 2, 400)
        whole, rest = F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.substring(digits, power + 2, F.lit(400))
        return (
            F.when((power >= -4) & (power < 0), F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
            .when((power >= 0) & (power < 16), F.concat(sign, whole, F.lit("."), F.when(rest == "", "0").otherwise(rest)))
            .otherwise(
                F.concat(
                    sign, F.substring(digits, 1, 1), F.when(more == "", "").otherwise(F.concat(F.lit("."), more)),
                    F.when(power < 0, "e-").otherwise("e+"), size,
                )
            )
        )

    return (
        F.when(usual, c.cast("string"))
        .when(F.isnan(c), "nan")
        .when(c == float("inf"), "inf")
        .when(c == float("-inf"), "-inf")
        .when(c == 0.0, F.when(c.cast("string").startswith("-"), "-0.0").otherwise("0.0"))
        .otherwise(let(let(let(let(c.cast("string"), chosen), places), leading), printed))
    )
