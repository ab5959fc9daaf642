"""The general redactor: any value of any type, by style, and custom patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textward.functions.spans import let, spans, splice

STYLES = ("full", "partial", "hash")


def redact_value(value: Column, kind: Column, style: str = "full", template: str | None = None, placeholder: str = "[REDACTED]") -> Column:
    """A value's redacted form. Partial: the template if given, else what is usual for the type, else first and last two characters."""
    if style not in STYLES:
        raise ValueError(f"unknown redaction style {style!r}")
    if style == "full":
        return F.lit(placeholder)
    if style == "hash":
        return F.concat(F.lit("["), F.upper(kind), F.lit(":"), F.substring(F.sha2(value, 256), 1, 8), F.lit("]"))
    n, last, first = F.length(value), F.right(value, F.lit(4)), F.substring(value, 1, 1)
    if template:
        out = F.when(n >= 4, F.replace(F.lit(template), F.lit("{last4}"), last)).otherwise(F.lit(template))
        for mark in ("{first}", "{first_char}"):
            out = F.when(n >= 1, F.replace(out, F.lit(mark), first)).otherwise(out)
        return out
    stars = lambda k: F.repeat(F.lit("*"), k)
    return (
        F.when(n <= 4, stars(n))
        .when(kind == "ssn", F.concat(F.lit("***-**-"), last))
        .when(kind.startswith("credit_card"), F.concat(F.lit("****-****-****-"), last))
        .when(kind.startswith("phone"), F.concat(F.lit("(***) ***-"), last))
        .when(kind == "email", F.concat(first, F.when(F.locate("@", value) > 1, F.lit("***@***.***")).otherwise(F.lit("***"))))
        .when(n > 6, F.concat(F.substring(value, 1, 2), stars(n - 4), F.right(value, F.lit(2))))
        .otherwise(F.concat(stars(n - 2), F.right(value, F.lit(2))))
    )


def redact(text: Column, found: Column, style: str = "full", placeholder: str = "[REDACTED]") -> Column:
    """struct(original_text, redacted_text, redactions, redaction_count, was_modified); ``found`` is array<struct<type,start,end>>.

    Redactions are listed from the last start to the first.
    """

    def build(f):
        done = F.transform(f, lambda x, i: F.struct((-x["start"]).alias("k"), i.alias("ord"), x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"), (x["end"] - x["start"]).alias("original_length"), redact_value(F.substring(text, x["start"] + 1, x["end"] - x["start"]), x["type"], style, None, placeholder).alias("new")))

        def end(d):
            new = F.when(F.size(d) == 0, text).otherwise(splice(text, d))
            listed = F.transform(F.array_sort(d), lambda x: F.struct(x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"), x["original_length"].alias("original_length"), x["new"].alias("redacted_value")))
            return let(new, lambda n: F.struct(text.alias("original_text"), n.alias("redacted_text"), listed.alias("redactions"), F.size(d).alias("redaction_count"), (n != text).alias("was_modified")))

        return let(done, end)

    return let(found, build)


def redact_pattern(text: Column, pattern: str, kind: str = "custom", style: str = "full", placeholder: str = "[REDACTED]") -> Column:
    """As :func:`redact`, of all matches of a pattern of one's own."""
    return redact(text, F.transform(spans(text, pattern), lambda x: F.struct(F.lit(kind).alias("type"), x["start"].alias("start"), x["end"].alias("end"))), style, placeholder)
