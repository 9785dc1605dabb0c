"""String functions (STR) as columns; the two that callbacks need are Arrow-batched."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Abbreviated operators and how they read.
OPERATORS = {"dim": "dimension", "ker": "kernel", "coker": "cokernel", "im": "image", "det": "determinant", "tr": "trace", "Hom": "space of homomorphisms", "End": "space of endomorphisms"}
# Dashes that count as a hyphen.
DASHES = "[\u2010\u2011\u2013\u2014]"
# Labels and titles that mean nothing, and what heads the second line of spelt-out operators.
NOTHING = ("null", "undefined", "none", "untitled result")
SPELT = "Readable notation:"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normal form, for which Spark has no function."""
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def squeezed(text: Column) -> Column:
    """STR-02: one blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, DASHES, "-"), r"\s+", " "))


def normalised(text: Column) -> Column:
    """STR-01: NFKC, lower case, one kind of dash, one blank."""
    return squeezed(F.lower(nfkc(text)))


def quoted(text: Column) -> Column:
    """STR-04: a pattern that matches the text itself."""
    return F.concat(F.lit("\\Q"), text, F.lit("\\E"))


def mentioned(text: Column, name: Column) -> Column:
    """STR-03: the name stands in the text, not inside a word and not before a decimal part."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted(name), F.lit(r"(?![\p{L}\p{N}]|\.\d)")))


def label(kind: Column, number: Column) -> Column:
    """STR-05: `Theorem 3.4`."""
    return F.concat(F.initcap(kind), F.lit(" "), number)


def body(statement: Column, head: Column, title: Column) -> Column:
    """STR-06: a statement without its own heading and bracketed title."""
    bare = F.regexp_replace(statement, F.concat(F.lit(r"^\s*"), quoted(F.coalesce(head, F.lit(""))), F.lit(r"\s*")), F.lit(""))
    return F.when(title.isNull(), bare).otherwise(F.regexp_replace(bare, F.concat(F.lit(r"^\("), quoted(F.coalesce(title, F.lit(""))), F.lit(r"\)\s*")), F.lit("")))


def readable(text: Column) -> Column:
    """STR-07: the text, and if it has abbreviated operators a second line that spells them out."""
    out = F.regexp_replace(text, r"\\operatorname\{([^}]+)\}", "$1")
    for short, full in OPERATORS.items():
        out = F.regexp_replace(out, rf"(?<!\p{{L}})\\?{short}(?![\p{{L}}\p{{N}}_])", full)
    return F.when(out == text, text).otherwise(F.concat(text, F.lit(f"\n{SPELT} "), out))


def tokens(text: Column) -> Column:
    """STR-08: distinct words of letters and numbers, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


@F.pandas_udf(StringType())
def substituted(text: pd.Series, pairs: pd.Series) -> pd.Series:
    """STR-09: symbols replaced all at once, longest first, whole ones only. pairs: map of symbol to symbol."""

    def one(x, m):
        m = dict(m) if m is not None else {}
        if x is None or not m:
            return x
        names = "|".join(regex.escape(s) for s in sorted(m, key=lambda s: (-len(s), s)))
        return regex.sub(rf"(?<![\p{{L}}_\\])(?:{names})(?![\p{{L}}\p{{N}}_])", lambda f: m[f.group()], x)

    return pd.Series([one(x, m) for x, m in zip(text, pairs, strict=True)], index=text.index, dtype=object)


def given(text: Column) -> Column:
    """Empty for null and for words that mean nothing."""
    x = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.lower(x).isin(*NOTHING), F.lit("")).otherwise(x)


def excerpt(text: Column, size: int = 64) -> Column:
    """STR-10, STR-13: at most `size` characters, cut ones end in an ellipsis."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, r"[$*_`#]", ""), r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.rtrim(F.substring(flat, 1, size - 3)), F.lit("…"))).otherwise(flat)


def node_label(title: Column, head: Column, kind: Column, statement: Column, page: Column) -> Column:
    """STR-10: what a node is called: its title, a label that says more than its kind, else an excerpt or its page."""
    name, own = F.initcap(kind), excerpt(given(statement))
    return (
        F.when(given(title) != "", given(title))
        .when((given(head) != "") & (F.lower(given(head)) != F.lower(kind)), given(head))
        .when(own == "", F.concat(name, F.lit(" · p. "), page.cast("string")))
        .otherwise(F.concat(name, F.lit(": "), own))
    )


def escaped(text: Column) -> Column:
    """STR-11: HTML text."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def csv_field(text: Column) -> Column:
    """STR-11: a quoted field."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def card_html(text: Column) -> Column:
    """STR-11: a statement as HTML with TeX delimiters that cards understand."""
    x = F.regexp_replace(escaped(text), r"(?s)\$\$(.*?)\$\$", r"\\[$1\\]")
    x = F.regexp_replace(x, r"(?<!\\)\$([^$\n]+?)(?<!\\)\$", r"\\($1\\)")
    return F.regexp_replace(x, r"\r?\n", "<br>")


def paragraphs_with(text: Column, surface: Column) -> Column:
    """STR-12: paragraphs that hold a surface."""
    return F.filter(F.split(text, r"\n\s*\n"), lambda p: F.contains(p, surface))


def occurs_once(text: Column, surface: Column) -> Column:
    """STR-12: the surface stands in exactly one paragraph, once."""
    found = paragraphs_with(text, surface)
    return (F.length(surface) > 0) & (F.size(found) == 1) & (F.size(F.split(found[0], quoted(surface))) == 2)


def is_bold(font: Column, flags: Column) -> Column:
    """STR-14: by the flags' fifth bit or the font's name."""
    return (flags.bitwiseAND(16) != 0) | F.lower(font).contains("bold")


def is_italic(font: Column, flags: Column) -> Column:
    """STR-14: by the flags' second bit or the font's name."""
    return (flags.bitwiseAND(2) != 0) | F.lower(font).contains("italic") | F.lower(font).contains("oblique")


def stem(path: Column) -> Column:
    """STR-15: a file's name without folders and extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]+$", "")
