"""Text normalization as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and \s see it, spelled out because Java's and DuckDB's classes differ.
WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = WS.replace(r"\x1c-\x20", r"\x1c-\x1f")  # without the space
FORMS = ("NFC", "NFKC", "NFD", "NFKD")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def flatten_whitespace(text: Column) -> Column:
    """Runs of white space become one space; none at the ends. Lone spaces, which are the most, are not replaced."""
    return F.trim(F.regexp_replace(text, f"[{_ODD}][{WS}]*| [{WS}]+", " "))


def drop_punctuation(text: Column) -> Column:
    """Keeps letters, digits, underscore, white space and the apostrophe; marks that are not composed go too."""
    return F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}_{WS}']", "")


def replace_all(text: Column, replacements: Mapping[str, str]) -> Column:
    """Literal replacements, one after the other in the order given."""
    for old, new in replacements.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unicode_form(text: Column, form: str) -> Column:
    """Unicode normalization; texts of ASCII alone reach the Arrow function as null and stay as they are."""
    if form not in FORMS:
        raise ValueError(f"unknown Unicode form {form!r}; one of {', '.join(FORMS)}")

    @F.pandas_udf("string")
    def normalized(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return F.coalesce(normalized(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


@dataclass(frozen=True)
class TextSettings:
    lowercase: bool = True
    remove_punctuation: bool = True
    unicode_normalize: str | None = "NFC"
    replacements: Mapping[str, str] = field(default_factory=dict)


def normalizer(s: TextSettings = TextSettings()) -> Callable[[Column], Column]:
    """Replacements, Unicode form, lower case, punctuation with white space runs, strip; in this order."""

    def apply(text: Column) -> Column:
        text = replace_all(text, s.replacements)
        if s.unicode_normalize:
            text = unicode_form(text, s.unicode_normalize)
        if s.lowercase:
            text = F.lower(text)
        if s.remove_punctuation:
            text = F.regexp_replace(drop_punctuation(text), f"[{WS}]+", " ")
        return strip(text)

    return apply


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


def dirname(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "(?<=[^/])/+$", "")


def relative_path(path: Column, root: str) -> Column:
    """path below the folder root; others stay."""
    start = root.rstrip("/") + "/"
    return F.when(path.startswith(start), F.substr(path, F.lit(len(start) + 1))).otherwise(path)


def split_values(cell: Column, separator: str = ";") -> Column:
    """The non-empty values of a cell; the separator is literal. F.array_join joins them back."""
    return F.filter(F.split(F.coalesce(cell, F.lit("")), f"\\Q{separator}\\E"), lambda x: x != "")


def slug_of(name: str) -> str:
    """slug() of a string in the driver."""
    return "".join(c if c.isalnum() else "-" for c in name).strip("-").lower()


def slug(text: Column) -> Column:
    """Lower case; every character but letters and digits becomes '-', with none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]", "-"), "^-+|-+$", ""))


def extract_key(source: Column, pattern: str, from_path: bool = True) -> Column:
    """Group 1 of the first match of pattern in the basename (or value); null if missing or unmatched."""
    name = basename(source) if from_path else source
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def compact_number(value: Column) -> Column:
    """9000000 as 9M and 200000 as 200k; other whole numbers as they are, small fractions in exponent form; booleans in lower case are cast by Spark."""
    whole = value.cast("long")
    exact = F.when(whole % 1000000 == 0, F.concat((whole / 1000000).cast("long").cast("string"), F.lit("M"))).when(whole % 1000 == 0, F.concat((whole / 1000).cast("long").cast("string"), F.lit("k"))).otherwise(whole.cast("string"))
    return F.when(value == 0, F.lit("0")).when(value == whole, exact).when(F.abs(value) < 0.001, F.format_string("%.1e", value)).otherwise(value.cast("string"))


#: Characters or bytes of a batch that Python takes up at once; what it makes of them may be many times as large.
PORTION = 1 << 20


def portions(sizes: Sequence[int], most: int | None = None) -> Iterator[slice]:
    """Slices that together are all rows of a batch, in order, each of at most most in size or of one row."""
    most = PORTION if most is None else most
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))
