"""Configs in the part of YAML that they use, interpolations among their values, and their parameters in bulk.

Read: mappings and lists by indentation, flow collections on one line, quoted and plain scalars, block scalars and comments. Anchors,
tags and documents in one file are not part of it and raise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.runs import parameters, shown

# Plain scalars that are no strings.
NULLS = {"", "~", "null", "Null", "NULL"}
TRUE = {"true", "True", "TRUE", "yes", "Yes", "YES", "on", "On", "ON"}
FALSE = {"false", "False", "FALSE", "no", "No", "NO", "off", "Off", "OFF"}
_INT = re.compile(r"[-+]?(0|[1-9][0-9_]*)")
_FLOAT = re.compile(r"[-+]?(\.[0-9]+|[0-9][0-9_]*\.[0-9_]*|[0-9][0-9_]*(?=[eE]))([eE][-+]?[0-9]+)?")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'\[\]{},#&*!|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?=\s|$)""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/"}
_INNER = re.compile(r"\$\{([^${}]*)\}")


def _quoted(text: str, at: int) -> tuple[str, int]:
    """The string that begins at a quote, and where it ends."""
    quote, out, i = text[at], [], at + 1
    while i < len(text):
        c = text[i]
        if c == quote == "'" and text[i + 1 : i + 2] == "'":
            out.append("'")
            i += 2
        elif c == quote:
            return "".join(out), i + 1
        elif c == "\\" and quote == '"':
            e = text[i + 1 : i + 2]
            wide = {"x": 2, "u": 4, "U": 8}.get(e, 0)
            if not wide and e not in _ESCAPES:
                raise ValueError(f"unknown escape \\{e}")
            out.append(chr(int(text[i + 2 : i + 2 + wide], 16)) if wide else _ESCAPES[e])
            i += 2 + wide
        else:
            out.append(c)
            i += 1
    raise ValueError(f"no end of {text[at:]!r}")


def scalar(text: str) -> object:
    """A plain scalar: null, boolean, whole number, number or string."""
    if text in NULLS:
        return None
    if text in TRUE or text in FALSE:
        return text in TRUE
    if _INT.fullmatch(text):
        return int(text.replace("_", ""))
    if _FLOAT.fullmatch(text):
        return float(text.replace("_", ""))
    if text.lower().lstrip("+-") in (".inf", ".nan"):
        return float(text.lower().replace(".", ""))
    if text[0] in "&*!@`%":
        raise ValueError(f"not read here: {text!r}")
    return text


def _flow(text: str, at: int, ends: str) -> tuple[object, int]:
    """The value at a place of a line, up to a character of ends, and where it ends."""
    while text[at : at + 1].isspace():
        at += 1
    c = text[at : at + 1]
    if c in ("[", "{"):
        out: list | dict = [] if c == "[" else {}
        close, at = ("]" if c == "[" else "}"), at + 1
        while True:
            while text[at : at + 1].isspace() or text[at : at + 1] == ",":
                at += 1
            if at >= len(text):
                raise ValueError(f"no {close} in {text!r}")
            if text[at] == close:
                return out, at + 1
            value, at = _flow(text, at, f",{close}" if c == "[" else f":,{close}")
            if c == "[":
                out.append(value)
                continue
            key, value = value, None
            while text[at : at + 1].isspace():
                at += 1
            if text[at : at + 1] == ":":
                value, at = _flow(text, at + 1, f",{close}")
            out[key if isinstance(key, str) else str(key)] = value
    if c and c in "\"'":
        return _quoted(text, at)
    start, depth = at, 0
    while at < len(text) and (depth or text[at] not in ends or (text[at] == ":" and text[at + 1 : at + 2].strip())):
        depth += {"{": 1, "}": -1}.get(text[at], 0) if text[at - 1 : at] == "$" or depth else 0
        at += 1
    return scalar(text[start:at].strip()), at


_COMMENT = re.compile(r"""(?:(?<![^\s\[{,:])(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*')|[^#]|(?<=\S)#)*""")


def _uncommented(line: str) -> str:
    """The line up to a # that begins it or follows white space, outside of quotes."""
    return _COMMENT.match(line)[0].rstrip()


class _Reader:
    def __init__(self, text: str):
        self.raw = [line for line in text.replace("\t", "  ").splitlines() if line.strip() not in ("---", "...")]
        self.at = 0

    def peek(self) -> tuple[int, str] | None:
        while self.at < len(self.raw):
            line = _uncommented(self.raw[self.at])
            if line.strip():
                return len(line) - len(line.lstrip()), line.strip()
            self.at += 1
        return None

    def value(self, rest: str, indent: int) -> object:
        """What stands behind a key or a dash: here, or in the lines below."""
        if rest and rest[0] in "|>" and rest[1:].strip("+-0123456789") == "":
            return self.block_scalar(rest, indent)
        if rest:
            found, at = _flow(rest, 0, "")
            if rest[at:].strip():
                raise ValueError(f"unexpected {rest[at:]!r}")
            return found
        below = self.peek()
        if below and (below[0] > indent or (below[0] == indent and below[1].startswith("- "))):
            return self.block(below[0])
        return None

    def block_scalar(self, kind: str, indent: int) -> str:
        lines = []
        while self.at < len(self.raw) and (not self.raw[self.at].strip() or len(self.raw[self.at]) - len(self.raw[self.at].lstrip()) > indent):
            lines.append(self.raw[self.at])
            self.at += 1
        margin = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
        cut = [x[margin:].rstrip() for x in lines]
        while cut and not cut[-1]:
            cut.pop()
        text = "\n".join(cut) if kind[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(cut)).replace("\n\n", "\n")
        return text if "-" in kind else text + "\n"

    def block(self, indent: int) -> object:
        """The mapping or list whose lines begin at indent."""
        first = self.peek()
        out: list | dict = [] if first[1] == "-" or first[1].startswith("- ") else {}
        while (line := self.peek()) and line[0] == indent:
            text = line[1]
            if isinstance(out, list):
                if not (text == "-" or text.startswith("- ")):
                    break
                rest = text[1:].strip()
                if _KEY.match(rest) and rest[0] not in "[{":  # a mapping that begins behind the dash
                    inner = indent + len(text) - len(rest)
                    self.raw[self.at] = " " * inner + rest
                    out.append(self.block(inner))
                    continue
                self.at += 1
                out.append(self.value(rest, indent))
                continue
            m = _KEY.match(text)
            if not m:
                raise ValueError(f"neither a key nor an item: {text!r}")
            key = _quoted(m[1], 0)[0] if m[1][0] in "\"'" else m[1]
            if key in out:
                raise ValueError(f"{key!r} occurs twice")
            self.at += 1
            out[key] = self.value(text[m.end() :].strip(), indent)
        if line and line[0] > indent:
            raise ValueError(f"unexpected indentation of {line[1]!r}")
        return out


def parse(text: str) -> object:
    """The value of a config's text; None if there is none."""
    reader = _Reader(text)
    first = reader.peek()
    if not first:
        return None
    if not _KEY.match(first[1]) and not first[1].startswith("- ") and first[1] != "-":
        lines = [x for x in map(_uncommented, reader.raw) if x.strip()]
        if len(lines) > 1 and first[1][0] not in "[{\"'":
            raise ValueError(f"neither a key nor an item: {first[1]!r}")
        return reader.value(" ".join(x.strip() for x in lines), -1)
    out = reader.block(first[0])
    if reader.peek():
        raise ValueError(f"unexpected {reader.peek()[1]!r}")
    return out


def divide(a: object, b: object) -> int:
    """The whole part of a quotient."""
    return int(float(a) / float(b))


RESOLVERS: dict[str, Callable] = {"divide": divide}


def resolved(config: Mapping, resolvers: Mapping[str, Callable] = RESOLVERS) -> dict:
    """config with its interpolations replaced: ${a.b} by the value at that path, ${name:x,y} by what a resolver makes of its arguments.

    A value that is one interpolation keeps its type; inside a longer string it is spelled out. Arguments and paths may hold
    interpolations. Unknown paths and resolvers, and values that lead back to themselves, raise.
    """

    def at(path: str, seen: tuple) -> object:
        if path in seen:
            raise ValueError(f"${{{path}}} leads back to itself")
        value: object = config
        for part in path.split("."):
            if isinstance(value, Mapping) and part in value:
                value = value[part]
            elif isinstance(value, list) and part.isdigit() and int(part) < len(value):
                value = value[int(part)]
            else:
                raise ValueError(f"nothing at ${{{path}}}")
        return whole(value, (*seen, path))

    def one(inner: str, seen: tuple) -> object:
        name, colon, arguments = inner.partition(":")
        if not colon:
            return at(inner.strip(), seen)
        if name.strip() not in resolvers:
            raise ValueError(f"no resolver {name!r}")
        return resolvers[name.strip()](*[scalar(a.strip()) for a in arguments.split(",")])

    def whole(value: object, seen: tuple) -> object:
        if isinstance(value, Mapping):
            return {k: whole(v, seen) for k, v in value.items()}
        if isinstance(value, list):
            return [whole(v, seen) for v in value]
        while isinstance(value, str) and (m := _INNER.search(value)):
            found = one(m[1], seen)
            if m[0] == value:
                return found
            value = f"{value[: m.start()]}{'' if found is None else found}{value[m.end() :]}"
        return value

    return whole(config, ())


def _table(resolve: bool) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, text in zip(pdf["file"], pdf["text"]):
                try:
                    config = parse(text or "")
                    if not isinstance(config, Mapping):
                        raise ValueError("the config is no mapping")
                    run_id, found = parameters(resolved(config) if resolve else config)
                    rows += [(file, run_id, k, shown(v), None) for k, v in found.items()]
                except (ValueError, TypeError, ZeroDivisionError, OverflowError) as e:
                    rows.append((file, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["file", "run", "param", "value", "problem"])

    return run


def config_parameters(configs: DataFrame, file: str = "file", text: str = "text", resolve: bool = False) -> DataFrame:
    """(file, run, param, value, problem) of config texts: a row a parameter, as it is displayed.

    A config that can't be read has one row with its problem. Without resolve parameters that hold interpolations are left out.
    Configs are dealt out to more tasks than there are cores: they are read slowly, but a table of them is one small file.
    """
    tasks = 4 * configs.sparkSession.sparkContext.defaultParallelism
    rows = configs.select(F.col(file).cast("string").alias("file"), F.col(text).alias("text")).repartition(tasks)
    return rows.mapInPandas(_table(resolve), "file string, run string, param string, value string, problem string")


def checked_language(language: str | None, codes: Mapping[str, str], detect: str = "detect") -> str | None:
    """A language that a model knows, as it was given: a code, or the name of one, in any case.

    codes maps codes to names. None for the word that leaves the choice to the model. A language that is not set
    raises, as it is more often forgotten than meant, and so does one that the model does not know.
    """
    if language is None:
        raise ValueError(f"no language is set; give one of {', '.join(sorted(codes))}, or {detect!r}")
    plain = str(language).lower()
    if plain == detect:
        return None
    if plain in codes or plain in {name.lower() for name in codes.values()}:
        return language
    raise ValueError(f"unknown language {language!r}; give one of {', '.join(sorted(codes))}, or {detect!r}")
