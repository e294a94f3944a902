"""Structure of lines: typed variables, key=value pairs, JSON leaves, normalised skeletons.

Only the choice of the next variable needs a scanner (a key's value competes with the generic kinds for the next
place, from a cursor); it runs in Arrow batches, over pieces of bounded bytes.  Counts of kinds and pairs, and
everything after the scan, are built-in expressions.

A pattern is tried only at places that have what it can't match without (an @ for an email, say).  They are found in
copies of the text with a byte for each character: the text itself, hexadecimal digits as h, and decimal digits as d.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.patterns import JSON_BLANK, JSON_NUMBER, JSON_STRING, KEY_VALUE, KINDS, NORMAL_NAMES, NORMAL_ORDER
from loomline.sources.batches import pieces

_PAIR = re.compile(KEY_VALUE)
_SUBSTITUTIONS = [(k, re.compile(KINDS[k]), NORMAL_NAMES.get(k, f"<{k}>")) for k in NORMAL_ORDER]
_STRING, _NUMBER, _BLANK = re.compile(JSON_STRING, re.DOTALL), re.compile(JSON_NUMBER), re.compile(JSON_BLANK)
#: Distinct lines whose analysis a worker keeps, and literals whose normal form it keeps, and their length at most.
CACHED, CACHED_CHARS = 4_096, 256
_STRINGS = T.ArrayType(T.StringType())
ANALYSIS = T.StructType([T.StructField(n, _STRINGS) for n in ("parts", "values", "kinds", "skeleton")] + [T.StructField("is_json", T.BooleanType()), T.StructField("json_key", _STRINGS)])
LEAVES = T.ArrayType(T.StructType([T.StructField("path", _STRINGS), T.StructField("raw", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def _table(kept: str, **names: str) -> bytes:
    """A table for ``bytes.translate``: the characters of each name become the name, those of ``kept`` stay, all else becomes a blank."""
    return bytes(next((ord(n) for n, chars in names.items() if chr(i) in chars), i if chr(i) in kept else 32) for i in range(256))


_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_AS_HEX, _AS_DIGITS = _table(":-", h=_DIGITS + "abcdefABCDEF"), _table(":.", d=_DIGITS)
_AS_KEY, _AS_EMAIL = _table("", k=_LETTERS + _DIGITS + "_.-"), _table("", e=_LETTERS + _DIGITS + "._%+-")
#: Characters that match ASCII ones where case is ignored, and decimal digits beyond ASCII: texts with them are searched whole.
_BEYOND_ASCII = re.compile("[\u017f\u0660-\U0010ffff]")
_UUID, _HEX = b"-".join(b"h" * n for n in (8, 4, 4, 4, 12)), b"h" * 16
_ID_WORDS = re.compile(rb"req|trace|user|sess")
_COMPILED = {kind: re.compile(body) for kind, body in KINDS.items()}


class _Marks:
    """A text's copies, and the ``kinds`` that it can hold by them, in order."""

    def __init__(self, text: str):
        self.text, self.plain = text, text.encode("ascii", "replace")
        plain, kinds = self.plain, []
        self.hexes = hexes = plain.translate(_AS_HEX)
        digits = len(plain.translate(None, b"0123456789")) < len(plain)
        self.digits = plain.translate(_AS_DIGITS) if digits else b""
        colon, lower = b":" in plain, plain.lower()
        if colon and b"dd:dd:dd" in self.digits:
            kinds.append("timestamp")
        if b"-" in plain and _UUID in hexes:
            kinds.append("uuid")
        if colon and b"://" in plain:
            kinds.append("url")
        if "?" in text and b"&" in plain:
            kinds.append("query")
        if b"@" in plain:
            kinds.append("email")
        if b"d.d" in self.digits:
            kinds.append("ipv4")
        if colon and b"h:h" in hexes:
            kinds.append("ipv6")
        if b"/" in plain:
            kinds.append("path")
        if b"0x" in plain or _HEX in hexes:
            kinds.append("hex")
        self.words: list[int] = []
        if b"req" in lower or b"trace" in lower or b"user" in lower or b"sess" in lower:
            self.words = [m.start() for m in _ID_WORDS.finditer(lower)]
            kinds.append("id")
        if digits:
            kinds.append("number")
        self.kinds = kinds

    @functools.cached_property
    def keys(self) -> bytes:
        return self.plain.translate(_AS_KEY)

    @functools.cached_property
    def emails(self) -> bytes:
        return self.plain.translate(_AS_EMAIL)

    def first(self, pattern: re.Pattern, at: int, mark: Callable[[int], int], back: Callable[[int], Sequence[int]]) -> re.Match | None:
        """The first match from ``at`` on: ``mark`` gives the next mark from a place on, ``back`` the places where a match with that mark can start."""
        i = mark(at)
        while i >= 0:
            for start in back(i):
                if start >= at and (m := pattern.match(self.text, start)):
                    return m
            i = mark(i + 1)
        return None

    def find(self, kind: str, at: int) -> re.Match | None:
        """What ``search`` of the kind's pattern from ``at`` on finds."""
        pattern, one = _COMPILED[kind], lambda i: (i,)
        if kind == "timestamp":
            return self.first(pattern, at, lambda i: self.digits.find(b"dd:dd:dd", i), lambda i: (i - 13, i - 11))
        if kind == "uuid":
            return self.first(pattern, at, lambda i: self.hexes.find(_UUID, i), one)
        if kind == "url":
            return self.first(pattern, at, lambda i: self.plain.find(b"http", i), one)
        if kind == "query":
            return self.first(pattern, at, lambda i: self.text.find("?", i), one)
        if kind == "email":
            return self.first(pattern, at, lambda i: self.plain.find(b"@", i), lambda i: range(self.emails.rfind(b" ", at, i) + 1 or at, i))
        if kind == "ipv4":
            return self.first(pattern, at, lambda i: self.digits.find(b"d.d", i), lambda i: range(i - 2, i + 1))
        if kind == "ipv6":
            return self.first(pattern, at, lambda i: self.hexes.find(b"h:h", i), lambda i: range(i - 3, i + 1))
        if kind == "path":
            return self.first(pattern, at, lambda i: self.plain.find(b"/", i), lambda i: range(i - 4, i + 1))
        if kind == "hex":
            return self.first(pattern, at, lambda i: min((x for x in (self.plain.find(b"0x", i), self.hexes.find(_HEX, i)) if x >= 0), default=-1), one)
        if kind == "id":
            return self.first(pattern, at, lambda i: self.words[k] if (k := bisect_left(self.words, i)) < len(self.words) else -1, one)
        return self.first(pattern, at, lambda i: self.digits.find(b"d", i), lambda i: (i - 1, i))

    def find_pair(self, at: int) -> re.Match | None:
        return self.first(_PAIR, at, lambda i: self.plain.find(b"=", i), lambda i: range(self.keys.rfind(b" ", at, i) + 1 or at, i))


class _Whole:
    """Texts in which marks don't tell: every place is tried."""

    kinds = (*KINDS,)

    def __init__(self, text: str):
        self.text = text

    def find(self, kind: str, at: int) -> re.Match | None:
        return _COMPILED[kind].search(self.text, at)

    def find_pair(self, at: int) -> re.Match | None:
        return _PAIR.search(self.text, at)


def _marks(text: str) -> _Marks | _Whole:
    return _Marks(text) if text.isascii() or not _BEYOND_ASCII.search(text) else _Whole(text)


def scan_text(line: str) -> tuple[list[str], list[str], list[str]]:
    """(parts, values, kinds): from the cursor, the variable that starts first is taken; of two that start together
    the longer, and of equals the key's value.  Of two kinds that start together the earlier in ``KINDS`` stands for both."""
    parts, values, kinds, at = [], [], [], 0
    marks = _marks(line)
    pair = marks.find_pair(0) if "=" in line else None
    found = [m for k in marks.kinds if (m := [k, marks.find(k, 0)])[1]]
    while at < len(line):
        if pair and pair.start() < at:
            pair = marks.find_pair(at)
        first, lost = None, False
        for one in found:
            if one[1].start() < at:
                one[1] = marks.find(one[0], at)
                if not one[1]:
                    lost = True
                    continue
            if first is None or one[1].start() < first[1].start():
                first = one
        if lost:
            found = [x for x in found if x[1]]
        options = []
        if pair:
            options.append((pair.start(2), -pair.end(2), 0, "kv:" + pair[1].lower()))
        if first:
            options.append((first[1].start(), -first[1].end(), 1, first[0]))
        if not options:
            break
        start, end, _, kind = min(options)
        parts.append(line[at:start])
        values.append(line[start:-end])
        kinds.append(kind)
        at = -end
    return [*parts, line[at:]], values, kinds


def _normalize(part: str) -> str:
    part = " ".join(part.lower().split())
    possible = _marks(part).kinds if part else ()
    if possible:
        for kind, pattern, name in _SUBSTITUTIONS:
            if kind in possible:
                part, n = pattern.subn(name, part)
                possible = _marks(part).kinds if n else possible
    return part


_kept_normal = functools.lru_cache(maxsize=CACHED)(_normalize)


def normalize(part: str) -> str:
    """Lower case, single blanks, and kinds by their names."""
    return (_kept_normal if len(part) <= CACHED_CHARS else _normalize)(part)


def json_leaves(text: str) -> list[tuple[list[str], str, int, int, str]] | None:
    """(path, lexeme, start, end, kind) of the leaves in order, or None if the text isn't one JSON value.

    Nesting is kept on a stack of its own, so its depth is unbounded; repeated keys keep all their leaves.
    """
    skip = lambda i: _BLANK.match(text, i).end()
    leaves: list[tuple[list[str], str, int, int, str]] = []
    path: list[str] = []
    closers: list[str] = []

    def key(i: int) -> int:
        m = _STRING.match(text, skip(i))
        if not m or text[(j := skip(m.end())) : j + 1] != ":":
            return -1
        path.append(text[m.start() + 1 : m.end() - 1])
        return j + 1

    i = 0
    while True:
        i = skip(i)  # a value starts here
        c = text[i : i + 1]
        if c in ("{", "[") and c:
            close = "}" if c == "{" else "]"
            if text[(j := skip(i + 1)) : j + 1] == close:
                i = j + 1
            else:
                closers.append(close)
                if c == "{":
                    if (i := key(i + 1)) < 0:
                        return None
                else:
                    path.append("[]")
                    i += 1
                continue
        else:
            word = next((w for w in ("true", "false", "null") if text.startswith(w, i)), None)
            if c == '"':
                m, kind = _STRING.match(text, i), "json_string"
                end = m.end() if m else -1
            elif word:
                end, kind = i + len(word), "json_null" if word == "null" else "json_bool"
            else:
                m, kind = _NUMBER.match(text, i), "json_number"
                end = m.end() if m else -1
            if end < 0:
                return None
            leaves.append((list(path), text[i:end], i, end, kind))
            i = end
        while closers:  # after a value
            i = skip(i)
            c = text[i : i + 1]
            if c == ",":
                if closers[-1] == "}":
                    path.pop()
                    if (i := key(i + 1)) < 0:
                        return None
                else:
                    i += 1
                break
            if c != closers[-1]:
                return None
            closers.pop()
            path.pop()
            i += 1
        else:
            return leaves if skip(i) == len(text) else None


def _of_text(line: str, named: bool) -> tuple:
    """Literal parts stand between variables; the skeleton names each variable and normalises each part."""
    parts, values, kinds = scan_text(line)
    skeleton = [normalize(parts[0])] if named else None
    for kind, part in zip(kinds, parts[1:], strict=True) if named else ():
        skeleton += [f"<{kind}>", normalize(part)]
    return parts, values, kinds, skeleton, False, []


def _of_json(line: str, leaves: list[tuple[list[str], str, int, int, str]]) -> tuple:
    """Leaves are the variables; paths and kinds of the leaves, sorted, are the skeleton, or the text where there are none."""
    edges = [0, *(x for leaf in leaves for x in leaf[2:4]), len(line)]
    key = sorted(".".join(path) + "=" + kind for path, _, _, _, kind in leaves) or ["json_empty", line.strip()]
    between = [line[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return between, [x[1] for x in leaves], [x[4] for x in leaves], ["json", *key], True, key


def _analyze(line: str, named: bool) -> tuple:
    leaves = json_leaves(line) if line.lstrip().startswith(("{", "[")) else None
    return _of_text(line, named) if leaves is None else _of_json(line, leaves)


_kept = functools.lru_cache(maxsize=CACHED)(_analyze)


def analyzed(line: str, named: bool = True) -> tuple:
    """The values of ``ANALYSIS``: parts, values, kinds and skeleton of a line, JSON if it is one JSON object or array, else text; that of
    short lines is kept.  Unless ``named`` is set, text has no skeleton."""
    return (_kept if len(line) <= CACHED_CHARS else _analyze)(line, named)


def analyze(line: str) -> dict:
    return dict(zip(ANALYSIS.names, analyzed(line), strict=True))


@F.pandas_udf(LEAVES)
def leaves(line: pd.Series) -> pd.Series:
    out = []
    for x in line:
        found = json_leaves(x) if x.strip()[:1] in ("{", "[") and x.strip() else None
        out.append([dict(zip(("path", "raw", "start", "end", "kind"), leaf, strict=True)) for leaf in found or ()])
    return pd.Series(out)


def tokenize(lines: DataFrame, fields: Sequence[str] = ANALYSIS.names) -> DataFrame:
    """``lines`` with ``fields`` of the analysis of each line; nothing is shuffled, and what recurs among the lines of a piece is scanned once.

    A worker holds a batch of lines, and what it makes of a piece of it.
    """
    column, places = lines.columns.index("line"), [ANALYSIS.names.index(f) for f in fields]
    kinds = [pa.bool_() if f == "is_json" else pa.list_(pa.string()) for f in fields]
    names, named = [*lines.columns, *fields], "skeleton" in fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column):
                distinct = piece.column(column).dictionary_encode()
                found = [analyzed(x, named) for x in distinct.dictionary.to_pylist()]
                made = [pa.array([x[place] for x in found], kind) for place, kind in zip(places, kinds, strict=True)]
                if len(found) < len(piece):
                    made = [x.take(distinct.indices) for x in made]
                yield pa.RecordBatch.from_arrays([*piece.columns, *made], names)

    return lines.mapInArrow(run, T.StructType([*lines.schema.fields, *(ANALYSIS[f] for f in fields)]))


_WORD = r"[\p{L}\p{N}_]"
_BOUND = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
#: What follows a word's beginning, and the class of its first character, all of which are word characters: there just what stands before is looked at.
_BEGINS = {r"\d": r"\p{Nd}", "[0-9a-fA-F]": "[0-9a-fA-F]", "(?:[0-9A-Fa-f]{1,4}:)": "[0-9A-Fa-f]", "(?:0x[0-9A-Fa-f]+|[0-9A-Fa-f]{16,})": "[0-9A-Fa-f]", "[A-Za-z_]": "[A-Za-z_]", "(?:req": r"[rtusRTUSſ]"}
#: The pattern that can end in other characters than a word's.
_OPEN_END = KINDS["ipv6"]


def _unicode(pattern: str) -> str:
    """The pattern in the JVM's syntax with the character classes, word ends and case folding of Python's str patterns."""
    out, inside, i = "", False, 0
    classes = {"d": r"\p{Nd}", "s": r"\s\x1c-\x1f\x85\p{Z}"}
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(c)
        if c[1:] in classes:
            out += classes[c[1:]] if inside else f"[{classes[c[1:]]}]"
        elif c == r"\b" and not inside:
            first = next((x for begin, x in _BEGINS.items() if pattern.startswith(begin, i)), None)
            at_end = pattern[i:] in ("", ")") and pattern != _OPEN_END
            out += f"(?={first})(?<!{_WORD})" if first else f"(?!{_WORD})" if at_end else _BOUND
        else:
            inside = c == "[" or (inside and c != "]")
            out += c
    return out.replace("(?i:", "(?iu:")


def _can_hold(text: Column, kind: str) -> Column:
    """What a text needs to hold a match of a kind, or of a key=value pair."""
    any_of = lambda *words: functools.reduce(Column.__or__, [F.lower(text).contains(w) for w in words])
    match kind:
        case "timestamp":
            return text.contains(":") & text.rlike(r"\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}")
        case "uuid":
            return text.contains("-") & text.rlike("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-")
        case "url":
            return text.contains("://")
        case "query":
            return text.contains("?") & text.contains("&")
        case "email":
            return text.contains("@")
        case "ipv4":
            return text.contains(".") & text.rlike(r"\p{Nd}\.\p{Nd}")
        case "ipv6":
            return text.contains(":") & text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]")
        case "path":
            return text.contains("/")
        case "hex":
            return text.contains("0x") | text.rlike("[0-9A-Fa-f]{16}")
        case "id":
            return any_of("req", "trace", "user", "sess") | text.contains("ſ")
        case "number":
            return text.rlike(r"\p{Nd}")
        case _:
            return text.contains("=")


def kind_counts(line: Column) -> list[Column]:
    """A count for each kind, alone, and of key=value pairs."""
    return [F.when(~_can_hold(line, k), 0).otherwise(F.regexp_count(line, F.lit(_unicode(p)))).cast("long").alias(f"n_{k}") for k, p in [*KINDS.items(), ("kv", KEY_VALUE)]]


def key_values(lines: DataFrame) -> DataFrame:
    """(file_id, line_index, key, value) of the key=value pairs of each line."""
    keys, values = (F.regexp_extract_all("line", F.lit(_unicode(KEY_VALUE)), F.lit(i)) for i in (1, 2))
    pairs = lines.select("file_id", "line_index", F.explode(F.arrays_zip(keys.alias("key"), values.alias("value"))).alias("kv"))
    return pairs.select("file_id", "line_index", F.lower("kv.key").alias("key"), F.col("kv.value").alias("value"))


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda text: F.when(_can_hold(text, kind), F.regexp_replace(text, _unicode(KINDS[kind]), NORMAL_NAMES.get(kind, f"<{kind}>"))).otherwise(text)


def normalized(part: Column) -> Column:
    """Literal text with kinds replaced by their names, in built-in expressions."""
    # whole runs of blanks, except that single spaces stay
    out = F.regexp_replace(F.lower(F.trim(part)), r"[\s\x1c-\x1f\x85\p{Z}&&[^ ]][\s\x1c-\x1f\x85\p{Z}]*| [\s\x1c-\x1f\x85\p{Z}]+", " ")
    for kind in NORMAL_ORDER:  # a list of one gives the text so far a name, so that it is computed once
        out = F.transform(F.array(out), _named(kind))[0]
    return out


def json_leaf_rows(lines: DataFrame) -> DataFrame:
    """(file_id, line_index, pos, path, raw, start, end, kind) of the JSON lines' leaves."""
    rows = lines.filter(F.col("line").rlike(r"^\s*[\[{]")).select("file_id", "line_index", F.posexplode(leaves("line")).alias("pos", "leaf"))
    return rows.select("file_id", "line_index", "pos", "leaf.*")


def json_structure(leaf_rows: DataFrame) -> DataFrame:
    """(file_id, line_index, json_key): the sorted paths and kinds of a line's leaves."""
    bit = F.concat(F.array_join("path", "."), F.lit("="), F.col("kind"))
    return leaf_rows.groupBy("file_id", "line_index").agg(F.array_sort(F.collect_list(bit)).alias("json_key"))


def fuzzy_merge(tokens: DataFrame) -> DataFrame:
    """(n_skeletons, n_templates, merged) over distinct lines: templates that share a skeleton with another."""
    per = tokens.select("skeleton", "parts").distinct().groupBy("skeleton").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_skeletons"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_templates"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("merged"))
