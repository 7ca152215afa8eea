"""Secret scanning: three fixed patterns, and assignments that are read as source or configuration.

The lexer goes from mark to mark: assignment signs, calls, flags, tags, quotes and comments.  It knows whether it
is in code, in a string or in a comment; names of one of them don't mean those of another.  An assignment is

    name = value   name: type = value   "name": value   x["name"] => value   --name value   <name>value</name>
    setName(value)   f("name", value)

and a value is a sum or a choice of strings (also tripled ones and neighbours), bare words, names, calls with literal
arguments, here-documents and block scalars.  Literals are constants of their names; a name on the right
stands for the constant that it had last, so that a literal is also scored by the names that it flows to.  A literal is a
secret if the most sensitive of those names and the literal's own look together reach `LEAST`.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds; letters of the first in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

#: Fixed weights: how sensitive a part of a name is.
PARTS = {
    "password": 4.0, "passwd": 4.0, "passphrase": 4.0, "pwd": 4.0, "pass": 2.5, "secret": 4.0, "token": 4.0, "apikey": 4.0, "credential": 3.5, "credentials": 3.5,
    "auth": 2.5, "authorization": 3.0, "bearer": 3.5, "private": 1.5, "access": 1.0, "api": 1.5, "key": 2.0, "signature": 2.0, "salt": 2.0, "session": 1.0, "cookie": 1.5, "dsn": 2.0,
    "public": -2.5, "example": -2.0, "dummy": -3.0, "sample": -2.0, "length": -3.0, "len": -3.0, "count": -3.0, "url": -2.0, "path": -2.0, "file": -2.0, "name": -2.0, "type": -2.0, "format": -3.0,
}
#: The sum of a name's and a literal's score from which on it is a secret.
LEAST = 5.0

#: Words before a credential in a header.
SCHEMES = {"bearer", "basic", "token", "digest"}

_MARK = re.compile(r""":=|=>|==+|!=|<=|>=|[=:](?!//)|(?<=[A-Za-z0-9_])\(|(?<![^\s"'`(\[,=])--?(?=[A-Za-z])|<(?=[A-Za-z])|<!--|/\*|(?<!\S)(?:\#|//)|(?<![A-Za-z0-9])["'`]""")
_BEFORE = re.compile(r"[A-Za-z0-9_.\-]")
_GAP = re.compile(r"(?:[ \t]|\\\r?\n)*")
_STRING = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`""")
_BARE = re.compile(r"""[A-Za-z0-9+/_.-]+(?:={1,2}(?![A-Za-z0-9"'=]))?""")
_JOIN = re.compile(r"(?:[ \t]|\\\r?\n)*(?:\+|\|\||\?\?|\bor\b)\s*")
_NEXT = re.compile(r"""\s*(?=["'])""")
_BLOCK = re.compile(r"[|>][+-]?[ \t]*\r?\n")
_HERE = re.compile(r"""<<[-~]?[ \t]*["']?([A-Za-z_]\w*)["']?[^\n]*\n""")
_FLAG = re.compile(r"--?([A-Za-z][\w-]*)[ \t]+(?!-)")
_TAG = re.compile(r"<([A-Za-z][\w.:-]*)(?:[ \t][^<>\n]*)?>([^<>\n]*)</([A-Za-z][\w.:-]*)>")
_TYPE = re.compile(r"[ \t]*[A-Za-z_][\w.<>\[\]| ]*")
_ARGUMENT = re.compile(_STRING.pattern + r"|[()]|\n[ \t]*\n")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Without any of the parts that speak for a secret no literal can be one; for Arrow, which searches whole columns.
_SENSITIVE = "(?i)" + "|".join(x for x, score in PARTS.items() if score > 0)
_HOLLOW = re.compile(r"(?i)x{4,}|\*{3,}|<[^<>]*>|\$\{[^{}]*\}|%\([^()]*\)|change.?me|placeholder|your[_-]|none|null|true|false")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans, in code points."""
    spans = []
    if "=" in text or ":" in text:
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return spans + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def name_score(name: str) -> float:
    """How much a name says that its value is secret: its strongest part, and what speaks against it."""
    parts = [x.lower() for x in _WORDS.findall(name)]
    scores = [PARTS.get(x, 0.0) for x in parts] + [PARTS.get(a + b, 0.0) for a, b in zip(parts, parts[1:], strict=False)]
    good = sorted((x for x in scores if x > 0), reverse=True)
    return (good[0] + 0.5 * sum(good[1:]) if good else 0.0) + sum(x for x in scores if x < 0)


def literal_score(value: str) -> float:
    """How much a literal looks made by a machine or as a password."""
    if len(value) < 6 or _HOLLOW.search(value) or any(x.isspace() for x in value):
        return -9.0
    n = len(value)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    mixed = any(x.isdigit() for x in value) and any(x.isalpha() for x in value)
    return (1.0 if mixed else -1.0) + (1.0 if bits >= 3 else 0.0) + (1.0 if n >= 12 else 0.0) + (0.5 if any(not x.isalnum() for x in value) else 0.0)


def _arguments(text: str) -> dict[int, tuple[list[tuple[int, int]], int]]:
    """By the place of an opening parenthesis the strings that stand right in it and where it closes, in one pass; an empty line ends all that are open."""
    found: dict[int, tuple[list[tuple[int, int]], int]] = {}
    open_: list[tuple[int, list[tuple[int, int]]]] = []
    for m in _ARGUMENT.finditer(text):
        if m.lastindex:
            if open_:
                open_[-1][1].append(m.span(m.lastindex))
        elif m[0] == "(":
            open_.append((m.start(), []))
        elif m[0] == ")":
            if open_:
                at, strings = open_.pop()
                found[at] = strings, m.end()
        else:
            open_.clear()
    return found


class Lexer:
    """One text's assignments: names, the spans of their own literals, and the earlier assignments that they take from."""

    def __init__(self, text: str):
        self.text = text
        self.scores: list[float] = []
        self.spans: list[list[tuple[int, int]]] = []
        self.sources: list[list[int]] = []
        self.latest: dict[tuple[str, str], int] = {}
        self.state, self.until = "code", 0
        self.missing: dict[str, int] = {}  # closings that do not occur any more before a place
        self.calls = _arguments(text) if "(" in text else {}
        self.lined = 0  # up to here lines were read as a block

    def find(self, what: str, at: int) -> int:
        """As text.find; what was not found once is not looked for again."""
        if what in self.missing:
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.missing[what] = at
        return found

    def assign(self, name: str, own: list[tuple[int, int]], taken: list[int]) -> None:
        if name and (own or taken):
            self.latest[self.state, name] = len(self.scores)
            self.scores.append(name_score(name))
            self.spans.append(own)
            self.sources.append(taken)

    def name_before(self, at: int, floor: int) -> str:
        text = self.text
        while at > floor and text[at - 1] == " ":
            at -= 1
        while at > floor and text[at - 1] in "\"'])":
            at -= 1
        end = at
        while at > floor and _BEFORE.match(text[at - 1]):
            at -= 1
        return text[at:end]

    def lines(self, at: int, ends) -> list[tuple[int, int]]:
        """Spans of the lines from `at` on, without blanks around them, up to the first for which `ends`."""
        out = []
        while at < len(self.text):
            end = self.text.find("\n", at)
            end = len(self.text) if end < 0 else end
            line = self.text[at:end]
            if ends(line):
                break
            a = at + len(line) - len(line.lstrip())
            out.append((a, max(a, at + len(line.rstrip()))))
            at = end + 1
        self.lined = at
        return out

    def one(self, at: int, own: list, taken: list) -> tuple[int, bool]:
        """Reads one part of a value at `at`; gives its end, or -1, and whether it was a string."""
        text = self.text
        for quote in ('"""', "'''"):
            if text.startswith(quote, at) and (end := self.find(quote, at + 3)) >= 0:
                own.append((at + 3, end))
                return end + 3, True
        if value := _STRING.match(text, at):
            own.append(value.span(value.lastindex))
            return value.end(), True
        if at >= self.lined and (block := _BLOCK.match(text, at)):
            line = text.rfind("\n", 0, at) + 1
            depth = len(text[line:at]) - len(text[line:at].lstrip(" "))
            own += self.lines(block.end(), lambda x: not x.strip() or len(x) - len(x.lstrip(" ")) <= depth)
            return block.end(), False
        if at >= self.lined and (here := _HERE.match(text, at)):
            own += self.lines(here.end(), lambda x: x.strip() == here[1])
            return here.end(), False
        value = _BARE.match(text, at)
        if value and value[0].lower() in SCHEMES and text[value.end() : value.end() + 1] == " ":
            value = _BARE.match(text, value.end() + 1) or value
        if not value:
            return -1, False
        if call := self.calls.get(value.end()):
            own += call[0]
            return call[1], False
        if (self.state, value[0]) in self.latest:
            taken.append(self.latest[self.state, value[0]])
        else:
            own.append(value.span())
        return value.end(), False

    def value(self, at: int) -> tuple[list[tuple[int, int]], list[int], int]:
        """(own literals, assignments taken from, end) of the sum or choice that begins at `at`."""
        own: list[tuple[int, int]] = []
        taken: list[int] = []
        end = at
        while True:
            at, string = self.one(_GAP.match(self.text, at).end(), own, taken)
            if at < 0:
                return own, taken, end
            end = at
            if string and (near := _NEXT.match(self.text, at)):
                at = near.end()
            elif join := _JOIN.match(self.text, at):
                at = join.end()
            else:
                return own, taken, end

    def enter(self, mark: str, at: int) -> int:
        """Goes into a comment or string that begins at `at`, unless it is in one; gives where to go on."""
        text, after = self.text, at + len(mark)
        if self.state != "code":
            return after
        if mark in ("#", "//"):
            self.state, self.until = "comment", text.find("\n", at)
            if self.until < 0:
                self.until = len(text)
        elif mark in ("/*", "<!--"):
            end = self.find("*/" if mark == "/*" else "-->", after)
            if end >= 0:
                self.state, self.until = "comment", end
        elif at >= self.missing.get(mark, 0):
            if string := _STRING.match(text, at):
                self.state, self.until = "string", string.end()
            else:  # then all such quotes of the line are escaped
                end = text.find("\n", at)
                self.missing[mark] = len(text) if end < 0 else end
        return after

    def read(self) -> None:
        text, floor, at = self.text, 0, 0
        typed = ("", 0)
        while mark := _MARK.search(text, at):
            what, start, at = mark[0], mark.start(), mark.end()
            if start >= self.until:
                self.state = "code"
            if what in ("=", ":", ":=", "=>"):
                name = self.name_before(start, floor)
                if what == "=" and typed[0] and _TYPE.fullmatch(text, typed[1], start):
                    name = typed[0]
                typed = (name, at) if what == ":" else ("", 0)
                floor = at
                own, taken, _ = self.value(at)
                self.assign(name, own, taken)
            elif what == "(":
                strings = self.calls.get(start, ((), 0))[0]
                self.assign(self.name_before(start, floor), list(strings), [])
                for (a, b), value in zip(strings, strings[1:], strict=False):
                    if text[b + 1 : value[0] - 1].strip() == ",":
                        self.assign(text[a:b], [value], [])
            elif what[0] == "-":
                if flag := _FLAG.match(text, start):
                    self.assign(flag[1], *self.value(flag.end())[:2])
            elif what == "<":
                if (tag := _TAG.match(text, start)) and tag[1] == tag[3]:
                    a, b = tag.span(2)
                    self.assign(tag[1], [(a + len(tag[2]) - len(tag[2].lstrip()), b - len(tag[2]) + len(tag[2].rstrip()))], [])
            elif what[0] not in "=!<>" or what == "<!--":
                at = self.enter(what, start)

    def found(self) -> list[tuple[int, int]]:
        """The literals that are secrets; one that stands in another is left out."""
        for k in range(len(self.scores) - 1, -1, -1):
            for source in self.sources[k]:
                self.scores[source] = max(self.scores[source], self.scores[k])
        chosen = set()
        for own, score in zip(self.spans, self.scores, strict=True):
            if score > 0 and own:
                whole = literal_score("".join(self.text[a:b] for a, b in own)) if len(own) > 1 else -9.0
                chosen.update((a, b) for a, b in own if score + max(literal_score(self.text[a:b]), whole if 4 <= b - a < 12 else -9.0) >= LEAST)
        out, reach = [], -1
        for a, b in sorted(chosen, key=lambda x: (x[0], -x[1])):
            if b > reach:
                out.append((a, b))
                reach = b
        return out


def literal_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the literals that flow into sensitive names."""
    lexer = Lexer(text)
    lexer.read()
    return [("literal", a, b) for a, b in lexer.found()]


def spans_of(text: str | None, sensitive: bool = True) -> list[tuple[str, int, int]]:
    """All spans by start, then kind: the base ones, and literals that no base span holds; without `sensitive` names only the base ones."""
    if not text:
        return []
    spans = base_spans(text)
    if sensitive:
        starts = sorted(a for _, a, _ in spans)
        reach = list(accumulate((b for _, _, b in sorted(spans, key=lambda x: x[1])), max))
        for kind, a, b in literal_spans(text):
            k = bisect_right(starts, a)
            if not k or reach[k - 1] < b:
                spans.append((kind, a, b))
    return sorted(set(spans), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _sensitive(texts: pa.Array) -> list[bool]:
    return pc.match_substring_regex(texts, _SENSITIVE).fill_null(False).to_pylist()


def _scanned(batches):
    for batch in batches:
        texts = batch.column(1)
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(x, y)] for x, y in zip(texts.to_pylist(), _sensitive(texts), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW)], ["doc_id", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of `docs` (doc_id, text, ...): array of (kind, start, end), by start, then kind.

    Kinds: assign, access and hex are the fixed patterns; literal is what the lexer adds.  Offsets
    are code points, the end exclusive.  Null and empty texts have no spans.  Rows may
    repeat and doc_id may be null; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scanned, f"doc_id long, spans {_SPANS}")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digests(spans: DataFrame) -> DataFrame:
    """Counts by base kind, the base spans' sha256 and all spans as text, from secret_spans()."""
    base = F.filter("spans", lambda x: x["kind"] != "literal")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted_text(text: str | None, sensitive: bool = True, mark: str = "[secret]") -> str | None:
    """`text` with `mark` for each secret, overlapping ones together."""
    spans = spans_of(text, sensitive)
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        _, a, b = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < b:
            k += 1
            b = max(b, spans[k][2])
        out += [text[at:a], mark]
        at, k = b, k + 1
    return "".join(out) + text[at:]


def _redacted(batches):
    for batch in batches:
        k = batch.schema.get_field_index("text")
        yield batch.set_column(k, "text", pa.array([redacted_text(x, y) for x, y in zip(batch.column(k).to_pylist(), _sensitive(batch.column(k)), strict=True)], pa.string()))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with its texts' secrets replaced, all columns as they were; texts without secrets stay as they are."""
    return docs.mapInArrow(_redacted, docs.schema)
