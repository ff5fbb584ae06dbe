"""Secret scan by assignment-aware lexing.

Three base patterns find token-shaped strings. Beside them the text is lexed as source or configuration, and parsed into name-literal pairs: ``name = value``, ``name := value``, ``name: value``,
``name: type = value``, quoted keys (JSON, YAML, maps, subscripts), ``set("name", value)``, ``setName("value")``, XML elements and ``key``/``value`` attributes. A value is a string
(with prefixes, triple quotes or backquotes, adjacent ones and those joined by ``+`` put together, also over lines that end in a backslash), the string arguments of a call, alternatives after ``or``, ``||`` and ``??`` or of ``? :``, a bare word of a
configuration line, a block of indented lines (YAML), or the name of a constant. Constants may be defined before or after their use, through chains: a name takes the literals of the definition that last stands before it, else of the first after it.
An identifier is never a literal: a call's or a dotted path's name marks nothing, and what a getter is asked for is a name. Literals are scored by how
sensitive the target name is and how much they look like a value someone generated. A literal that scores enough is a span of kind ``literal``.

Spans are code points, end exclusive, over the whole text; per kind leftmost and without overlap (of literals that begin together the longest). Null text is empty: no
spans. Null ids keep their rows, repeated rows get equal results, extra columns, whatever their names, are ignored. A text is lexed whole by one task, in time that
grows with its length: brackets and their strings are found in one pass, and what a definition holds is worked out once.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column, tidy

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that have 32 characters or more
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
#: Sensitivity of the words of a target name.
NAME_WEIGHT = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "key": 0.5, "private": 0.5, "access": 0.4, "api": 0.3, "bearer": 0.7, "signature": 0.4}
#: Names that are sensitive as a whole, however they are joined.
KEY_NAMES = ("apikey", "accesskey", "privatekey", "secretkey", "signingkey", "authtoken", "accesstoken")
LEAST_SCORE, LEAST_LITERAL = 0.8, 8
_WORDS = r"[A-Za-z_$][\w$]*+(?:[.\-][\w$]++)*+"
#: A name and what makes it the target of a value.
_SITE = re.compile(rf"""(?<![\w$.\-])(?:({_WORDS})[ \t]*(?::=|=>|=(?![=~])|:(?![:/])|(\()(?=[ \t]*["'`]))|(["'`])({_WORDS})\3[ \t]*(?:\][ \t]*)?(?::=|=>|=(?!=)|:(?!:)|,))""", re.ASCII)
_TYPE = re.compile(r"[ \t]*[A-Za-z_][\w.]*+(?:\[[^\[\]\n]*+\]|<[^<>\n]*+>)?\??[ \t]*=(?!=)", re.ASCII)
_STRING = re.compile(
    r"[rRbBuUfF]{0,2}(?:"
    r'"""((?:[^"\\]|\\.|"(?!""))*+)"""|' + r"\'\'\'((?:[^'\\]|\\.|'(?!''))*+)\'\'\'|"
    r'"((?:[^"\\\n]|\\[^\n])*+)"|' + r"'((?:[^'\\\n]|\\[^\n])*+)'|`((?:[^`\\]|\\.)*+)`)",
    re.DOTALL,
)
#: What ends a bare word; where, within one, another assignment begins, as in the query of an address.
_STOP, _NESTED = re.compile(r"""[\s"'`,;(){}\[\]<>]"""), re.compile(r"[&?|](?=[A-Za-z_$][\w$.\-]*+=)", re.ASCII)
_GAP = re.compile(r"(?:[ \t]|\\\r?\n)*+")  # lines that end in a backslash go on
_JOIN, _OTHERWISE = re.compile(r"[ \t]*\+[ \t]*"), re.compile(r"[ \t]*(?:\|\||\?\?|or\b)[ \t]*")
_CHOICE, _ELSE, _IF_ELSE = re.compile(r"[ \t]*\?(?![?.:])"), re.compile(r"[ \t]*:(?!:)"), re.compile(r"[ \t]+if[ \t]+(?:not[ \t]+)?[\w.]++[ \t]+else\b", re.ASCII)
_BLOCK, _LINE = re.compile(r"[ \t]*[|>][-+0-9]*[ \t]*\r?\n"), re.compile(r"([ \t]*)([^\n]*)(?:\n|\Z)")
_NAME = re.compile(r"[A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)*+", re.ASCII)
_CALL = re.compile(r"(?<![\w$])[\w$]++[ \t]*+\(", re.ASCII)
_INSIDE = re.compile(r"""(?<![\w$])[\w$]++[ \t]*+\(|[()\[\]{},"'`]|\n[ \t\r]*+\n""", re.ASCII)
_GETTER = re.compile(r"(?i)get|env|lookup|fetch|read|load|find|config|property")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*+)(?:\s[^<>]*+)?>\s*([^<>\s]++)\s*</\1>", re.ASCII)
_ATTRIBUTES = re.compile(r"""\b(?:name|key|id)\s*=\s*(["'])([\w.\-]++)\1\s+value\s*=\s*(["'])([^"'\n]*+)\3""", re.ASCII)
_PLACEHOLDER = re.compile(r"(?i)x{4,}|\*{3,}|change.?me|example|placeholder|your[_-]|<[^<>]*>|\$\{|%\(|redacted|\A(none|null|true|false|undefined)\Z")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def sensitivity(name: str) -> float:
    """Of a target name, from the words in it: the strongest, and a part of the others."""
    if any(k in re.sub("[^a-z]", "", name.lower()) for k in KEY_NAMES):
        return 1.0
    weights = sorted((NAME_WEIGHT.get(w.lower(), 0.0) for w in _WORD.findall(name)), reverse=True)
    return weights[0] + 0.6 * sum(weights[1:3]) if weights else 0.0


def likeness(literal: str) -> float:
    """0 to 1: how much a literal looks like a generated value rather than a word or a placeholder."""
    if len(literal) < LEAST_LITERAL or " " in literal or _PLACEHOLDER.search(literal):
        return 0.0
    return likeness_of(Counter(literal))


def likeness_of(letters: Counter) -> float:
    """The same of how often each character stands in a literal."""
    n = letters.total()
    if n < LEAST_LITERAL or " " in letters:
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in letters.values())
    classes = sum(any(f(c) for c in letters) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in letters)
    return min(1.0, bits / 3.5) * min(1.0, 0.4 + 0.3 * classes)


#: A part of a value: the span of a literal, the name of a constant, or the number of a call.
Part = tuple[int, int] | str | int


class Calls:
    """Brackets within calls, each with the one around it, and the strings between them, in one pass over a text. A blank line ends a call that is still open."""

    def __init__(self, text: str):
        self.opened: dict[int, int] = {}  # by the place of its parenthesis
        self.around: list[int] = []
        self.ends: list[int] = []
        self.getter: list[bool] = []
        self.strings: list[tuple[int, int, int, int]] = []  # start, end, innermost bracket, argument in it
        stack: list[list[int]] = []
        at = 0
        while m := (_INSIDE if stack else _CALL).search(text, at):
            at, c = m.end(), text[m.end() - 1]
            if c in "([{":
                self.opened[at - 1] = len(self.around)
                self.around.append(stack[-1][0] if stack else -1)
                self.ends.append(len(text))
                self.getter.append(bool(_GETTER.search(m[0])))
                stack.append([len(self.around) - 1, 0])
            elif c in ")]}":
                self.ends[stack.pop()[0]] = at
            elif c == ",":
                stack[-1][1] += 1
            elif c == "\n":
                for n, _ in stack:
                    self.ends[n] = m.start()
                stack.clear()
                at = m.start() + 1
            elif s := _STRING.match(text, m.start()):
                self.strings.append((*s.span(s.lastindex), *stack[-1]))
                at = s.end()


class Lexer:
    """The name-literal pairs of a text. What lies ahead of a place (the end of a bare word, the end of a call) is found once, however many places ask."""

    def __init__(self, text: str):
        self.text, self.calls = text, Calls(text)
        self._bare = self._nested = (1, 0)

    def _ahead(self, known: tuple[int, int], what: re.Pattern, at: int) -> tuple[int, int]:
        if not known[0] <= at <= known[1]:
            m = what.search(self.text, at)
            known = (at, m.start() if m else len(self.text))
        return known

    def values(self, at: int) -> tuple[list[list[Part]], int]:
        """The values that may stand at ``at``, each a list of parts that belong together, and where they end."""
        text, out, choice = self.text, [], False
        while True:
            parts: list[Part] = []
            while True:
                at = _GAP.match(text, at).end()
                if m := _STRING.match(text, at):
                    parts.append(m.span(m.lastindex))
                    at = m.end()
                    follows = _GAP.match(text, at).end()
                    if follows < len(text) and text[follows] in "\"'" and follows > at:
                        continue  # adjacent strings
                else:
                    self._bare = self._ahead(self._bare, _STOP, at)
                    end = self._bare[1]
                    name = _NAME.match(text, at, end)
                    whole = name.end() if name else at
                    if end > at and text[end - 1] == "+" and whole == end - 1 and text[end : end + 1] in ("'", '"'):
                        end -= 1
                    if text[end : end + 1] == "(" and end > at and end in self.calls.opened:
                        call = self.calls.opened[end]
                        parts.append(call)
                        at = self.calls.ends[call]
                    elif text[end : end + 1] == "[" and whole == end > at:
                        at = end
                    elif whole == end > at:
                        parts.append(name[0])
                        at = end
                    elif end > at and not parts:  # a bare literal stands alone
                        self._nested = self._ahead(self._nested, _NESTED, at)
                        end = min(end, max(self._nested[1], at + 1))
                        return [*out, [(at, end)]], end
                if not (m := _JOIN.match(text, at)):
                    break
                at = m.end()
            if m := _CHOICE.match(text, at):
                choice = True  # and what stood before is the condition
            else:
                if parts:
                    out.append(parts)
                if choice and (m := _ELSE.match(text, at)):
                    choice = False
                elif not (m := _OTHERWISE.match(text, at) or _IF_ELSE.match(text, at)):
                    return out, at
            at = m.end()

    def _block(self, begin: int, key: int) -> tuple[list[list[Part]], int] | None:
        """The lines of a block of YAML, which are indented more than their key's."""
        if not (m := _BLOCK.match(self.text, begin)):
            return None
        line = self.text.rfind("\n", 0, key) + 1
        indent, at, parts = len(_LINE.match(self.text, line)[1]), m.end(), []
        while at < len(self.text) and (m := _LINE.match(self.text, at)) and (len(m[1]) > indent or not m[2].strip()):
            if word := m[2].rstrip():
                parts.append((m.start(2), m.start(2) + len(word)))
            at = m.end()
        return [parts], at

    def pairs(self) -> list[tuple[str, int, list[list[Part]], tuple[int, int] | None]]:
        """(name, place, values, span of the value if it is one bare word) of each name that is given a value."""
        text, out, at = self.text, [], 0
        while m := _SITE.search(text, at):
            name, begin, bare = m[1] or m[4], m.end(), None
            at = begin
            if m[2]:  # a call by a telling name
                values = [[self.calls.opened[begin - 1]]] if begin - 1 in self.calls.opened else []
            elif text[begin - 1] == ":" and sensitivity(name) and (block := self._block(begin, m.start())):
                values, at = block
            else:
                if text[begin - 1] == ":" and (t := _TYPE.match(text, begin)):
                    begin = at = t.end()
                values, end = self.values(begin)
                start = _GAP.match(text, begin).end()
                literal = values and all(isinstance(p, tuple) for v in values for p in v)
                if literal and end > at and (text[start : start + 1] in ("'", '"', "`") or sensitivity(name)):
                    at = end  # nothing is assigned within strings, nor within a sensitive name's value
                elif len(values) == 1 and len(values[0]) == 1 and isinstance(values[0][0], str):
                    bare = (start, start + len(values[0][0]))
            out.append((name, m.start(), values, bare))
        if "</" in text:
            out += [(m[1], m.start(), [[m.span(2)]], None) for m in _ELEMENT.finditer(text)]
        if "value" in text:
            out += [(m[2], m.start(), [[m.span(4)]], None) for m in _ATTRIBUTES.finditer(text)]
        return out


class Definitions:
    """What each name is given, resolved once a definition."""

    def __init__(self, text: str, given: list[tuple]):
        self.text, self.given = text, given
        self.named: dict[str, list[tuple[int, int]]] = {}
        for k in sorted(range(len(given)), key=lambda k: given[k][1]):
            for known in {given[k][0], given[k][0].rpartition(".")[2]}:
                self.named.setdefault(known, []).append((given[k][1], k))
        self._counts: dict[int, Counter] = {}

    def of(self, name: str, here: int) -> int | None:
        """The definition of ``name`` that last stands before ``here``, else the first."""
        known = self.named.get(name) or self.named.get(name.rpartition(".")[2])
        return known[max(bisect_left(known, here, key=lambda d: d[0]) - 1, 0)][1] if known else None

    def joined(self, k: int) -> list[Part]:
        """The parts that stand for a name within a longer value: the first value's."""
        return next((v for v in self.given[k][2] if v), [])

    def letters(self, parts: list[Part], here: int) -> Counter:
        """How often each character stands in parts put together, constants replaced; names within their own definition count nothing."""
        todo: list[tuple[int, bool]] = [(d, False) for p in parts if isinstance(p, str) and (d := self.of(p, here)) is not None]
        busy: set[int] = set()
        while todo:
            k, ready = todo.pop()
            if k in self._counts or (k in busy and not ready):
                continue
            mine, place = self.joined(k), self.given[k][1]
            if ready:
                self._counts[k] = self._sum(mine, place)
            else:
                busy.add(k)
                todo.append((k, True))
                todo += [(d, False) for p in mine if isinstance(p, str) and (d := self.of(p, place)) is not None]
        return self._sum(parts, here)

    def _sum(self, parts: list[Part], here: int) -> Counter:
        out: Counter = Counter()
        for p in parts:
            if isinstance(p, tuple):
                piece = self.text[p[0] : p[1]]
                out.update(piece if not _PLACEHOLDER.search(piece) else piece + " ")  # a space makes it no literal
            elif isinstance(p, str) and (d := self.of(p, here)) is not None:
                out.update(self._counts.get(d, {}))
        return out


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the literals, at their definitions, that reach sensitive names."""
    lexer = Lexer(text)
    given, calls = lexer.pairs(), lexer.calls
    known = Definitions(text, given)
    found: set[tuple[int, int]] = set()
    weight_of = [0.0] * len(calls.around)
    seen: set[int] = set()
    whole: set[int] = set()

    def take(parts: list[Part], here: int, weight: float) -> None:
        """All of a value that is put together from parts."""
        todo = [(parts, here)]
        while todo:
            parts, here = todo.pop()
            for p in parts:
                if isinstance(p, tuple):
                    found.add(p)
                elif isinstance(p, int):
                    weight_of[p] = max(weight_of[p], weight)
                elif (d := known.of(p, here)) is not None and d not in whole:
                    whole.add(d)
                    todo.append((known.joined(d), given[d][1]))

    # the most sensitive names first, so that a definition need be followed only once
    for weight, k in sorted(((w, k) for k, g in enumerate(given) if (w := sensitivity(g[0]))), key=lambda x: (-x[0], x[1])):
        todo = [k]
        while todo:
            name, place, values, bare = given[todo.pop()]
            for parts in values:
                if len(parts) == 1 and isinstance(parts[0], str):
                    if (d := known.of(parts[0], place)) is not None:
                        if d not in seen:
                            seen.add(d)
                            todo.append(d)
                        continue
                    if bare and "." not in parts[0] and _ends_line(text, bare[1]) and sensitivity(name):
                        parts = [bare]  # a bare word of a configuration, not a constant's name
                if len(parts) == 1 and isinstance(parts[0], int):
                    weight_of[parts[0]] = max(weight_of[parts[0]], weight)
                elif all(isinstance(p, tuple) for p in parts):
                    if weight * likeness("".join(text[s:e] for s, e in parts)) >= LEAST_SCORE:
                        found.update(parts)
                elif weight * likeness_of(known.letters(parts, place)) >= LEAST_SCORE:
                    take(parts, place, weight)
    for n, outer in enumerate(calls.around):  # a bracket stands after the one around it
        if outer >= 0:
            weight_of[n] = max(weight_of[n], weight_of[outer])
    for s, e, n, argument in calls.strings:
        if weight_of[n] and not (argument == 0 and calls.getter[n]) and weight_of[n] * likeness(text[s:e]) >= LEAST_SCORE:
            found.add((s, e))
    out: list[tuple[int, int]] = []
    for s, e in sorted((x for x in found if x[1] > x[0]), key=lambda x: (x[0], -x[1])):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


def _ends_line(text: str, at: int) -> bool:
    """Whether nothing of an expression follows: white space, a separator or a comment."""
    return at >= len(text) or text[at] in " \t\r\n,}]#"


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as in KINDS."""
    spans: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += [(s, 3, e) for s, e in literal_spans(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(spans)]


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, spans array<struct<kind,start,stop,value>>), value the text found."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string())]))
        for b in it:
            out = []
            for t in b.column(1):
                text = t.as_py()
                out.append([{"kind": k, "start": s, "stop": e, "value": text[s:e]} for k, s, e in scan(text)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["id", "spans"])

    schema = "id long, spans array<struct<kind string, start long, stop long, value string>>"
    return docs.select(F.col(id_col).cast("long").alias("id"), text_column(docs, text_col).alias("t")).mapInArrow(run, schema)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
