"""Readers of Turtle and RDF/XML documents. Files of Turtle are cut (:mod:`turtle`); RDF/XML, and files of unknown syntax, are read a whole file a task."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = {"nt": "nt", "ttl": "turtle", "turtle": "turtle", "rdf": "xml", "owl": "xml", "xml": "xml"}
RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
SCHEMA = "s string, p string, o string, o_kind string, o_lang string, o_dtype string, s_kind string, p_local string"
#: subject, its kind, predicate, object, its kind, language, type
Triple = tuple[str, str, str, str, str, str, str]

_TOKEN = re.compile(
    r"""(?s)(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<lang>@[A-Za-z][A-Za-z0-9-]*)|(?P<type>\^\^)|(?P<number>[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)|\d*\.\d+|\d+)(?![\w:]))|(?P<blank>_:[\w.-]*\w)|(?P<name>(?:\w[\w.-]*)?:(?:[\w:%.-]*[\w:%-])?|[A-Za-z]\w*)|(?P<mark>[.;,\[\]()])""",
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
_LETTERS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _plain(x: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _LETTERS.get(m[1], m[1]), x)


class _Turtle:
    """A recursive-descent reader of one document or statement; raises ValueError where it is not Turtle."""

    def __init__(self, text: str, prefixes: dict[str, str] | None = None, base: str = "", stem: str = "t"):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not Turtle at {at}: {text[at : at + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.base, self.stem, self.fresh, self.out = 0, dict(prefixes or {}), base, stem, 0, []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or (value is not None and token[1] != value):
            raise ValueError(f"expected {value or 'more'}, found {token[1]!r}")
        self.at += 1
        return token

    def iri(self, x: str) -> str:
        x = _plain(x[1:-1])
        return x if re.match(r"[A-Za-z][\w+.-]*:", x) or not self.base else self.base + x

    def node(self) -> tuple[str, str, str, str]:
        """(value, kind, language, type) of the term that stands next."""
        kind, x = self.take()
        if kind == "iri":
            return self.iri(x), "iri", "", ""
        if kind == "blank":
            return x, "bnode", "", ""
        if kind in ("string", "long"):
            body = _plain(x[3:-3] if kind == "long" else x[1:-1])
            if self.peek()[0] == "lang":
                return body, "lit", self.take()[1][1:], ""
            if self.peek()[0] == "type":
                self.take()
                return body, "lit", "", self.node()[0]
            return body, "lit", "", ""
        if kind == "number":
            return x, "lit", "", XSD + ("double" if "e" in x.lower() else "decimal" if "." in x else "integer")
        if x in ("true", "false"):
            return x, "lit", "", XSD + "boolean"
        if kind == "name" and ":" in x:
            prefix, _, rest = x.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + rest, "iri", "", ""
        if x == "[":
            name = self.blank()
            if self.peek()[1] != "]":
                self.properties(name, "bnode")
            self.take("]")
            return name, "bnode", "", ""
        if x == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.take(")")
            cells = [self.blank() for _ in items]
            for k, item in enumerate(items):
                self.add(cells[k], "bnode", RDF + "first", item)
                self.add(cells[k], "bnode", RDF + "rest", (cells[k + 1], "bnode", "", "") if k + 1 < len(cells) else (RDF + "nil", "iri", "", ""))
            return (cells[0], "bnode", "", "") if cells else (RDF + "nil", "iri", "", "")
        raise ValueError(f"no term: {x!r}")

    def blank(self) -> str:
        self.fresh += 1
        return f"_:{self.stem}{self.fresh}"

    def add(self, s: str, s_kind: str, p: str, o: tuple[str, str, str, str]) -> None:
        self.out.append((s, s_kind, p, *o))

    def properties(self, s: str, s_kind: str) -> None:
        while True:
            p = RDF + "type" if self.peek()[1] == "a" else None
            p = (self.take(), p)[1] if p else self.node()[0]
            self.add(s, s_kind, p, self.node())
            while self.peek()[1] == ",":
                self.take()
                self.add(s, s_kind, p, self.node())
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]") or self.peek()[0] == "end":
                return

    def read(self) -> list[Triple]:
        while self.peek()[0] != "end":
            x = self.peek()[1]
            if x.lower() in ("@prefix", "prefix"):
                self.take()
                name = self.take()[1]
                self.prefixes[name[:-1]] = self.iri(self.take()[1])
            elif x.lower() in ("@base", "base"):
                self.take()
                self.base = self.iri(self.take()[1])
            else:
                s, kind, _, _ = self.node()
                if self.peek()[1] != "." or kind != "bnode":
                    self.properties(s, kind)
            if self.peek()[1] == "." or not x.isalpha():
                self.take(".")
        return self.out


def turtle(text: str, prefixes: dict[str, str] | None = None, base: str = "", stem: str = "t") -> list[Triple]:
    """The triples of a text, with what prefixes and base hold before it; new blank nodes are ``_:`` and ``stem`` and a number."""
    try:
        return _Turtle(text, prefixes, base, stem).read()
    except RecursionError as e:
        raise ValueError("blank nodes or lists nested too deeply") from e


def rdf_xml(text: str) -> list[Triple]:
    """Descriptions and typed nodes, nested or referred to, with literal, resource, collection-free property elements and property attributes."""
    out: list[Triple] = []
    count = 0
    name = lambda tag: "".join(tag[1:].split("}", 1)) if tag.startswith("{") else tag
    q, lang_key, base_key = (lambda x: f"{{{RDF}}}{x}"), "{http://www.w3.org/XML/1998/namespace}lang", "{http://www.w3.org/XML/1998/namespace}base"

    def whole(x: str, base: str) -> str:
        return x if re.match(r"[A-Za-z][\w+.-]*:", x) else base + x

    def blank() -> str:
        nonlocal count
        count += 1
        return f"_:x{count}"

    def node(e: ET.Element, base: str, lang: str) -> tuple[str, str]:
        base, lang = e.get(base_key, base), e.get(lang_key, lang)
        if (about := e.get(q("about"))) is not None:
            s, kind = whole(about, base), "iri"
        elif (ident := e.get(q("ID"))) is not None:
            s, kind = f"{base}#{ident}", "iri"
        else:
            s, kind = (f"_:{e.get(q('nodeID'))}" if e.get(q("nodeID")) else blank()), "bnode"
        if e.tag != q("Description"):
            out.append((s, kind, RDF + "type", name(e.tag), "iri", "", ""))
        for k, v in e.attrib.items():
            if not k.startswith((f"{{{RDF}}}", "{http://www.w3.org/XML/1998/namespace}")):
                out.append((s, kind, name(k), v, "lit", lang, ""))
        for p in e:
            put(s, kind, p, base, lang)
        return s, kind

    def put(s: str, kind: str, p: ET.Element, base: str, lang: str) -> None:
        base, lang = p.get(base_key, base), p.get(lang_key, lang)
        if (to := p.get(q("resource"))) is not None:
            out.append((s, kind, name(p.tag), whole(to, base), "iri", "", ""))
        elif p.get(q("nodeID")):
            out.append((s, kind, name(p.tag), f"_:{p.get(q('nodeID'))}", "bnode", "", ""))
        elif p.get(q("parseType")) == "Resource":
            inner = blank()
            out.append((s, kind, name(p.tag), inner, "bnode", "", ""))
            for x in p:
                put(inner, "bnode", x, base, lang)
        elif len(p):
            for child in p:
                o, o_kind = node(child, base, lang)
                out.append((s, kind, name(p.tag), o, o_kind, "", ""))
        else:
            dtype = p.get(q("datatype"), "")
            out.append((s, kind, name(p.tag), p.text or "", "lit", "" if dtype else lang, dtype))

    try:
        top = ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError(f"not XML: {e}") from e
    for e in list(top) if top.tag == q("RDF") else [top]:
        node(e, top.get(base_key, ""), top.get(lang_key, ""))
    return out


def n_triples(text: str) -> list[Triple]:
    """For the trial of syntaxes: a Turtle document without prefixes, a triple a line."""
    from .readers import TRIPLE

    lines = [x for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    if not all(re.match(TRIPLE, x) for x in lines):
        raise ValueError("not N-Triples")
    return turtle("\n".join(lines))


READERS = {"nt": n_triples, "turtle": turtle, "xml": rdf_xml}


def read_text(text: str, kind: str) -> list[Triple]:
    """The triples of a document; with ``try`` by the first syntax that reads all of it."""
    faults = []
    for one in READERS if kind == "try" else (kind,):
        try:
            return READERS[one](text)
        except ValueError as e:
            faults.append(f"{one}: {e}")
    raise ValueError("; ".join(faults))


def read_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Distinct triples of whole files. Blank nodes are named by their file too, since names hold within one."""
    files = spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("file"), "value")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = lambda x, k: f"_:f{file & 0xFFFFFFFFFFFFFFFF:x}{x[2:]}" if k == "bnode" else x  # noqa: B023, E731
                rows = [(own(s, sk), p, own(o, ok), ok, lang, dtype, sk, re.search(r"[^#/:]*\Z", p)[0]) for s, sk, p, o, ok, lang, dtype in read_text((text or "").removeprefix("﻿"), kind)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return files.mapInArrow(run, SCHEMA).distinct()
