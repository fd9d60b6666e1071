"""Turtle as a triples table: a reader for prefixes, lists of predicates and objects, blank nodes, collections and literals.

Files are read by Spark as whole files, one row each, and parsed on the executors; a file is the unit of parallelism. Blank nodes get names
from the file and their path (subject, predicate, position), so they are the same in every run.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.session import ship_package
from labelweave.storage import spread

SCHEMA = "s string, p string, o string, kind string, datatype string, lang string"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(
    r'\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\')|(?P<str>"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|(?P<type>\^\^)|(?P<lang>@[A-Za-z][\w-]*)'
    r"|(?P<num>[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+))|(?P<blank>_:[\w.-]*\w)|(?P<name>[A-Za-z_][\w.-]*:(?:[\w%:][\w.%:-]*[\w%:-]|[\w%])?|:(?:[\w%][\w.%:-]*[\w%:-]|[\w%])?|a(?![\w:])|true\b|false\b|PREFIX\b|BASE\b|prefix\b|base\b)|(?P<mark>[.;,()\[\]])",
    re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" else _ESCAPES.get(m[1], m[1]), text)


class Parser:
    """Recursive descent over the tokens of one file."""

    def __init__(self, text: str, base: str = "", source: str = ""):
        self.tokens, self.at, self.base, self.source, self.prefixes = self._lex(text), 0, base, source, {}
        self.triples: list[tuple[str, str, str, str, str | None]] = []

    @staticmethod
    def _lex(text: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no Turtle at {at}: {text[at : at + 40]!r}")
            if m.lastgroup:
                out.append((m.lastgroup, m[0]))
            at = m.end()
        return out

    def _peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def _take(self, value: str | None = None) -> tuple[str, str]:
        token = self._peek()
        if token[0] == "end" or value is not None and token[1] != value:
            raise ValueError(f"expected {value or 'more'}, found {token[1]!r}")
        self.at += 1
        return token

    def parse(self) -> list[tuple[str, str, str, str, str | None, str | None]]:
        n = 0
        while self._peek()[0] != "end":
            kind, text = self._peek()
            if text.lower() in ("@prefix", "prefix", "@base", "base"):
                self._take()
                if "prefix" in text.lower():
                    name = self._take()[1]
                    self.prefixes[name.rstrip(":")] = self._iri(self._take()[1])
                else:
                    self.base = self._iri(self._take()[1])
                if text[0] == "@":
                    self._take(".")
                continue
            n += 1
            alone = text == "["
            subject, *_ = self._node(f"{n}")
            if not (alone and self._peek()[1] == "."):
                self._predicates(subject, f"{n}")
            self._take(".")
        return self.triples

    def _iri(self, token: str) -> str:
        iri = _unescape(token[1:-1])
        return iri if re.match(r"[A-Za-z][\w+.-]*:", iri) or not self.base else self.base + iri

    def _blank(self, path: str) -> str:
        return "_:" + hashlib.sha256(f"{self.source}|{path}".encode()).hexdigest()[:16]

    def _node(self, path: str) -> tuple[str, str, str | None, str | None]:
        """(term, kind, datatype, language tag)"""
        found = self._term(path)
        return (*found, *[None] * (4 - len(found)))

    def _term(self, path: str) -> tuple:
        """(term, kind, datatype), and the tag of a string that has one."""
        kind, text = self._take()
        if kind == "iri":
            return self._iri(text), "iri", None
        if kind == "blank":
            return self._blank(text), "bnode", None
        if kind in ("str", "long"):
            value, datatype = _unescape(text[3:-3] if kind == "long" else text[1:-1]), XSD + "string"
            if self._peek()[0] == "type":
                self._take()
                datatype = self._node(path)[0]
            elif self._peek()[0] == "lang":
                datatype, lang = RDF + "langString", self._take()[1].lstrip("@").lower()
                return value, "literal", datatype, lang
            return value, "literal", datatype
        if kind == "num":
            return text, "literal", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer")
        if text in ("true", "false"):
            return text, "literal", XSD + "boolean"
        if text == "a":
            return RDF + "type", "iri", None
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + local, "iri", None
        if text == "[":
            name = self._blank(path)
            if self._peek()[1] != "]":
                self._predicates(name, path)
            self._take("]")
            return name, "bnode", None
        if text == "(":
            items = []
            while self._peek()[1] != ")":
                items.append(self._node(f"{path}/{len(items)}"))
            self._take(")")
            head: tuple = (RDF + "nil", "iri", None, None)
            for i in reversed(range(len(items))):
                name = self._blank(f"{path}/list{i}")
                self.triples += [(name, RDF + "first", *items[i]), (name, RDF + "rest", *head)]
                head = (name, "bnode", None, None)
            return head
        raise ValueError(f"no term: {text!r}")

    def _predicates(self, subject: str, path: str) -> None:
        n = 0
        while True:
            predicate = self._node(path)[0]
            while True:
                n += 1
                self.triples.append((subject, predicate, *self._node(f"{path}/{n}")))
                if self._peek()[1] != ",":
                    break
                self._take()
            while self._peek()[1] == ";":
                self._take()
            if self._peek()[1] in (".", "]") or self._peek()[0] == "end":
                return


def parse(text: str, base: str = "", source: str = "") -> list[tuple[str, str, str, str, str | None, str | None]]:
    return Parser(text, base, source).parse()


def _terms(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["s", "p", "o", "kind", "datatype", "lang"])


def read_texts(texts: DataFrame, base: str = "") -> DataFrame:
    """(s, p, o, kind, datatype, lang) of the Turtle texts in the first column, as a set; a null is an empty text. Blank nodes are named by a text's own hash."""
    ship_package(texts.sparkSession)

    def run(batches):
        for batch in batches:
            yield _terms([t for x in batch.column(0).to_pylist() if x for t in parse(x, base, hashlib.md5(x.encode()).hexdigest())])

    # a small file of many texts would be one task; copies of a text are dealt, too
    dealt = spread(texts.select(F.col(texts.columns[0]).alias("text")), "text", F.monotonically_increasing_id() % 64)
    return dealt.mapInArrow(run, SCHEMA).distinct()


def read(spark: SparkSession, *paths: str, base: str = "") -> DataFrame:
    """(s, p, o, kind, datatype, lang) of all files, as a set."""
    ship_package(spark)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _terms(parse(content.decode(), base, path.rsplit("/", 1)[-1]))

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInArrow(run, SCHEMA).distinct()
