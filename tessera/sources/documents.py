"""Turtle, TriG, RDF/XML and JSON-LD: formats whose statements span lines, a document per row.

A document is read by a small Python reader inside Arrow batches, which gives the terms of each statement in N-Triples syntax; Spark
parses those as it does N-Triples. Blank nodes are named by document. Malformed documents fail the query, or with ``strict=False``
give what was read before the fault.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import QUAD
from ..terms import RDF, XSD, unescaped
from .ntriples import parsed

Statement = tuple[str, str, str, str]
XML = "{http://www.w3.org/XML/1998/namespace}"
R = "{" + RDF + "}"
ROWS, CHARS = 8192, 1 << 22  # of an Arrow batch of statements


def text_literal(value: str, datatype: str = "", lang: str = "") -> str:
    value = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f'"{value}"' + (f"@{lang}" if lang else f"^^<{datatype}>" if datatype and datatype != XSD + "string" else "")


def resolved(iri: str, base: str) -> str:
    return iri if not base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else urljoin(base, iri)


TOKEN = re.compile(
    r"""(?:\s+|\#[^\n]*)*(?:(?P<quote><<|>>)|(?P<iri><[^<>"{}|^`\s]*>)|(?P<text>\"{3}(?:[^"\\]++|\\.|"{1,2}(?!"))*\"{3}|'{3}(?:[^'\\]++|\\.|'{1,2}(?!'))*'{3}|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+')"""
    r"""|(?P<blank>_:[^\s<>"'()\[\]{};,]*[^\s<>"'()\[\]{};,.])|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<number>[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?|\d+\.\d+|\d+))"""
    r"""|(?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w:%-]|\\.|\.(?=[\w:%\\-]))*)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\](){}]))""", re.S,
)
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
LETTERS = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def plain(text: str) -> str:
    return text if "\\" not in text else ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else LETTERS.get(m[3], m[3]), text)


class Turtle:
    """Statements of a Turtle or TriG text, in order."""

    def __init__(self, text: str, node: str, base: str = "") -> None:
        self.text, self.node, self.base, self.at, self.n, self.prefixes, self.graph, self.out = text, node, base, 0, 0, {}, "", []
        self.step()

    def step(self) -> None:
        m = TOKEN.match(self.text, self.at)
        if m is None:
            rest = re.compile(r"(?:\s+|#[^\n]*)*").match(self.text, self.at).end()
            if rest < len(self.text):
                raise ValueError(f"unexpected text at {rest}: {self.text[rest : rest + 20]!r}")
            self.kind, self.value = "end", ""
        else:
            self.kind, self.value, self.at = m.lastgroup, m[m.lastgroup], m.end()

    def take(self, *values: str) -> bool:
        if self.value in values and self.kind in ("mark", "quote"):
            self.step()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise ValueError(f"{value!r} expected at {self.at}, not {self.value!r}")

    def fresh(self) -> str:
        self.n += 1
        return f"_:{self.node}g{self.n}"

    def iri(self) -> str:
        kind, value = self.kind, self.value
        if kind == "iri":
            out = resolved(plain(value[1:-1]), self.base)
        elif kind == "name":
            prefix, _, local = value.partition(":")
            out = self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        else:
            raise ValueError(f"IRI expected at {self.at}, not {value!r}")
        self.step()
        return out

    def term(self) -> str:
        kind, value = self.kind, self.value
        if kind in ("iri", "name"):
            return f"<{self.iri()}>"
        if kind == "blank":
            self.step()
            return f"_:{self.node}{value[2:]}"
        if kind == "text":
            self.step()
            body = plain(value[3:-3] if value[:3] in ('"""', "'''") else value[1:-1])
            if self.kind == "at":
                lang = self.value[1:]
                self.step()
                return text_literal(body, lang=lang.lower())
            if self.kind == "type":
                self.step()
                return text_literal(body, self.iri())
            return text_literal(body)
        if kind == "number":
            self.step()
            return text_literal(value, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"))
        if kind == "word" and value in ("true", "false"):
            self.step()
            return text_literal(value, XSD + "boolean")
        if self.take("<<"):
            s, p, o = self.term(), self.verb(), self.term()
            self.need(">>")
            return f"<< {s} <{p}> {o} >>"
        if self.take("["):
            node = self.fresh()
            if not self.take("]"):
                self.properties(node)
                self.need("]")
            return node
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.term())
            head = f"<{RDF}nil>"
            for x in reversed(items):
                node = self.fresh()
                self.out += [(node, RDF + "first", x, self.graph), (node, RDF + "rest", head, self.graph)]
                head = node
            return head
        raise ValueError(f"term expected at {self.at}, not {value!r}")

    def verb(self) -> str:
        if self.kind == "word" and self.value == "a":
            self.step()
            return RDF + "type"
        return self.iri()

    def properties(self, s: str) -> None:
        while True:
            p = self.verb()
            while True:
                self.out.append((s, p, self.term(), self.graph))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.value in (".", "]", "}") and self.kind == "mark":
                return

    def triples(self, s: str) -> None:
        if not (self.value in (".", "}") and self.kind == "mark"):
            self.properties(s)

    def block(self, graph: str) -> None:
        self.need("{")
        self.graph = graph
        while not self.take("}"):
            self.triples(self.term())
            self.take(".")
        self.graph = ""

    def statements(self) -> Iterator[Statement]:
        while self.kind != "end":
            word = self.value.lstrip("@").lower()
            if word in ("prefix", "base") and self.kind in ("at", "word"):
                dotted = self.kind == "at"
                self.step()
                if word == "prefix":
                    name = self.value[:-1]
                    self.step()
                    self.prefixes[name] = self.iri()
                else:
                    self.base = self.iri()
                if dotted:
                    self.need(".")
            elif word == "graph" and self.kind == "word":
                self.step()
                self.block(self.term().strip("<>"))
            elif self.value == "{" and self.kind == "mark":
                self.block("")
            else:
                s = self.term()
                if self.value == "{" and self.kind == "mark":
                    self.block(s.strip("<>"))
                else:
                    self.triples(s)
                    self.need(".")
            yield from self.out
            self.out = []


def turtle(text: str, node: str, base: str = "") -> Iterator[Statement]:
    return Turtle(text, node, base).statements()


def rdfxml(text: str, node: str, base: str = "") -> Iterator[Statement]:
    count = [0]
    iri = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def fresh() -> str:
        count[0] += 1
        return f"_:{node}x{count[0]}"

    def subject(e: ET.Element, base: str) -> str:
        if R + "about" in e.attrib:
            return f"<{resolved(e.attrib[R + 'about'], base)}>"
        if R + "ID" in e.attrib:
            return f"<{resolved('#' + e.attrib[R + 'ID'], base)}>"
        return f"_:{node}{e.attrib[R + 'nodeID']}" if R + "nodeID" in e.attrib else fresh()

    def described(e: ET.Element, base: str, lang: str) -> Iterator:
        base, lang = e.attrib.get(XML + "base", base), e.attrib.get(XML + "lang", lang)
        s = subject(e, base)
        yield s
        if e.tag != R + "Description":
            yield s, RDF + "type", f"<{iri(e.tag)}>", ""
        yield from attributes(s, e, lang)
        yield from properties(s, e, base, lang)

    def attributes(s: str, e: ET.Element, lang: str) -> Iterator[Statement]:
        for k, v in e.attrib.items():
            if k == R + "type":
                yield s, RDF + "type", f"<{v}>", ""
            elif not k.startswith((R, XML)):
                yield s, iri(k), text_literal(v, lang=lang.lower()), ""

    def node_of(e: ET.Element, base: str, lang: str) -> tuple[str, Iterator[Statement]]:
        rows = described(e, base, lang)
        return next(rows), rows

    def properties(s: str, e: ET.Element, base: str, lang: str) -> Iterator[Statement]:
        li = 0
        for c in e:
            own_base, own, kind = c.attrib.get(XML + "base", base), c.attrib.get(XML + "lang", lang), c.attrib.get(R + "parseType")
            li += c.tag == R + "li"
            p = f"{RDF}_{li}" if c.tag == R + "li" else iri(c.tag)
            if R + "resource" in c.attrib or R + "nodeID" in c.attrib:
                o = f"<{resolved(c.attrib[R + 'resource'], own_base)}>" if R + "resource" in c.attrib else f"_:{node}{c.attrib[R + 'nodeID']}"
                yield s, p, o, ""
                yield from attributes(o, c, own)
            elif kind == "Resource":
                o = fresh()
                yield s, p, o, ""
                yield from properties(o, c, own_base, own)
            elif kind == "Collection":
                heads = [node_of(x, own_base, own) for x in c]
                cells = [fresh() for _ in heads]
                yield s, p, cells[0] if cells else f"<{RDF}nil>", ""
                for k, (o, rows) in enumerate(heads):
                    yield from rows
                    yield cells[k], RDF + "first", o, ""
                    yield cells[k], RDF + "rest", cells[k + 1] if k + 1 < len(cells) else f"<{RDF}nil>", ""
            elif kind == "Literal":
                yield s, p, text_literal((c.text or "") + "".join(ET.tostring(x, "unicode") for x in c), RDF + "XMLLiteral"), ""
            elif len(c):
                o, rows = node_of(c[0], own_base, own)
                yield s, p, o, ""
                yield from rows
            elif any(not k.startswith((R, XML)) for k in c.attrib):
                o = fresh()
                yield s, p, o, ""
                yield from attributes(o, c, own)
            else:
                yield s, p, text_literal(c.text or "", c.attrib.get(R + "datatype", ""), "" if R + "datatype" in c.attrib else own.lower()), ""

    root = ET.fromstring(text)
    base, lang = root.attrib.get(XML + "base", base), root.attrib.get(XML + "lang", "")
    for e in root if root.tag == R + "RDF" else [root]:
        yield from node_of(e, base, lang)[1]


class JsonLd:
    """Statements of a JSON-LD document with its own context; remote contexts are not fetched."""

    def __init__(self, node: str, base: str = "") -> None:
        self.node, self.base, self.n, self.out = node, base, 0, []

    def extended(self, ctx: dict, new: object) -> dict:
        for c in new if isinstance(new, list) else [new]:
            if c is None:
                ctx = {}
            elif isinstance(c, dict):
                ctx = {**ctx, **c}
            else:
                raise ValueError(f"remote context {c!r}")
        return ctx

    def name(self, term: str, ctx: dict, vocab: bool = True) -> str | None:
        """The IRI of a term, prefixed name or relative reference; None for a term that stands for nothing."""
        if term.startswith("@"):
            return term
        if vocab and term in ctx:
            own = ctx[term]
            own = own.get("@id", term) if isinstance(own, dict) else own
            if own is None:
                return None
            if own != term:
                return self.name(own, {k: v for k, v in ctx.items() if k != term})
        prefix, colon, local = term.partition(":")
        if colon and not local.startswith("//") and prefix in ctx and prefix != "_":
            head = self.name(prefix, ctx)
            return None if head is None else head + local
        if colon:
            return term
        if vocab:
            return ctx["@vocab"] + term if ctx.get("@vocab") else None
        return resolved(term, ctx.get("@base") or self.base)

    def reference(self, iri: str) -> str:
        return f"_:{self.node}{iri[2:]}" if iri.startswith("_:") else f"<{iri}>"

    def fresh(self) -> str:
        self.n += 1
        return f"_:{self.node}j{self.n}"

    def literal(self, v: object, kind: str = "", lang: str = "") -> str:
        if isinstance(v, bool):
            return text_literal(str(v).lower(), kind or XSD + "boolean")
        if isinstance(v, int) or isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
            return text_literal(str(int(v)), kind or XSD + "integer")
        return text_literal(repr(v), kind or XSD + "double") if isinstance(v, float) else text_literal(str(v), kind, "" if kind else lang.lower())

    def value(self, v: object, ctx: dict, spec: dict, graph: str) -> list[str]:
        """The terms of a property's value."""
        if v is None:
            return []
        if isinstance(v, list):
            items = [t for x in v for t in self.value(x, ctx, {k: y for k, y in spec.items() if k != "@container"}, graph)]
            return [self.listed(items, graph)] if spec.get("@container") == "@list" else items
        if isinstance(v, dict):
            keys = {self.name(k, ctx): k for k in v}
            if "@value" in keys:
                kind = v.get(keys.get("@type")) if "@type" in keys else None
                return [] if v[keys["@value"]] is None else [self.literal(v[keys["@value"]], self.name(kind, ctx) or "" if kind else "", v.get(keys.get("@language")) or "" if "@language" in keys else "")]
            if "@list" in keys:
                inner = v[keys["@list"]]
                return [self.listed([t for x in (inner if isinstance(inner, list) else [inner]) for t in self.value(x, ctx, {}, graph)], graph)]
            if "@set" in keys:
                return self.value(v[keys["@set"]], ctx, spec, graph)
            if spec.get("@container") == "@language":
                return [self.literal(y, "", lang) for lang, x in v.items() for y in (x if isinstance(x, list) else [x])]
            return [self.read(v, ctx, graph)]
        kind = spec.get("@type")
        if isinstance(v, str) and kind in ("@id", "@vocab"):
            return [self.reference(self.name(v, ctx, kind == "@vocab") or v)]
        lang = spec["@language"] if "@language" in spec else ctx.get("@language")
        return [self.literal(v, self.name(kind, ctx) or "" if kind else "", lang or "" if isinstance(v, str) else "")]

    def listed(self, items: list[str], graph: str) -> str:
        head = f"<{RDF}nil>"
        for x in reversed(items):
            node = self.fresh()
            self.out += [(node, RDF + "first", x, graph), (node, RDF + "rest", head, graph)]
            head = node
        return head

    def read(self, doc: dict, ctx: dict, graph: str) -> str:
        """The node's term; its statements are kept."""
        if "@context" in doc:
            ctx = self.extended(ctx, doc["@context"])
        keys = [(self.name(k, ctx), k) for k in doc if k != "@context"]
        own = next((doc[k] for n, k in keys if n == "@id"), None)
        s = self.fresh() if own is None else self.reference(self.name(own, ctx, False))
        for n, k in keys:
            v, spec = doc[k], ctx.get(k) if isinstance(ctx.get(k), dict) else {}
            if n == "@type":
                self.out += [(s, RDF + "type", self.reference(self.name(t, ctx) or t), graph) for t in (v if isinstance(v, list) else [v])]
            elif n == "@graph":
                inner = graph if own is None and len(keys) == 1 else s.strip("<>")
                for x in v if isinstance(v, list) else [v]:
                    self.read(x, ctx, inner)
            elif n == "@reverse":
                for p, xs in v.items():
                    self.out += [(self.read(x, ctx, graph) if isinstance(x, dict) else self.reference(self.name(x, ctx, False)), self.name(p, ctx), s, graph) for x in (xs if isinstance(xs, list) else [xs])]
            elif n and not n.startswith("@") and ":" in n:
                if "@reverse" in spec:
                    self.out += [(o, self.name(spec["@reverse"], ctx), s, graph) for o in self.value(v, ctx, {**spec, "@type": "@id"}, graph)]
                else:
                    self.out += [(s, n, o, graph) for o in self.value(v, ctx, spec, graph)]
        return s


def jsonld(text: str, node: str, base: str = "") -> Iterator[Statement]:
    reader, doc = JsonLd(node, base), json.loads(text)
    for d in doc if isinstance(doc, list) else [doc]:
        reader.read(d, {}, "")
    yield from reader.out


READERS: dict[str, Callable[..., Iterator[Statement]]] = {"turtle": turtle, "trig": turtle, "rdfxml": rdfxml, "jsonld": jsonld}


def parse(docs: DataFrame, kind: str, graph: str = "", base: str = "", strict: bool = True, distinct: bool = True) -> DataFrame:
    """Quads of documents (column ``value``, a whole document each) of the kind turtle, trig, rdfxml or jsonld.

    Documents are dealt evenly over the tasks, as those of a small file have much to do for each; an Arrow batch holds the statements of many."""
    reader = READERS[kind]

    def run(batches):
        rows, size = [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["s", "p", "o", "g"])
        for b in batches:
            for value, node in zip(b.column("value"), b.column("node")):
                own = []
                try:
                    own.extend(reader(value.as_py(), node.as_py(), base))
                except (ValueError, KeyError, ET.ParseError):
                    if strict:
                        raise
                rows += own
                size += sum(len(r[2]) for r in own)
                if len(rows) >= ROWS or size >= CHARS:
                    yield made()
                    rows, size = [], 0
        if rows:
            yield made()

    node = F.concat(F.lit("b"), F.hex(F.xxhash64("value")), F.lit("n")).alias("node")
    dealt = docs.filter("value IS NOT NULL").select("value").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt.select("value", node).mapInArrow(run, "s string, p string, o string, g string")
    quads = rows.select(parsed(F.col("s")).alias("s"), "p", parsed(F.col("o")).alias("o"), F.when(F.col("g") == "", graph).otherwise(unescaped(F.col("g"))).alias("g")).select(QUAD)
    return quads.distinct() if distinct else quads


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """Files, each one document; the kind follows from the path's ending (ttl, trig, rdf, owl, xml, jsonld) unless it is given."""
    kinds = {"ttl": "turtle", "trig": "trig", "rdf": "rdfxml", "owl": "rdfxml", "xml": "rdfxml", "jsonld": "jsonld"}
    return parse(spark.read.text(path, wholetext=True), kind or kinds[path.rstrip("/").rsplit(".", 1)[-1]], **options)
