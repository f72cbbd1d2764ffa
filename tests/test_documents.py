"""Readers of whole documents against small cases of each format."""

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.sources import documents as R
from tessera.terms import RDF, XSD

DATA = "/root/testdata/sf0.001"
EX = "http://e/"


def statements(reader, text, base=""):
    return sorted((s, p, o, g) for s, p, o, g in reader(text, "n", base))


def test_turtle_terms_and_directives():
    text = r"""@base <http://e/> . @prefix : <http://e/> . # a note
    :a a :T ; :p "xé\n", 'y'@EN, '''long "q"
''' , 1, -2.5, 3e1, true ; . <b> :q [ :r _:c ] ; :l (1 :a) .
    << :a :p 1 >> :says "z"^^:code . PREFIX z: <urn:z#> z:a.b :p z: ."""
    got = statements(R.turtle, text)
    want = [
        ("<http://e/a>", RDF + "type", "<http://e/T>", ""), ("<http://e/a>", EX + "p", '"xé\\n"', ""), ("<http://e/a>", EX + "p", '"y"@en', ""), ("<http://e/a>", EX + "p", '"long \\"q\\"\\n"', ""),
        ("<http://e/a>", EX + "p", f'"1"^^<{XSD}integer>', ""), ("<http://e/a>", EX + "p", f'"-2.5"^^<{XSD}decimal>', ""), ("<http://e/a>", EX + "p", f'"3e1"^^<{XSD}double>', ""), ("<http://e/a>", EX + "p", f'"true"^^<{XSD}boolean>', ""),
        ("<http://e/b>", EX + "q", "_:ng1", ""), ("_:ng1", EX + "r", "_:nc", ""), ("<http://e/b>", EX + "l", "_:ng3", ""), ("_:ng2", RDF + "first", "<http://e/a>", ""), ("_:ng2", RDF + "rest", f"<{RDF}nil>", ""),
        ("_:ng3", RDF + "first", f'"1"^^<{XSD}integer>', ""), ("_:ng3", RDF + "rest", "_:ng2", ""), (f'<< <http://e/a> <http://e/p> "1"^^<{XSD}integer> >>', EX + "says", '"z"^^<http://e/code>', ""), ("<urn:z#a.b>", EX + "p", "<urn:z#>", ""),
    ]
    assert got == sorted(want)


def test_trig_graphs():
    got = statements(R.turtle, '@prefix : <http://e/> . { :a :p 1 . } :g { :a :p :b . :c :p :d } GRAPH <http://e/h> { :x :y "z" . } :o :p :q .')
    assert [(s, g) for s, _, _, g in got] == [("<http://e/a>", ""), ("<http://e/a>", EX + "g"), ("<http://e/c>", EX + "g"), ("<http://e/o>", ""), ("<http://e/x>", EX + "h")]


@pytest.mark.parametrize("text", ["<a> <b> .", "<a> <b> 'x", "x:a <b> <c> .", "<a> <b> <c>"])
def test_turtle_faults(text):
    with pytest.raises((ValueError, KeyError)):
        statements(R.turtle, text)


def test_rdfxml():
    text = """<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://e/x" xml:lang="DE">
    <e:T r:about="a" e:note="n"><e:p r:resource="#b"/><e:q xml:lang="">x</e:q><e:q r:datatype="http://e/d">7</e:q>
    <e:in><r:Description r:nodeID="k"/></e:in><e:res r:parseType="Resource"><e:p>y</e:p></e:res><e:col r:parseType="Collection"><e:T r:ID="c"/></e:col></e:T></r:RDF>"""
    got = statements(R.rdfxml, text)
    a = "<http://e/a>"
    for row in [(a, RDF + "type", "<http://e/T>", ""), (a, EX + "note", '"n"@de', ""), (a, EX + "p", "<http://e/x#b>", ""), (a, EX + "q", '"x"', ""), (a, EX + "q", '"7"^^<http://e/d>', ""), (a, EX + "in", "_:nk", ""), ("<http://e/x#c>", RDF + "type", "<http://e/T>", "")]:
        assert row in got
    assert len([r for r in got if r[1] in (RDF + "first", RDF + "rest")]) == 2 and any(r[1] == EX + "p" and r[2] == '"y"@de' for r in got)


def test_jsonld_context():
    doc = """{"@context": {"@vocab": "http://v/", "e": "http://e/", "knows": {"@id": "e:knows", "@type": "@id"}, "none": null, "tags": {"@id": "e:tags", "@container": "@list"}, "label": {"@id": "e:label", "@container": "@language"}, "of": {"@reverse": "e:has"}},
     "@id": "e:a", "@type": ["T", "e:U"], "knows": ["e:b", {"@id": "_:c", "age": 3}], "none": "x", "tags": ["t", 1.5], "label": {"en": "hi", "de": ["ho"]}, "of": "e:z", "on": true, "at": {"@value": "5", "@type": "e:d"}}"""
    got = statements(R.jsonld, doc)
    a = "<http://e/a>"
    for row in [(a, RDF + "type", "<http://v/T>", ""), (a, RDF + "type", "<http://e/U>", ""), (a, EX + "knows", "<http://e/b>", ""), (a, EX + "knows", "_:nc", ""), ("_:nc", "http://v/age", f'"3"^^<{XSD}integer>', ""), (a, EX + "label", '"hi"@en', ""), (a, EX + "label", '"ho"@de', ""), ("<http://e/z>", EX + "has", a, ""), (a, "http://v/on", f'"true"^^<{XSD}boolean>', ""), (a, "http://v/at", '"5"^^<http://e/d>', "")]:
        assert row in got, row
    assert not any("none" in r[1] for r in got) and len([r for r in got if r[1] == RDF + "first"]) == 2


def test_documents_are_dealt_out_and_parsed_once(spark):
    docs = spark.range(50).select(F.concat(F.lit("<urn:a"), "id", F.lit("> <urn:p> 'x' , 1 . <urn:b> <urn:q> 'y'")).alias("value"))
    got = R.parse(docs.coalesce(1), "turtle", strict=False, distinct=False)
    assert got.rdd.getNumPartitions() > 1
    assert got.count() == 100
    for name in ("load_turtle", "load_rdfxml", "load_jsonld"):
        assert "MapInArrow" not in catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
