"""Standard rule sets: RDFS, OWL RL and SKOS."""

from __future__ import annotations

from ..terms import OWL, RDF, RDFS, SKOS
from .datalog import Rule

_PREFIX = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "skos": SKOS}


def rule(head: str, *body: str) -> Rule:
    """A rule from atoms such as ``?x a ?c`` with prefixed names."""

    def name(x: str) -> str:
        if x == "a":
            return RDF + "type"
        prefix, _, local = x.partition(":")
        return _PREFIX[prefix] + local if prefix in _PREFIX else x

    atom = lambda t: tuple(name(x) for x in t.split())
    return Rule(atom(head), [atom(b) for b in body])


def rdfs() -> list[Rule]:
    return [
        rule("?x a ?c", "?p rdfs:domain ?c", "?x ?p ?y"),
        rule("?y a ?c", "?p rdfs:range ?c", "?x ?p ?y"),
        rule("?p rdfs:subPropertyOf ?r", "?p rdfs:subPropertyOf ?q", "?q rdfs:subPropertyOf ?r"),
        rule("?x ?q ?y", "?p rdfs:subPropertyOf ?q", "?x ?p ?y"),
        rule("?c rdfs:subClassOf ?e", "?c rdfs:subClassOf ?d", "?d rdfs:subClassOf ?e"),
        rule("?x a ?d", "?c rdfs:subClassOf ?d", "?x a ?c"),
    ]


def owl_rl() -> list[Rule]:
    return [
        *rdfs(),
        rule("?y ?p ?x", "?p a owl:SymmetricProperty", "?x ?p ?y"),
        rule("?x ?p ?z", "?p a owl:TransitiveProperty", "?x ?p ?y", "?y ?p ?z"),
        rule("?y ?q ?x", "?p owl:inverseOf ?q", "?x ?p ?y"),
        rule("?y ?p ?x", "?p owl:inverseOf ?q", "?x ?q ?y"),
        rule("?y owl:sameAs ?z", "?p a owl:FunctionalProperty", "?x ?p ?y", "?x ?p ?z"),
        rule("?x owl:sameAs ?z", "?p a owl:InverseFunctionalProperty", "?x ?p ?y", "?z ?p ?y"),
        rule("?y owl:sameAs ?x", "?x owl:sameAs ?y"),
        rule("?x owl:sameAs ?z", "?x owl:sameAs ?y", "?y owl:sameAs ?z"),
        rule("?y ?p ?o", "?x owl:sameAs ?y", "?x ?p ?o"),
        rule("?s ?p ?y", "?x owl:sameAs ?y", "?s ?p ?x"),
        rule("?c rdfs:subClassOf ?d", "?c owl:equivalentClass ?d"),
        rule("?d rdfs:subClassOf ?c", "?c owl:equivalentClass ?d"),
        rule("?p rdfs:subPropertyOf ?q", "?p owl:equivalentProperty ?q"),
        rule("?q rdfs:subPropertyOf ?p", "?p owl:equivalentProperty ?q"),
        rule("?x ?r ?z", "?r owl:propertyChainAxiom ?l", "?l rdf:first ?p", "?l rdf:rest ?m", "?m rdf:first ?q", "?m rdf:rest rdf:nil", "?x ?p ?y", "?y ?q ?z"),
        rule("?x a ?c", "?c owl:hasValue ?v", "?c owl:onProperty ?p", "?x ?p ?v"),
        rule("?x ?p ?v", "?c owl:hasValue ?v", "?c owl:onProperty ?p", "?x a ?c"),
        rule("?x a ?c", "?c owl:someValuesFrom ?d", "?c owl:onProperty ?p", "?x ?p ?y", "?y a ?d"),
        rule("?y a ?d", "?c owl:allValuesFrom ?d", "?c owl:onProperty ?p", "?x a ?c", "?x ?p ?y"),
        rule("?x a ?i", "?i owl:intersectionOf ?l", "?l rdf:first ?c", "?l rdf:rest ?m", "?m rdf:first ?d", "?m rdf:rest rdf:nil", "?x a ?c", "?x a ?d"),
        rule("?x a ?u", "?u owl:unionOf ?l", "?l rdf:first ?c", "?x a ?c"),
    ]


def skos() -> list[Rule]:
    return [
        rule("?y skos:narrower ?x", "?x skos:broader ?y"),
        rule("?y skos:broader ?x", "?x skos:narrower ?y"),
        rule("?x skos:broaderTransitive ?y", "?x skos:broader ?y"),
        rule("?x skos:broaderTransitive ?z", "?x skos:broaderTransitive ?y", "?y skos:broaderTransitive ?z"),
        rule("?y skos:narrowerTransitive ?x", "?x skos:broaderTransitive ?y"),
        rule("?y skos:related ?x", "?x skos:related ?y"),
        rule("?x skos:hasTopConcept ?y", "?y skos:topConceptOf ?x"),
        rule("?y skos:inScheme ?x", "?x skos:hasTopConcept ?y"),
    ]
