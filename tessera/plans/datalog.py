"""Datalog over quads: rules as patterns, strata, semi-naive fixpoints, well-founded models, lattices and retraction.

A rule's atoms are triples of terms and ``?variables`` (predicates may be variables too). Every body is one join plan;
a round evaluates it once for each positive atom over the new facts only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import algebra as A
from ..operators.uncertain import noisy_or
from ..store import QUAD, fixpoint, shared_dir, stored

Atom = tuple


@dataclass
class Rule:
    head: Atom
    body: list[Atom]
    negative: list[Atom] = field(default_factory=list)
    guard: Callable[[], Column] | None = None  # over the solution's columns
    binds: dict[str, Callable[[], Column]] = field(default_factory=dict)
    weight: float = 1.0


@dataclass
class Aggregate:
    """``head`` predicate: (group term, predicate, aggregate of the other variable over the pattern)."""

    predicate: str
    pattern: Atom
    group: str
    value: Callable[[], Column]


def _predicate(atom: Atom) -> str:
    return "*" if A.var(atom[1]) else atom[1]


def _head(r: Rule | Aggregate) -> str:
    return r.predicate if isinstance(r, Aggregate) else _predicate(r.head)


def _meets(a: str, b: str) -> bool:
    return "*" in (a, b) or a == b


def strata(rules: list[Rule | Aggregate]) -> list[list[Rule | Aggregate]]:
    """Rules in layers: what a negative atom names, or an aggregate counts, is complete in a lower layer. A cycle through one has none."""
    level = {id(r): 0 for r in rules}
    for _ in range(len(rules) + 1):
        changed = False
        for r in rules:
            body, strict = ([], [r.pattern]) if isinstance(r, Aggregate) else (r.body, r.negative)
            for q in rules:
                need = max((level[id(q)] for a in body if _meets(_predicate(a), _head(q))), default=0)
                need = max([need, *(level[id(q)] + 1 for a in strict if _meets(_predicate(a), _head(q)))])
                if need > level[id(r)]:
                    level[id(r)], changed = need, True
        if not changed:
            layers = sorted(set(level.values()))
            return [[r for r in rules if level[id(r)] == k] for k in layers]
        if max(level.values()) > len(rules):
            break
    raise ValueError("a rule depends on its own negation or aggregate")


def _solutions(rule: Rule, delta: DataFrame | None, known: DataFrame, against: DataFrame | None = None, heads: set[str] | None = None) -> DataFrame | None:
    """Solutions of the body; with ``delta``, those with a new fact at some atom (of the predicates ``heads``, which alone have new facts)."""
    parts = []
    for k in range(len(rule.body) if delta is not None else 1):
        if delta is not None and heads is not None and not any(_meets(_predicate(rule.body[k]), h) for h in heads):
            continue
        rows = A.match(delta if delta is not None else known, rule.body[k], "")
        rest = [a for i, a in enumerate(rule.body) if i != k]
        while rest:
            n = next((i for i, a in enumerate(rest) if {v for x in a if (v := A.var(x))} & set(rows.columns)), 0)
            rows = A.join(rows, A.match(known, rest.pop(n), ""))
        parts.append(rows)
    if not parts:
        return None
    out = reduce(lambda a, b: a.unionByName(b), parts)
    for name, value in rule.binds.items():
        out = out.withColumn(name, value())
    if rule.guard:
        out = out.filter(rule.guard())
    for atom in rule.negative:
        out = A.not_exists(out, A.match(known if against is None else against, atom, ""))
    return out


def _consequences(rules: list[Rule | Aggregate], delta: DataFrame | None, known: DataFrame, against: DataFrame | None = None, heads: set[str] | None = None) -> DataFrame | None:
    """The heads of all solutions, as quads."""
    parts = []
    for r in rules:
        if isinstance(r, Aggregate):
            rows = A.match(known, r.pattern, "").groupBy(r.group).agg(r.value().alias("_value"))
            parts.append(rows.select(F.col(r.group).alias("s"), F.lit(r.predicate).alias("p"), F.col("_value").alias("o"), F.lit("").alias("g")))
        elif (rows := _solutions(r, delta, known, against, heads)) is not None:
            parts.append(A.construct(rows, [r.head]).select(QUAD))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _of(quads: DataFrame, heads: set[str]) -> DataFrame:
    """The facts that a rule could also derive: a filter that prunes a partitioned or mapped graph."""
    return quads if "*" in heads else quads.filter(F.col("p").isin(sorted(heads)))


def derived(quads: DataFrame, rules: list[Rule | Aggregate], max_rounds: int | None = None, against: DataFrame | None = None) -> DataFrame:
    """What follows and is not given, stratum by stratum.

    Given facts are read where they are; only derived ones are written. A stratum whose heads none of its bodies name
    is one plan. The others run semi-naive: a round joins the new facts with all at the atoms that can meet them. With ``against``, negative atoms
    are looked up there, and there is one stratum."""
    spark, base = quads.sparkSession, quads.select(QUAD)
    schema, folder, done = base.schema, shared_dir(quads.sparkSession), []
    for n, layer in enumerate(strata(rules) if against is None else [rules]):
        heads = {_head(r) for r in layer}
        recursive = any(_meets(_predicate(a), h) for r in layer if isinstance(r, Rule) for a in r.body for h in heads)
        below = reduce(DataFrame.unionByName, [base, *done])

        def new(rows: DataFrame, known: DataFrame) -> DataFrame:
            return rows.dropDuplicates(QUAD).join(_of(known, heads), QUAD, "left_anti").select(QUAD)

        delta, paths = stored(new(_consequences(layer, None, below, against), below), f"{folder}/{n}-0"), [f"{folder}/{n}-0"]
        while recursive and (max_rounds is None or len(paths) < max_rounds) and not delta.isEmpty():
            known = below.unionByName(spark.read.schema(schema).parquet(*paths))
            more = _consequences(layer, delta, known, against, heads)
            if more is None:
                break
            paths.append(f"{folder}/{n}-{len(paths)}")
            delta = stored(new(more, known), paths[-1])
        done.append(spark.read.schema(schema).parquet(*paths))
    return reduce(DataFrame.unionByName, done) if done else base.limit(0)


def infer(quads: DataFrame, rules: list[Rule | Aggregate], max_rounds: int | None = None, against: DataFrame | None = None) -> DataFrame:
    """``quads`` and all that follows."""
    return quads.select(QUAD).unionByName(derived(quads, rules, max_rounds, against))


def inferred(quads: DataFrame, rules: list, **options) -> DataFrame:
    """Only what is new."""
    return derived(quads, rules, **options)


def _needs(r: Rule | Aggregate) -> list[Atom]:
    return [r.pattern] if isinstance(r, Aggregate) else [*r.body, *r.negative]


def relevant(rules: list, goal: Atom) -> list:
    """The rules that the goal's predicate depends on."""
    want, out = {_predicate(goal)}, []
    while True:
        more = [r for r in rules if not any(r is q for q in out) and any(_meets(_head(r), p) for p in want)]
        if not more:
            return out
        out += more
        want |= {_predicate(a) for r in more for a in _needs(r)}


def _vars(*terms: object) -> set[str]:
    return {v for t in terms if (v := A.var(t))}


MAGIC = "urn:tessera:magic:"


def magic(rules: list[Rule], goal: Atom) -> tuple[list[Rule], Atom] | None:
    """The rules with a magic atom each, so that only what the goal's constant asks for is derived, and the goal's seed.

    A predicate is asked by its subject (``s``) or its object (``o``). The magic fact (x, magic:o:p, x) says that p is asked for object x.
    None where that does not apply: no constant, variable predicates, negation, aggregates, or a body atom asked at no end."""
    bound = "o" if not A.var(goal[2]) else "s" if not A.var(goal[0]) else None
    if bound is None or any(isinstance(r, Aggregate) or r.negative or A.var(r.head[1]) or any(A.var(a[1]) for a in r.body) for r in rules):
        return None
    heads, name = {r.head[1] for r in rules}, lambda p, end: f"{MAGIC}{end}:{p}"
    todo, seen, out = [(goal[1], bound)], set(), []
    while todo:
        p, end = todo.pop()
        if (p, end) in seen:
            continue
        seen.add((p, end))
        for r in [r for r in rules if r.head[1] == p]:
            start = r.head[0 if end == "s" else 2]
            ask = (start, name(p, end), start)
            out.append(Rule(r.head, [ask, *r.body], [], r.guard, r.binds, r.weight))
            known, before, rest = _vars(start), [ask], list(r.body)
            while rest:  # sideways: an atom with a known end, once asked, makes its other end known
                atom = next((a for a in rest if (_vars(a[0], a[2]) & known) or not A.var(a[0]) or not A.var(a[2])), None)
                if atom is None:
                    return None
                rest.remove(atom)
                if atom[1] in heads:
                    side = "s" if not A.var(atom[0]) or A.var(atom[0]) in known else "o"
                    x = atom[0 if side == "s" else 2]
                    if (x, name(atom[1], side), x) != ask:
                        out.append(Rule((x, name(atom[1], side), x), list(before)))
                    todo.append((atom[1], side))
                known |= _vars(atom[0], atom[2])
                before.append(atom)
    constant = goal[0 if bound == "s" else 2]
    return out, (constant, name(goal[1], bound), constant)


def ask_goal(quads: DataFrame, rules: list, goal: Atom) -> DataFrame:
    """Solutions of one pattern: only rules and facts that it depends on are looked at, and with a constant in it only what is asked for is derived."""
    need = relevant(rules, goal)
    names = {_predicate(goal)} | {_predicate(a) for r in need for a in _needs(r)}
    facts = quads if "*" in names else quads.filter(F.col("p").isin(sorted(names)))
    if need and (asked := magic(need, goal)) is not None:
        need, (s, p, o) = asked
        seed = quads.sparkSession.range(1).select(A.constant(s).alias("s"), F.lit(p).alias("p"), A.constant(o).alias("o"), F.lit("").alias("g"))
        facts = facts.select(QUAD).unionByName(seed)
    return A.match(infer(facts, need), goal, "").distinct()


def violations(quads: DataFrame, body: list[Atom], negative: list[Atom] | None = None, guard: Callable[[], Column] | None = None) -> DataFrame:
    """Solutions of an integrity constraint's body."""
    return _solutions(Rule(("?_", "", "?_"), body, negative or [], guard), None, quads)


def well_founded(quads: DataFrame, rules: list[Rule]) -> DataFrame:
    """(quad, truth): ``certain`` and ``unknown`` facts by the alternating fixpoint; what is in neither is false."""
    base = quads.select(QUAD)
    folder, k = shared_dir(quads.sparkSession), 0

    def model(against: DataFrame) -> DataFrame:
        return infer(base, [Rule(r.head, r.body, r.negative, r.guard, r.binds) for r in rules], None, against)

    under, before = base, -1
    while True:
        k += 1
        over = model(under)
        under = stored(model(over), f"{folder}/{k}")
        n = under.count()
        if n == before:
            unknown = over.join(under, QUAD, "left_anti")
            return under.withColumn("truth", F.lit("certain")).unionByName(unknown.select(QUAD).withColumn("truth", F.lit("unknown")))
        before = n


def lattice(seed: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str], merge: Callable[[], Column], value: str = "value", max_rounds: int = 1000) -> DataFrame:
    """Monotone fixpoint: rows of ``seed`` and of ``step(changed rows)``, one value a key, merged by ``merge`` (min, max, union)."""
    folder = shared_dir(seed.sparkSession)
    best = changed = stored(seed.groupBy(*key).agg(merge().alias(value)), f"{folder}/0")
    for k in range(1, max_rounds + 1):
        both = best.withColumn("_old", F.lit(True)).unionByName(step(changed).select(*key, value).withColumn("_old", F.lit(False)))
        was = F.max(F.when(F.col("_old"), F.col(value)))
        new = stored(both.groupBy(*key).agg(merge().alias(value), was.alias("_was")), f"{folder}/{k}")
        changed = new.filter(F.col("_was").isNull() | (F.col("_was") != F.col(value))).select(*key, value)
        best = new.select(*key, value)
        if changed.isEmpty():
            return best
    raise RuntimeError("no fixpoint within max_rounds")


def retracted(base: DataFrame, gone: DataFrame, rules: list[Rule]) -> DataFrame:
    """The closure after a deletion: derived facts that could rest on a deleted one are taken out, and those of them that still follow
    from the rest are put back, so nothing else is derived again."""
    spark, folder = base.sparkSession, shared_dir(base.sparkSession)
    heads = {_head(r) for r in rules}
    mine = derived(base, rules)
    full = base.select(QUAD).unionByName(mine)
    kept_base = base.select(QUAD).join(gone.select(QUAD), QUAD, "left_anti")

    def reached(first: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame | None], within: DataFrame, tag: str) -> DataFrame:
        """Facts of ``within`` that ``first`` and then the new ones lead to."""
        delta, paths = stored(first.dropDuplicates(QUAD).join(within, QUAD, "left_semi").select(QUAD), f"{folder}/{tag}-0"), [f"{folder}/{tag}-0"]
        while not delta.isEmpty():
            known = spark.read.schema(delta.schema).parquet(*paths)
            more = step(delta, known)
            if more is None:
                break
            paths.append(f"{folder}/{tag}-{len(paths)}")
            delta = stored(more.dropDuplicates(QUAD).join(known, QUAD, "left_anti").join(within, QUAD, "left_semi").select(QUAD), paths[-1])
        return spark.read.schema(delta.schema).parquet(*paths)

    first = _consequences(rules, stored(gone.select(QUAD), f"{folder}/gone"), full)
    lost = reached(first, lambda new, _: _consequences(rules, new, full, heads=heads), mine, "lost")
    rest = kept_base.unionByName(mine.join(lost, QUAD, "left_anti").select(QUAD))
    back = reached(_consequences(rules, None, rest), lambda new, known: _consequences(rules, new, rest.unionByName(known), heads=heads), lost.unionByName(_of(gone.select(QUAD), heads)), "back")
    return rest.unionByName(back.join(kept_base, QUAD, "left_anti").select(QUAD))


def extended(closure: DataFrame, added: DataFrame, rules: list[Rule]) -> DataFrame:
    """What follows anew when facts are added to a closed graph: rounds start from the added facts alone. Positive rules only."""
    spark, folder = closure.sparkSession, shared_dir(closure.sparkSession)
    heads, base = {_head(r) for r in rules}, closure.select(QUAD)
    fresh = stored(added.select(QUAD).dropDuplicates(QUAD).join(base, QUAD, "left_anti").select(QUAD), f"{folder}/0")
    delta, paths = fresh, [f"{folder}/0"]
    while not delta.isEmpty():
        known = base.unionByName(spark.read.schema(delta.schema).parquet(*paths))
        more = _consequences(rules, delta, known)
        paths.append(f"{folder}/{len(paths)}")
        delta = stored(more.dropDuplicates(QUAD).join(_of(known, heads), QUAD, "left_anti").select(QUAD), paths[-1])
    return spark.read.schema(delta.schema).parquet(*paths[1:]) if len(paths) > 1 else fresh.limit(0)


def conflicts(quads: DataFrame, rules: list, exclusive: list[tuple[str, str]]) -> DataFrame:
    """(s, o, p, q): pairs that a closure holds under two predicates of which only one may hold, at least one of them derived."""
    mine = derived(quads, rules).withColumn("new", F.lit(True))
    full = quads.select(QUAD).withColumn("new", F.lit(False)).unionByName(mine)
    parts = []
    for p, q in exclusive:
        a, b = (full.filter(F.col("p") == x).select("s", "o", F.col("new").alias(n)) for x, n in ((p, "n1"), (q, "n2")))
        parts.append(a.join(b, ["s", "o"]).filter("n1 OR n2").select("s", "o", F.lit(p).alias("p"), F.lit(q).alias("q")).distinct())
    return reduce(DataFrame.unionByName, parts)


def hypothetical(base: DataFrame, rules: list, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """(quad, change): what would follow, or no longer follow, from other facts."""
    other = base.select(QUAD) if remove is None else base.select(QUAD).join(remove.select(QUAD), QUAD, "left_anti")
    other = other if add is None else other.unionByName(add.select(QUAD)).distinct()
    a, b = infer(base, rules), infer(other, rules)
    return b.join(a, QUAD, "left_anti").select(QUAD).withColumn("change", F.lit("gained")).unionByName(a.join(b, QUAD, "left_anti").select(QUAD).withColumn("change", F.lit("lost")))


def weighted(quads: DataFrame, confidence: DataFrame, rules: list[Rule]) -> DataFrame:
    """(s, p, o, confidence) of the heads of non-recursive rules: the product of the body's confidences and the rule's weight,
    several derivations by noisy-or. ``confidence`` (s, p, o, confidence); a statement without one is certain."""
    best = confidence.groupBy("s", "p", "o").agg(F.max("confidence").alias("c"))
    known = quads.join(best, ["s", "p", "o"], "left").withColumn("c", F.coalesce("c", F.lit(1.0)))
    parts = []
    for r in rules:
        rows = None
        for k, (s, p, o) in enumerate(r.body):
            m = known.filter((F.col("p") == p) & (F.col("g") == ""))
            cols = [F.col(x).alias(A.var(t)) for x, t in (("s", s), ("o", o)) if A.var(t)]
            for x, t in (("s", s), ("o", o)):
                if not A.var(t):
                    m = m.filter(F.col(x) == A.constant(t))
            m = m.select(*cols, F.col("c").alias(f"_c{k}"))
            rows = m if rows is None else A.join(rows, m)
        c = reduce(lambda a, b: a * b, [F.col(f"_c{k}") for k in range(len(r.body))]) * r.weight
        part = lambda t: F.col(A.var(t)) if A.var(t) else A.constant(t)
        parts.append(rows.select(part(r.head[0]).alias("s"), F.lit(r.head[1]).alias("p"), part(r.head[2]).alias("o"), c.alias("c")))
    return reduce(DataFrame.unionByName, parts).groupBy("s", "p", "o").agg(noisy_or(F.col("c")).alias("confidence"))


def proof(quads: DataFrame, rules: list[Rule], goals: DataFrame, depth: int = 100) -> DataFrame:
    """(depth, rule, head_s, head_p, head_o, facts): the proof steps of the goals (head_s, head_p, head_o in N-Triples) and of all facts that these
    rest on, each fact at the least depth at which it is met; a fact without a step is given."""
    steps = stored(derivations(quads, rules), f"{shared_dir(quads.sparkSession)}/steps")
    key = ["head_s", "head_p", "head_o"]
    part = r"^(<<.*>>|<[^<>]*>|_:\S+) (<[^<>]*>) (.*)$"
    seed = goals.select(*key).distinct().withColumn("depth", F.lit(0))

    def down(new: DataFrame, _: DataFrame) -> DataFrame:
        fact = new.join(steps, key).select(F.explode("facts").alias("f"), (F.col("depth") + 1).alias("depth"))
        return fact.select(*[F.regexp_extract("f", part, i + 1).alias(k) for i, k in enumerate(key)], "depth")

    return fixpoint(seed, down, key, depth).join(steps, key).select("depth", "rule", *key, "facts")


def derivations(quads: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, head_s, head_p, head_o, facts): each way in which a closure's fact follows in one step, with the body's facts in N-Triples."""
    from ..terms import ntriples

    full, parts = infer(quads, rules), []
    text = lambda t: ntriples(F.col(A.var(t)) if A.var(t) else A.constant(t))
    for k, r in enumerate(rules):
        rows = _solutions(r, None, full)
        name = lambda t: text(t) if A.var(t) else F.lit(f"<{t}>")
        facts = [F.concat_ws(" ", text(s), name(p), text(o)) for s, p, o in r.body]
        parts.append(rows.select(F.lit(k).alias("rule"), text(r.head[0]).alias("head_s"), name(r.head[1]).alias("head_p"), text(r.head[2]).alias("head_o"), F.array(*facts).alias("facts")))
    return reduce(DataFrame.unionByName, parts).distinct()
