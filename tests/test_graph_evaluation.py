"""Closures, levels and the ontology-wide evaluation against walks written out in Python."""

import random

import pytest
from pyspark.sql import functions as F

from annoweave.operators import climb, evaluation, graph


def edges_of(spark, pairs):
    """Edges child to parent."""
    return spark.createDataFrame([(c, p, "is_a") for c, p in pairs], "child string, parent string, relation_type string")


def random_dag(n, seed, parents=3):
    random.seed(seed)
    return [(f"t{i:03d}", f"t{j:03d}") for i in range(1, n) for j in random.sample(range(i), min(i, random.randint(1, parents)))]


def ancestors_of(pairs):
    up = {}
    for c, p in pairs:
        up.setdefault(c, set()).add(p)
    found = {}

    def walk(t):
        if t not in found:
            found[t] = set()
            for p in up.get(t, ()):
                found[t] |= {p} | walk(p)
        return found[t]

    for c, p in pairs:
        walk(c), walk(p)
    return found


def test_closure_of_a_random_graph_and_of_its_halves(spark):
    pairs = random_dag(300, 1)
    want = {(a, t) for t, own in ancestors_of(pairs).items() for a in own}
    assert {tuple(r) for r in graph.descendants(edges_of(spark, pairs)).collect()} == want
    random.shuffle(pairs)
    half = graph.descendants(edges_of(spark, pairs[:200]))
    got = [tuple(r) for r in graph.extend_descendants(half, edges_of(spark, pairs[200:])).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_closure_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """A chain of 60 steps: six rounds find all pairs."""
    calls = []
    own = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: calls.append(1) or own(df))
    assert graph.descendants(edges_of(spark, [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)])).count() == 60 * 61 // 2
    assert len(calls) <= 4 + 6


def test_closure_of_cycles_extended(spark):
    first = graph.descendants(edges_of(spark, [("a", "b"), ("c", "d")]))
    got = {tuple(r) for r in graph.extend_descendants(first, edges_of(spark, [("b", "c"), ("d", "a")])).collect()}
    assert got == {(x, y) for x in "abcd" for y in "abcd"}


def test_closure_extended_by_lists(spark, monkeypatch):
    """Added edges with new terms, one that closes a cycle and some above untouched terms: lists are handed on, pairs are never joined with pairs."""
    old = [(f"n{i:03d}", f"n{i // 2:03d}") for i in range(2, 64)] + [("a", "b"), ("b", "c")]
    new = [(f"n{i:03d}", f"n{i // 3:03d}") for i in range(6, 64, 5)] + [("c", "a"), ("n001", "top"), ("new", "n040")]
    want = {tuple(r) for r in graph.descendants(edges_of(spark, old + new)).collect()}
    handed, own = [], graph.inherited
    monkeypatch.setattr(graph, "inherited", lambda core, layers, rows: handed.append(len(layers)) or own(core, layers, rows))
    got = [tuple(r) for r in graph.extend_descendants(graph.closed(edges_of(spark, old)), edges_of(spark, new)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and handed and handed[0] >= 3


def test_levels(spark):
    found = {(r.child, r.parent): (r.level, r.parent_level) for r in graph.leveled(edges_of(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("d", "c"), ("c", "e")])).collect()}
    assert found == {("a", "b"): (0, 1), ("b", "c"): (1, 2), ("a", "c"): (0, 2), ("d", "c"): (0, 2), ("c", "e"): (2, 3)}
    assert graph.leveled(edges_of(spark, [])).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        graph.leveled(edges_of(spark, [("x", "a"), ("a", "b"), ("b", "a")]))


def test_edges_within_an_aspect(spark):
    terms = spark.createDataFrame([("a", "P"), ("b", "P"), ("c", "F"), ("d", None)], "go_id string, aspect string")
    assert [tuple(r)[:2] for r in graph.within_aspect(edges_of(spark, [("a", "b"), ("a", "c"), ("a", "d"), ("d", "x")]), terms).collect()] == [("a", "b")]


def scores(spark, rows):
    return spark.createDataFrame(rows, "protein string, go_id string, score double")


def weights(spark, rows=()):
    return spark.createDataFrame(list(rows), "go_id string, ia double")


def terms_of(spark, rows):
    return spark.createDataFrame(rows, "go_id string, aspect string")


def test_siblings_share_their_ancestors(spark):
    """Truth C1, prediction C2, both below A below ROOT: two of three terms are shared."""
    edges = graph.leveled(edges_of(spark, [("C1", "A"), ("C2", "A"), ("A", "ROOT")]))
    terms = terms_of(spark, [(t, "P") for t in ("C1", "C2", "A", "ROOT")])
    truth = spark.createDataFrame([("p", "C1")], "protein string, go_id string")
    own = scores(spark, [("p", "C2", 0.9)])
    got = evaluation.fmax_weighted(own, truth, weights(spark), terms, edges).first()
    assert (got.fmax, got.precision, got.recall, got.tau, got.coverage) == (0.6667, 0.6667, 0.6667, 0.01, 1.0)
    without = evaluation.fmax_weighted(own, truth, weights(spark), terms, edges, roots=spark.createDataFrame([("ROOT",)], "go_id string")).first()
    assert without.fmax == 0.5
    known = spark.createDataFrame([("p", "A")], "protein string, go_id string")
    assert evaluation.fmax_weighted(own, truth, weights(spark), terms, edges, known).first().fmax == 0.5
    assert evaluation.fmax_weighted(own, truth, weights(spark, [("ROOT", 0.0), ("A", 3.0)]), terms, edges).first().fmax == 0.75
    assert evaluation.fmax_weighted(own, truth, weights(spark), terms).first().fmax == 0.0


def brute_curve(predicted, truth, up, ia, aspects, known):
    """All thresholds, all proteins, all terms."""
    lifted, true = {}, {}
    for p, t, s in predicted:
        for x in {t} | up.get(t, set()):
            lifted[p, x] = max(s, lifted.get((p, x), 0))
    for p, t in truth:
        true.setdefault(p, set()).update({t} | up.get(t, set()))
    out = {}
    for aspect in sorted(set(aspects.values())):
        mine = {p: {t for t in own if aspects.get(t) == aspect and (p, t) not in known} for p, own in true.items()}
        mine = {p: own for p, own in mine.items() if own}
        for i in range(1, 101):
            precision, recall, covered = [], [], 0
            for p, own in mine.items():
                said = {t for (q, t), s in lifted.items() if q == p and s >= i * 0.01 and aspects.get(t) == aspect and (p, t) not in known}
                right = sum(ia.get(t, 1.0) for t in sorted(said & own))
                total = sum(ia.get(t, 1.0) for t in sorted(own))
                recall.append(right / total if total else 0.0)
                if said:
                    covered += 1
                    w = sum(ia.get(t, 1.0) for t in sorted(said))
                    precision.append(right / w if w else 0.0)
            if mine:
                out[aspect, round(i * 0.01, 2)] = (sum(precision) / covered if covered else 0.0, sum(recall) / len(mine), covered / len(mine), len(mine))
    return out


def test_weighted_curve_on_a_random_graph(spark):
    """500 terms of two aspects, some unknown: all 100 thresholds agree with a walk."""
    pairs = [*random_dag(250, 5), *[(c.replace("t", "u"), p.replace("t", "u")) for c, p in random_dag(250, 6)], ("t100", "u005")]
    aspects = {f"t{i:03d}": "P" for i in range(250)} | {f"u{i:03d}": "F" for i in range(250)}
    random.seed(9)
    ia = {t: random.choice([0.0, 0.5, 2.0, 3.25]) for t in aspects if random.random() < 0.8}
    pick = [*aspects, "unknown"]
    truth = [(f"p{i % 30}", random.choice(pick)) for i in range(90)]
    predicted = [(f"p{random.randrange(40)}", random.choice(pick), random.choice([0.0, 0.01, 0.29, 0.57, 1.0, random.random()])) for _ in range(300)]
    known = {(f"p{random.randrange(30)}", random.choice(pick)) for _ in range(400)}
    terms = terms_of(spark, list(aspects.items()))
    edges = graph.leveled(graph.within_aspect(edges_of(spark, pairs), terms))
    got = evaluation.weighted_curve(scores(spark, predicted), spark.createDataFrame(truth, "protein string, go_id string"), weights(spark, ia.items()), terms, edges, spark.createDataFrame(sorted(known), "protein string, go_id string"))
    want = brute_curve(predicted, truth, ancestors_of([e for e in pairs if e[0][0] == e[1][0]]), ia, aspects, known)
    found = {(r.aspect, r.tau): (r.precision, r.recall, r.coverage, r.n_proteins) for r in got.collect()}
    assert found.keys() == want.keys()
    assert len(found) == 200
    for key, row in found.items():
        assert row == pytest.approx(want[key], abs=1e-9)


def test_groups_are_judged_as_if_alone(spark):
    edges = graph.leveled(edges_of(spark, random_dag(60, 3)))
    terms = terms_of(spark, [(f"t{i:03d}", "P") for i in range(60)])
    random.seed(4)
    truth = spark.createDataFrame([(random.choice(["NK", "PK"]), f"p{i % 9}", f"t{random.randrange(60):03d}") for i in range(40)], "category string, protein string, go_id string").distinct()
    own = scores(spark, [(f"p{random.randrange(12)}", f"t{random.randrange(60):03d}", random.random()) for _ in range(80)])
    known = spark.createDataFrame([("PK", f"p{i}", f"t{i:03d}") for i in range(9)], "category string, protein string, go_id string")
    together = {r.category: tuple(r)[1:] for r in evaluation.fmax_weighted(own, truth, weights(spark), terms, edges, known, by=("category",)).collect()}
    for category in ("NK", "PK"):
        alone = evaluation.fmax_weighted(own, truth.filter(F.col("category") == category).drop("category"), weights(spark), terms, edges, known.filter(F.col("category") == category).drop("category"))
        assert together[category] == tuple(alone.first())


def test_propagation_keeps_unknown_terms_and_the_best_score(spark):
    edges = graph.leveled(edges_of(spark, [("a", "b"), ("b", "c"), ("x", "c")]))
    got = {tuple(r) for r in graph.propagate_max(scores(spark, [("p", "a", 0.2), ("p", "a", 0.3), ("p", "b", 0.1), ("p", "z", 0.5), ("q", "x", 1.0), ("q", "c", 0.4)]), edges).collect()}
    assert got == {("p", "a", 0.3), ("p", "b", 0.3), ("p", "c", 0.3), ("p", "z", 0.5), ("q", "x", 1.0), ("q", "c", 1.0)}
    truth = spark.createDataFrame([("p", "a"), ("q", "z")], "protein string, go_id string")
    assert {tuple(r) for r in graph.propagate_truth(truth, edges).collect()} == {("p", "a"), ("p", "b"), ("p", "c"), ("q", "z")}
    assert graph.propagate_max(scores(spark, []), edges).count() == 0


def test_closure_by_layers_above_a_core(spark):
    """A bushy graph below a cycle and a chain: leaves are peeled in layers, cycle and chain stay in the core."""
    pairs = [(f"n{i:03d}", f"n{i // 2:03d}") for i in range(2, 200)] + [(f"n{i:03d}", f"n{i // 3:03d}") for i in range(6, 200)] + [("n001", "x"), ("x", "y"), ("y", "x")] + [(f"k{i}", f"k{i + 1}") for i in range(9)] + [("y", "k0")]
    up = {}
    for c, p in pairs:
        up.setdefault(c, set()).add(p)
    want = set()
    for t in {x for pair in pairs for x in pair}:
        reached, todo = set(), list(up.get(t, ()))
        while todo:
            if (a := todo.pop()) not in reached:
                reached.add(a)
                todo += up.get(a, ())
        want |= {(a, t) for a in reached}
    steps = graph.steps_of(edges_of(spark, pairs), graph.CLOSURE_RELATIONS)
    core, layers = graph.peeled(graph.numbered(steps)[0])
    assert layers and core.count() >= 12
    got = [tuple(r) for r in graph.descendants(edges_of(spark, pairs)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_ruled_out_without_descendants_is_what_negative_keys_leave(spark):
    random.seed(5)
    edges = edges_of(spark, random_dag(80, 4))
    lines = [(f"p{random.randrange(12)}", f"t{random.randrange(84):03d}", "NOT|involved_in" if random.random() < 0.1 else None) for _ in range(600)]
    annotations = spark.createDataFrame(lines, "protein string, go_id string, qualifier string")
    pairs = annotations.select("protein", "go_id").distinct()
    want = {tuple(r) for r in pairs.join(graph.negative_keys(annotations, edges), ["protein", "go_id"], "left_semi").collect()}
    got = [tuple(r) for r in graph.ruled_out(pairs, annotations, graph.closed(edges)).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_weighted_curve_hands_no_row_up_level_by_level(spark, monkeypatch):
    """Rows meet the lists of their terms once: nothing is propagated and kept for every level."""
    monkeypatch.setattr(graph, "propagate", None)
    terms = spark.createDataFrame([(t, "F") for t in ("C1", "C2", "A")], "go_id string, aspect string")
    edges = graph.leveled(edges_of(spark, [("C1", "A"), ("C2", "A")]))
    scored = spark.createDataFrame([("p", "C2", 0.9)], "protein string, go_id string, score double")
    truth = spark.createDataFrame([("p", "C1")], "protein string, go_id string")
    weights = spark.createDataFrame([], "go_id string, ia double")
    assert evaluation.fmax_weighted(scored, truth, weights, terms, edges).first()["fmax"] == 0.5


def test_pairs_are_ruled_out_since_the_first_negation(spark):
    """D below B and C, both below A: the least release among negations of a term and of those above it; a term's own negation counts too."""
    edges = spark.createDataFrame([("B", "A", "is_a"), ("C", "A", "is_a"), ("D", "B", "is_a"), ("D", "C", "part_of")], "child string, parent string, relation_type string")
    lines = [("P", "B", "NOT", 2), ("P", "C", "NOT", 1), ("P", "D", None, 0), ("Q", "A", "NOT", 3), ("Q", "D", "NOT", 2), ("Q", "A", "NOT", 1), ("R", "D", None, 0)]
    annotations = spark.createDataFrame(lines, "protein string, go_id string, qualifier string, since int")
    pairs = spark.createDataFrame([(p, t) for p in "PQR" for t in "ABCD"], "protein string, go_id string")
    got = sorted(tuple(r) for r in graph.ruled_out(pairs, annotations, graph.closed(edges), "since").collect())
    assert got == [("P", "B", 2), ("P", "C", 1), ("P", "D", 1), ("Q", "A", 1), ("Q", "B", 1), ("Q", "C", 1), ("Q", "D", 1)]


def test_negations_are_handed_down_as_lists(spark, monkeypatch):
    """No list of ancestors is made or made into rows for them, and marks beyond the bound are worked on in shares."""
    monkeypatch.setattr(graph, "ancestor_lists", None)
    monkeypatch.setattr(graph, "MARKS", 2)
    edges = edges_of(spark, [("B", "A"), ("C", "B"), ("D", "C"), ("C", "D")])
    annotations = spark.createDataFrame([(p, "A", "NOT") for p in "PQRST"] + [("P", "X", "NOT"), ("U", "D", "NOT")], "protein string, go_id string, qualifier string")
    pairs = spark.createDataFrame([(p, t) for p in "PQRSTUV" for t in "ABCDX"] * 2, "protein string, go_id string")
    got = sorted(tuple(r) for r in graph.ruled_out(pairs, annotations, graph.closed(edges)).collect())
    assert got == sorted([(p, t) for p in "PQRST" for t in "ABCD"] + [("P", "X"), ("U", "C"), ("U", "D")])


def test_what_a_protein_negates_does_not_travel_with_its_pairs(spark):
    """The plan holds no set of a protein's negated terms, so rows stay short however many there are."""
    edges = spark.createDataFrame([("B", "A", "is_a")], "child string, parent string, relation_type string")
    annotations = spark.createDataFrame([("P", "A", "NOT")], "protein string, go_id string, qualifier string")
    out = graph.ruled_out(spark.createDataFrame([("P", "B")], "protein string, go_id string"), annotations, graph.closed(edges))
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [("P", "B")]


def climbing(spark, monkeypatch, rows):
    """Pairs of a random graph and scores of proteins, dealt to shares and carried up by few rows and keys at a time."""
    monkeypatch.setattr(climb, "FEW_ROWS", rows)
    monkeypatch.setattr(climb, "ROWS", rows)
    monkeypatch.setattr(climb, "KEYS", 3)
    monkeypatch.setattr(climb, "BLOCK", 16)
    pairs = random_dag(120, 3)
    random.seed(4)
    names = [*{t for e in pairs for t in e}, "unknown"]
    return pairs, [(f"p{random.randrange(25)}", random.choice(names), random.choice([0.0, 0.01, 0.5, random.random()])) for _ in range(300)]


def test_weighted_rows_go_without_lists(spark, monkeypatch):
    """Tasks hold the graph: no list of the terms above a term is made or moved with rows, whatever the shares; larger graphs give the same by lists."""
    pairs, predicted = climbing(spark, monkeypatch, 40)
    terms = terms_of(spark, [(t, "PF"[int(t[1:]) % 2]) for t in sorted({t for e in pairs for t in e})])
    edges = graph.closing(edges_of(spark, pairs))
    own = spark.createDataFrame([(p, t, ("NK", "PK")[int(p[1:]) % 2]) for p, t, _ in predicted[:90]], "protein string, go_id string, category string")
    known = spark.createDataFrame([(p, t, "PK") for p, t, _ in predicted[200:]], "protein string, go_id string, category string")

    def curve():
        got = evaluation.weighted_curve(scores(spark, predicted), own, weights(spark, [("t003", 2.5), ("t010", 0.0)]), terms, edges, known, by=("category",))
        return {(r.category, r.aspect, r.tau): tuple(r)[3:] for r in got.collect()}

    with monkeypatch.context() as m:
        m.setattr(graph, "carried_up", None)
        held = curve()
    monkeypatch.setattr(climb, "HELD", 0)
    lists = curve()
    assert held and held.keys() == lists.keys()
    for key, row in held.items():
        assert row == pytest.approx(lists[key], abs=1e-9)


def test_scores_go_up_in_one_pass(spark, monkeypatch):
    """No checkpoint a level: tasks hold the graph. Null scores, unknown terms and keys of many rows keep their place; a cycle is an error."""
    pairs, predicted = climbing(spark, monkeypatch, 40)
    predicted += [("p1", "t119", None), ("lone", "t100", None), ("lone", "unknown", None), (None, "t100", 0.7)] + [("many", f"t{i:03d}", i / 120) for i in range(120)]
    edges, up = graph.closing(edges_of(spark, pairs)), ancestors_of(pairs)
    want = {}
    for p, t, s in predicted:
        for x in {t} | up.get(t, set()):
            best = want.get((p, x))
            want[p, x] = best if s is None else s if best is None else max(s, best)
    with monkeypatch.context() as m:
        m.setattr(graph, "checkpointed", None)
        found = [tuple(r) for r in graph.propagate_max(scores(spark, predicted), edges).collect()]
    assert len(found) == len(want) and {(p, t): s for p, t, s in found} == want
    monkeypatch.setattr(climb, "HELD", 0)
    assert {(p, t): s for p, t, s in map(tuple, graph.propagate_max(scores(spark, predicted), graph.leveled(edges)).collect())} == want
    monkeypatch.setattr(climb, "HELD", 1 << 20)
    with pytest.raises(Exception, match="on or above a cycle"):
        graph.propagate_max(scores(spark, [("p", "a", 0.5)]), edges_of(spark, [("a", "b"), ("b", "c"), ("c", "b")])).collect()
