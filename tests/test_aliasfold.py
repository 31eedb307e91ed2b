"""The ordered alias pass against asking all pairs again after each merge, and cases worked out by hand."""

from __future__ import annotations

import copy
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import aliasfold, runs

ENT = "doc_id string, entity_id string, pos long, canonical_name string, entity_type string, aliases array<string>, citations array<struct<start_char:int,end_char:int,quote:string,match:string>>"


def _plain(entities, terms, key, formal):
    """(entities, counters) by the rules as they are said."""
    ents = [dict(e) for e in entities]
    count = dict.fromkeys(aliasfold.STATISTICS, 0)

    def fits(a, b, more=False):
        kinds = {a["kind"], b["kind"]}
        return len(kinds) == 1 or "other" in kinds or (more and kinds == {"person", "company"})

    def merge(keep, drop):
        first = max([keep["names"][0], drop["names"][0]], key=lambda n: (formal[n], len(n)))
        if keep["kind"] == "other":
            keep["kind"] = drop["kind"]
        elif formal[first] and {keep["kind"], drop["kind"]} == {"person", "company"}:
            keep["kind"] = "company"
        keep["names"] = [first, *(n for n in dict.fromkeys([*keep["names"][1:], *drop["names"][1:], keep["names"][0], drop["names"][0]]) if n != first)]
        keep["cites"] = keep["cites"] + [c for c in drop["cites"] if c not in [x for x in keep["cites"] if x[1] > x[0]]]
        ents.remove(drop)

    for name, alias in terms:
        k = key[name]
        exact = [e for e in ents if k in [key[n] for n in e["names"]]]
        inside = [e for e in ents if len(key[e["names"][0]]) >= 4 and key[e["names"][0]] in k]
        own = exact[0] if exact else max(inside, key=lambda e: len(e["names"][0]), default=None)
        if own is None:
            continue
        count["defined_terms"] += 1
        same = [e for e in ents if e is not own and key[e["names"][0]] == key[alias]]
        other = next((e for e in same if fits(own, e)), None)
        if other is not None:
            merge(own, other)
            count["merged_defined"] += 1
        elif alias not in own["names"] and not same:
            own["names"].append(alias)
            count["aliases_added"] += 1
    while True:
        pair = next(((a, b) for i, a in enumerate(ents) for b in ents[i + 1 :] if fits(a, b, True) and (key[a["names"][0]] in {key[n] for n in b["names"]} or key[b["names"][0]] in {key[n] for n in a["names"]})), None)
        if pair is None:
            return ents, count
        a, b = pair
        merge(*((a, b) if len(a["cites"]) >= len(b["cites"]) else (b, a)))
        count["merged_same_name"] += 1


def test_fold_equals_asking_all_pairs():
    words = ["alpha", "alphabet", "beta", "beta gmbh", "gamma ag", "gamma", "delta", "al"]
    key = {w: w.removesuffix(" gmbh").removesuffix(" ag") for w in words} | {w.upper(): w.removesuffix(" gmbh").removesuffix(" ag") for w in words}
    formal = {w: w.lower().endswith((" gmbh", " ag")) for w in key}
    for seed in range(400):
        rng = random.Random(seed)
        names = list(key)
        entities = [{"id": f"E{i}", "kind": rng.choice(["person", "company", "asset", "other"]), "names": list(dict.fromkeys(rng.choices(names, k=rng.randint(1, 3)))), "cites": [(0, 0) if rng.random() < 0.3 else (s := rng.randint(0, 4), s + 2) for _ in range(rng.randint(0, 3))]} for i in range(rng.randint(0, 9))]
        terms = [(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(0, 4))]
        want, count = _plain(copy.deepcopy(entities), terms, key, formal)
        fold = aliasfold.Fold([aliasfold.Entity(e["id"], e["kind"], list(e["names"]), [{"start_char": a, "end_char": b} for a, b in e["cites"]]) for e in entities], key, formal)
        for name, alias in terms:
            fold.define(key[name], alias)
        fold.settle()
        got = [(e.id, e.kind, e.names, [(c["start_char"], c["end_char"]) for c in e.citations]) for e in fold.ents if e is not None]
        assert got == [(e["id"], e["kind"], e["names"], e["cites"]) for e in want] and fold.stats == count


def _entities(spark, rows):
    return spark.createDataFrame([("d", i, p, n, t, list(a), [(s, s + 1, "q", "verbatim") for s in range(c)]) for p, (i, n, t, a, c) in enumerate(rows)], ENT)


def test_definitions_and_owned_names(spark):
    text = 'Aurora Holdings GmbH (hereinafter "AH") leases to Borealis Ltd (the "Tenant", formerly Polaris). Aurora Holdings GmbH (hereinafter "Zeta").'
    ents = _entities(spark, [("E1", "Aurora Holdings GmbH", "company", [], 1), ("E2", "AH", "other", ["A.H."], 3), ("E3", "Zeta AG", "asset", [], 1), ("E4", "Aurora Holdings", "person", [], 2)])
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    got = {r.entity_id: r for r in aliasfold.alias_fold(ents, docs).collect()}
    assert set(got) == {"E1", "E3"} and got["E3"].aliases == []
    one = got["E1"]  # took E2 in by its definition, and so has more citations than E4
    assert (one.canonical_name, one.entity_type, one.members) == ("Aurora Holdings GmbH", "company", ["E1", "E2", "E4"])
    assert set(one.aliases) == {"AH", "A.H.", "Aurora Holdings"} and len(one.citations) == 3
    assert (one.defined_terms, one.aliases_added, one.merged_defined, one.merged_same_name) == (2, 0, 1, 1)


@pytest.mark.parametrize(("first", "second", "kept"), [(1, 2, "E2"), (2, 2, "E1"), (2, 1, "E1")])
def test_more_citations_stay_and_the_earlier_of_equals(spark, first, second, kept):
    ents = _entities(spark, [("E1", "Acme", "company", [], first), ("E2", "Acme", "other", [], second), ("E3", "Acme", "agreement", [], 9)])
    docs = spark.createDataFrame([("d", None)], "doc_id string, text string")
    got = {r.entity_id: r.entity_type for r in aliasfold.alias_fold(ents, docs).collect()}
    assert got == {kept: "company", "E3": "agreement"}


def test_runs_can_settle_in_order(spark):
    ents = _entities(spark, [("E1", "Acme", "company", [], 1), ("E2", "ACME", "other", [], 2), ("E3", "Bolt", "person", [], 1)])
    docs = spark.createDataFrame([("d", "Acme and Bolt")], "doc_id string, text string")
    rels = spark.createDataFrame([("d", p, s, t, "controls", 0, 0, "", "unanchored") for p, (s, t) in enumerate([("E1", "E3"), ("E2", "E3"), ("E1", "E2")])], "doc_id string, pos long, source string, target string, relation string, start_char int, end_char int, quote string, match string")
    entities, relations, stats = runs.settle_in_order(ents, rels, docs)
    assert {r.entity_id for r in entities.collect()} == {"E2", "E3"}
    assert [(r.source, r.target, r.pos) for r in relations.collect()] == [("E2", "E3", 0)]
    assert stats.select(F.struct(*aliasfold.STATISTICS)).first()[0] == (0, 0, 0, 1)
