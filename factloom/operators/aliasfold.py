"""The order-dependent alias pass: definitions applied one by one, then entities of equal names merged to a fixpoint.

A definition's long name has an owner: the first entity with that key, else the one with the longest name inside it.  Another
entity named like the alias, of a compatible type, merges into the owner; else the owner takes the alias, unless another
entity has that name.  Then, again and again, the first pair of entities in order whose names meet merges into the one
with more citations, the earlier if both have as many.  The first pair comes from indexes of keys and a queue of entities
whose pairs may have changed, not from asking all pairs anew.
"""

from __future__ import annotations

import bisect
import heapq
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .grouped import map_groups
from .resolve import defined_terms

STATISTICS = ("defined_terms", "aliases_added", "merged_defined", "merged_same_name")
_CITATION = "array<struct<start_char:int,end_char:int,quote:string,match:string>>"


@dataclass
class Entity:
    """An entity of a document; ``names`` has its canonical name first, ``citations`` are dicts."""

    id: str
    kind: str
    names: list[str]
    citations: list[dict]
    members: list[str] = field(default_factory=list)


class Fold:
    """One document's entities in order; ``key`` and ``formal`` (whether a name has a legal form) are known for every name."""

    def __init__(self, entities: list[Entity], key: dict[str, str], formal: dict[str, bool]):
        self.ents: list[Entity | None] = list(entities)
        self.key, self.formal = key, formal
        self.by_form: dict[str, list[int]] = {}
        self.by_name: dict[str, list[int]] = {}
        self.stats = dict.fromkeys(STATISTICS, 0)
        for i, e in enumerate(entities):
            e.members = [e.id]
            self._index(i, e)

    def _index(self, i: int, e: Entity) -> None:
        for k in {self.key[n] for n in e.names}:
            self._put(self.by_form, k, i)
        self._put(self.by_name, self.key[e.names[0]], i)

    def _put(self, index: dict[str, list[int]], k: str, i: int) -> None:
        places = index.setdefault(k, [])
        at = bisect.bisect_left(places, i)
        if at == len(places) or places[at] != i:
            places.insert(at, i)

    def _drop(self, i: int, e: Entity) -> None:
        for k in {self.key[n] for n in e.names}:
            self.by_form[k].remove(i)
        self.by_name[self.key[e.names[0]]].remove(i)

    def owner(self, k: str) -> int | None:
        if self.by_form.get(k):
            return self.by_form[k][0]
        inside = {i for a in range(len(k)) for b in range(a + 4, len(k) + 1) for i in self.by_name.get(k[a:b], ())}
        return min(inside, key=lambda i: (-len(self.ents[i].names[0]), i), default=None)

    def merge(self, keep: int, drop: int) -> None:
        a, b = self.ents[keep], self.ents[drop]
        self._drop(keep, a)
        self._drop(drop, b)
        first = max((a.names[0], b.names[0]), key=lambda n: (self.formal[n], len(n)))
        if a.kind == "other":
            a.kind = b.kind
        elif self.formal[first] and {a.kind, b.kind} == {"person", "company"}:
            a.kind = "company"
        others = dict.fromkeys([*a.names[1:], *b.names[1:], a.names[0], b.names[0]])
        a.names = [first, *(n for n in others if n != first)]
        seen = {(c["start_char"], c["end_char"]) for c in a.citations if c["end_char"] > c["start_char"]}
        a.citations = [*a.citations, *(c for c in b.citations if (c["start_char"], c["end_char"]) not in seen)]
        a.members = [*a.members, *b.members]
        self.ents[drop] = None
        self._index(keep, a)

    def define(self, name_key: str, alias: str) -> None:
        own = self.owner(name_key)
        if own is None:
            return
        self.stats["defined_terms"] += 1
        mine = self.ents[own]
        same = [i for i in self.by_name.get(self.key[alias], ()) if i != own]
        other = next((i for i in same if mine.kind == self.ents[i].kind or "other" in (mine.kind, self.ents[i].kind)), None)
        if other is not None:
            self.merge(own, other)
            self.stats["merged_defined"] += 1
        elif alias not in mine.names and not same:
            mine.names.append(alias)
            self._put(self.by_form, self.key[alias], own)
            self.stats["aliases_added"] += 1

    def _partners(self, i: int) -> set[int]:
        """Entities whose names meet those of ``i`` and whose types allow it."""
        e = self.ents[i]
        met = set(self.by_form.get(self.key[e.names[0]], ()))
        for n in e.names:
            met |= set(self.by_name.get(self.key[n], ()))
        kinds = lambda j: {e.kind, self.ents[j].kind}
        return {j for j in met if j != i and (len(kinds(j)) == 1 or "other" in kinds(j) or kinds(j) == {"person", "company"})}

    def settle(self) -> None:
        queue = list(range(len(self.ents)))
        while queue:  # entities before the smallest queued one are the first of no pair
            i = heapq.heappop(queue)
            if self.ents[i] is None:
                continue
            j = min((x for x in self._partners(i) if x > i), default=None)
            if j is None:
                continue
            keep, drop = (i, j) if len(self.ents[i].citations) >= len(self.ents[j].citations) else (j, i)
            self.merge(keep, drop)
            self.stats["merged_same_name"] += 1
            for x in {i, keep, *(x for x in self._partners(keep) if x < keep)}:
                heapq.heappush(queue, x)


def alias_fold(entities: DataFrame, docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, entity_id, pos, canonical_name, entity_type, aliases, citations, members, and the four counters of its document).

    ``entities`` has (doc_id, entity_id, pos, canonical_name, entity_type, aliases, citations); members are the ids that an entity
    took in, its own first.  ``terms`` (doc_id, pos, name, alias) are the definitions; if None, those of the documents' texts.
    """
    terms = defined_terms(docs) if terms is None else terms
    kinds = dict(entities.dtypes)
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    keyed = lambda xs: (F.transform(xs, T.alias_key).alias("keys"), F.transform(xs, T.has_legal_form).alias("formal"))
    cites = F.transform("citations", lambda c: F.struct(c["start_char"].cast("int").alias("start_char"), c["end_char"].cast("int").alias("end_char"), c["quote"].alias("quote"), c["match"].alias("match")))
    rows = entities.select("doc_id", F.lit(0).alias("kind"), F.col("pos").cast("long").alias("pos"), "entity_id", "entity_type", names.alias("names"), *keyed(names), cites.alias("citations"))
    both = F.array("name", "alias")
    said = terms.select("doc_id", F.lit(1).alias("kind"), F.col("pos").cast("long").alias("pos"), F.lit(None).cast(kinds["entity_id"]).alias("entity_id"), F.lit(None).cast("string").alias("entity_type"), both.alias("names"), *keyed(both), F.lit(None).cast(_CITATION).alias("citations"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for doc, group in pdf.groupby("doc_id", sort=False, dropna=False):
            key, formal = {}, {}
            for ns, ks, fs in zip(group["names"], group["keys"], group["formal"], strict=True):
                key.update(zip(ns, ks, strict=True))
                formal.update(zip(ns, fs, strict=True))
            own = group[group["kind"] == 0]
            fold = Fold([Entity(i, t, list(n), list(c) if c is not None else []) for i, t, n, c in zip(own["entity_id"], own["entity_type"], own["names"], own["citations"], strict=True)], key, formal)
            for ns in group.loc[group["kind"] == 1, "names"]:
                fold.define(key[ns[0]], ns[1])
            fold.settle()
            for e, pos in zip(fold.ents, own["pos"], strict=True):
                if e is not None:
                    out.append((doc, e.id, pos, e.names[0], e.kind, e.names[1:], e.citations, e.members, *fold.stats.values()))
        return pd.DataFrame(out, columns=["doc_id", "entity_id", "pos", "canonical_name", "entity_type", "aliases", "citations", "members", *STATISTICS])

    schema = f"doc_id {kinds['doc_id']}, entity_id {kinds['entity_id']}, pos bigint, canonical_name string, entity_type string, aliases array<string>, citations {_CITATION}, members array<{kinds['entity_id']}>, " + ", ".join(f"{s} bigint" for s in STATISTICS)
    return map_groups(rows.unionByName(said), ["doc_id"], ["kind", "pos"], run, schema)
