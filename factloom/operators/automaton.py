"""Many names in one pass over a text.

All forms that belong to a document make one automaton, which runs once over each of its texts and reports every place
of every form, however many there are.  Building costs the length of the forms, scanning that of the text and of what is
found; nothing is asked name by name.
"""

from __future__ import annotations

from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

_HITS = ArrayType(StructType().add("form", IntegerType()).add("n", IntegerType()).add("start_char", IntegerType()).add("end_char", IntegerType()))

#: Rows that a scan turns into Python's strings at a time.
_ROWS = 256


def fold_case(s: str) -> str:
    """Lower case with every character in its place."""
    low = s.lower()
    return low if len(low) == len(s) else "".join(c.lower() if len(c.lower()) == 1 else c for c in s)


class Names:
    """The automaton of some forms; equal forms share a node and keep their numbers."""

    def __init__(self, forms: list[str], ignore_case: bool = False):
        self.fold = fold_case if ignore_case else str
        numbers: dict[str, list[int]] = {}
        for i, form in enumerate(forms):
            if form:
                numbers.setdefault(self.fold(form), []).append(i)
        self.distinct = len(numbers)
        self.machine = ahocorasick.Automaton()
        for node, (form, of) in enumerate(numbers.items()):
            self.machine.add_word(form, (node, len(form), of))
        if numbers:
            self.machine.make_automaton()

    def places(self, text: str, limit: int = 0) -> list[tuple[int, int, int, int]]:
        """(form, n, start, end): a form's n-th place from the left that doesn't overlap its last one, the first ``limit`` if that isn't 0."""
        if not self.distinct or not text:
            return []
        ends, counts, out, left = [0] * self.distinct, [0] * self.distinct, [], self.distinct
        for last, (node, length, of) in self.machine.iter(self.fold(text)):
            start = last + 1 - length
            if start < ends[node] or (limit and counts[node] == limit):
                continue
            out += [(i, counts[node], start, last + 1) for i in of]
            ends[node] = last + 1
            counts[node] += 1
            if counts[node] == limit:
                left -= 1
                if not left:
                    break
        return out


def leftmost_longest(places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(form, start, end) without overlaps: from the left the first place, of those the longest, of those the smallest form."""
    out, free = [], 0
    for form, start, end in sorted(places, key=lambda p: (p[1], -p[2], p[0])):
        if start >= free:
            out.append((form, start, end))
            free = end
    return out


def _scanner(ignore_case: bool, limit: int, longest: bool):
    @F.arrow_udf(_HITS)
    def scan(text: pa.Array, forms: pa.Array) -> pa.Array:
        flat, ends, known, names = array("i"), array("i", [0]), None, None
        for at in range(0, len(text), _ROWS):  # only some rows at a time are Python objects; places are four numbers each
            for t, key in zip(text.slice(at, _ROWS).to_pylist(), forms.slice(at, _ROWS).to_pylist(), strict=True):
                if key != known:  # texts of a document mostly follow one another
                    known, names = key, Names(key, ignore_case)
                found = names.places(t or "", limit)
                if longest:
                    found = [(i, n, a, b) for n, (i, a, b) in enumerate(leftmost_longest([(i, a, b) for i, _, a, b in found]))]
                for place in found:
                    flat.extend(place)
                ends.append(len(flat) // 4)
        numbers = np.frombuffer(flat, dtype=np.int32).reshape(-1, 4)
        columns = [pa.array(np.ascontiguousarray(numbers[:, i])) for i in range(4)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=_HITS.elementType.names))

    return scan


def find_forms(texts: DataFrame, forms: DataFrame, text_col="text", ignore_case=False, limit: int | None = None, longest=False, automata=1, quote=False) -> DataFrame:
    """Columns of ``texts`` but the text, with id, n, start_char, end_char of each place of a form of its document, and with ``quote`` what stands there.

    ``texts`` has doc_id and the text, ``forms`` has (doc_id, id, form); null and empty forms are nowhere.  Places of one form
    don't overlap; ``limit`` keeps a form's first ones.  With ``longest`` no two places overlap: the leftmost counts, of those
    the longest, of those the smallest id (n then numbers the text's places).  ``automata`` deals the forms of each document
    to so many automata, for documents with very many; that is no choice with ``longest``.
    """
    if longest and (automata > 1 or limit):
        raise ValueError("longest needs all places of a document's forms in one automaton")
    part = F.pmod(F.xxhash64("form"), F.lit(automata)) if automata > 1 else F.lit(0)
    lists = forms.where("form <> ''").select("doc_id", part.alias("_part"), F.struct("id", "form").alias("_form")).groupBy("doc_id", "_part").agg(F.array_sort(F.collect_set("_form")).alias("_forms"))
    scan = _scanner(ignore_case, limit or 0, longest)
    rows = texts.join(lists.drop("_part"), "doc_id").withColumn("_hits", scan(F.col(text_col), F.transform("_forms", lambda x: x["form"])))
    kept = [c for c in texts.columns if c != text_col]
    rows = rows.select(*kept, *([text_col] if quote else []), "_forms", F.explode("_hits").alias("_hit"))
    said = [F.expr(f"substring(`{text_col}`, _hit.start_char + 1, _hit.end_char - _hit.start_char)").alias("quote")] if quote else []
    return rows.select(*kept, F.element_at("_forms", F.col("_hit.form") + 1)["id"].alias("id"), "_hit.n", "_hit.start_char", "_hit.end_char", *said)
