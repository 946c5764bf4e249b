"""Many terms at once: one pass over each text, whatever their number."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for n, term in enumerate(terms):
        if term:
            made.add_word(term, [*made.get(term, []), n])
    made.make_automaton()
    return made, [n for n, term in enumerate(terms) if not term]


def _found(texts: pa.Array, terms: tuple[str, ...]) -> pa.Array:
    automaton, empty = _automaton(terms)
    out = []
    for text in texts:
        text = text.as_py()
        if text is None:
            out.append(None)
        else:
            seen = {n for _, numbers in automaton.iter(text) for n in numbers} if len(automaton) else set()
            out.append(sorted(seen.union(empty)))
    return pa.array(out, pa.list_(pa.int32()))


def term_numbers(text: Column, terms: Sequence[str]) -> Column:
    """Numbers of the terms that the text contains, in list order; null for a null text.

    One automaton over all terms reads each text once, in Arrow batches.  Terms
    are found as they are, within words too; an empty term is in every text, and
    a term that stands twice in the list has both numbers.
    """
    fixed = tuple(terms)
    return F.arrow_udf(lambda texts: _found(texts, fixed), "array<int>")(text)


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """The terms that the text contains, in list order."""
    listed = F.array(*map(F.lit, terms)) if len(terms) <= 1000 else F.split(F.lit("\x00".join(terms)), "\x00")
    return F.transform(term_numbers(text, terms), lambda n: F.get(listed, n))


def term_sum(text: Column, weights: Sequence[tuple[str, float]]) -> Column:
    """The sum of the weights of the terms that the text contains."""
    listed = F.array(*[F.lit(float(w)) for _, w in weights])
    return F.aggregate(term_numbers(text, [t for t, _ in weights]), F.lit(0.0), lambda a, n: a + F.get(listed, n))
