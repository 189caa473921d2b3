"""Counts of parts merged in any way equal those of the whole text; the model on held-out labels is in test_data.py."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession

from quillmill.llm.quality import LINE, SUMS, Counts, counts, fit, parts, ratios, score, text_quality, vector

WORDS = (frozenset({"the", "and", "of", "der"}), ("的", "如果", "因为"))
TEXTS = st.text(st.sampled_from(list("ab c.\n\t|，。如果因为的的”1. -")), max_size=80)


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.lists(st.integers(0, 80), max_size=4))
def test_merge_is_associative_but_for_gaps_and_items_cut_at_a_boundary(text: str, cuts: list[int]) -> None:
    edges = sorted({0, len(text), *(c for c in cuts if c < len(text) and not text[c].isspace() and not text[c - 1 : c].isspace())})
    pieces = [Counts.of(text[a:b], WORDS) for a, b in zip(edges, edges[1:], strict=False)]
    if not pieces:
        return
    left = pieces[0]
    for p in pieces[1:]:
        left = left.merge(p, WORDS)
    right = pieces[-1]
    for p in pieces[-2::-1]:
        right = p.merge(right, WORDS)
    assert np.array_equal(left.vector(), right.vector())
    skip = [len(SUMS) + LINE.index(k) for k in ("bullets", "bullet_chars")]  # an item's mark may be cut; parts() doesn't
    keep = np.setdiff1d(np.arange(left.vector().size), skip)
    assert np.array_equal(left.vector()[keep], vector(text, WORDS)[keep])


def test_huge_texts_are_counted_in_parts(spark: SparkSession) -> None:
    rng = random.Random(1)
    texts = ["".join(rng.choice(["the word ", "如果的。", "x" * 50, "\n", "- item | a | b\n"]) for _ in range(3000)), "y" * 30_000, "the end.", "", " ", None]
    rows = [(i, s) for i, s in enumerate(texts)] + [(0, texts[0])]
    assert len(parts(texts[0], 256)) > 64 * 2
    found = counts(spark.createDataFrame(rows, "ord bigint, text string"), "ord", "text", WORDS, size=256).collect()
    assert sorted(r.id for r in found) == [0, 0, 1, 2, 3, 4, 5]
    for r in found:
        assert r.counts == vector(texts[r.id] or "", WORDS).tolist()


def test_measures_and_outcome(spark: SparkSession) -> None:
    prose = ["The value of the margin depends on the state, and the rest follows. It is safe." * k for k in (1, 2, 3)]
    lists = ["- a (1)\n- b (2)\n- c (3)\n" * k for k in (1, 2, 3)]
    model = fit(ratios(np.stack([vector(s, WORDS) for s in prose + lists])), np.array([1, 1, 1, 0, 0, 0]).astype(bool))
    assert (score(ratios(np.stack([vector(s, WORDS) for s in prose])), model) > 0).all()
    rows = [(1, prose[1], 5), (2, lists[0], 5), (3, " ", 5), (4, None, 5)]
    found = {r.id: r for r in text_quality(spark.createDataFrame(rows, "ord bigint, text string, words int"), WORDS, model).collect()}
    assert [found[k].prose for k in (1, 2, 3, 4)] == [True, False, None, None]
    assert (found[2].words, found[2].mean_word_length, found[2].ended_line_share, found[3].symbol_share) == (6, 1.0, 0.0, None)
