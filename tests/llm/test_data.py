"""Measures on the given tables, where they are there."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from quillmill.llm.garbled import examine
from quillmill.llm.quality import CJK, fit, ratios, score, vector

DATA = Path("/root/testdata/sf0.1")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def read(name: str, *columns: str) -> pd.DataFrame:
    return pd.read_parquet(DATA / f"{name}.parquet", columns=list(columns))


def test_held_out_labels() -> None:
    words = [w.lower() for w in read("common_word", "word")["word"]]
    known = frozenset(w for w in words if not CJK.search(w)), tuple(w for w in words if CJK.search(w))
    rows = read("chunk", "ord", "text").merge(read("chunk_label", "ord", "kind"), on="ord").dropna().sort_values("ord")
    x, prose = ratios(np.stack([vector(s, known) for s in rows["text"]])), (rows["kind"] == "prose").to_numpy()
    half = np.arange(len(rows)) % 2 == 0
    right = (score(x[~half], fit(x[half], prose[half])) > 0) == prose[~half]
    assert right.mean() > 0.98


def test_prose_is_not_garbled() -> None:
    text = read("chunk", "ord", "text").merge(read("chunk_label", "ord", "kind"), on="ord").dropna()["text"]
    found = [s for s in text if examine(s)[0]]
    assert len(found) <= 0.002 * len(text), [re.sub(r"\s+", " ", s)[:80] for s in found[:5]]
