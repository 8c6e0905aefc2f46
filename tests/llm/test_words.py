"""Words of many texts at once are those of each by itself."""

from __future__ import annotations

import pyarrow as pa
import pytest
import xxhash

from sheaf.llm import tokens

ODD = ["", None, " a  B\t\x0bc ", "\n", "É ÀB\x85x\x1cy\xa0z A", "\x00 q", "".join(map(chr, range(300))), "x" * 10, "A a É b", "one"]


@pytest.mark.parametrize("column", [pa.array(ODD), pa.array(ODD).slice(2, 5), pa.array(ODD, pa.large_string()).slice(1), pa.array([], pa.string()), pa.array([None], pa.string())])
def test_words_of_many_texts(column):
    hashes, at, ends = tokens.words_of(column)
    got = [hashes[at[a:b]].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert got == [[xxhash.xxh3_64_intdigest(w) for w in t.lower().split()] for t in tokens.texts_of(column)]


def test_each_distinct_word_is_hashed_once(monkeypatch):
    """op1_lm_score: every occurrence of every word was a Python object that was looked up."""
    asked, one = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(tokens.xxhash, "xxh3_64_intdigest", lambda w: asked.append(w) or one(w))
    tokens.words_of(pa.array(["b a B " * 1000, "a c"]))
    assert sorted(asked) == [b"a", b"b", b"c"]
