import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import levenshtein, minhash, text

TEXTS = st.lists(st.text(alphabet="aAbB \t\n\x0b.é中", max_size=40), min_size=1, max_size=8)


def hashed(texts, **options):
    out = []
    for _, part in text.slices(pa.array(texts, pa.string()), limit=64):
        w = text.words(part, **options)
        out += [w.hash[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_are_those_between_ascii_space(texts):
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    got = hashed(texts)
    seen = {}
    for ws, hs in zip(want, got, strict=True):
        assert len(ws) == len(hs)
        for w, h in zip(ws, hs, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_words_do_not_depend_on_segments(monkeypatch):
    long_ = " ".join(f"word{i}" * (1 + i % 7) for i in range(3000)) + " " + "x" * 5000
    whole = hashed([long_])
    monkeypatch.setattr(text, "SEGMENT", 1000)
    text._powers.clear()
    assert hashed([long_]) == whole
    text._powers.clear()


@given(TEXTS)
@settings(max_examples=100, deadline=None)
def test_shingle_sets(texts):
    for _, part in text.slices(pa.array(texts, pa.string())):
        sets, bounds = text.shingle_sets(text.words(part), 3)
        for t, n in zip(texts, np.diff(bounds), strict=True):
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
            want = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
            assert n == len(want)


def test_punctuation_parts_words():
    plain, marked = hashed(["un idiot là ici"], accept=text.ALNUM), hashed(["«un» “idiot”—là、ici…"], accept=text.ALNUM)
    assert plain == marked and len(plain[0]) == 4


def test_minhash_estimates_likeness():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:2400], rng.integers(0, 2**64, 600, dtype=np.uint64)]))
    few = np.sort(rng.choice(a, 20, replace=False))
    fewer = np.unique(np.concatenate([few[:18], rng.integers(0, 2**64, 2, dtype=np.uint64)]))
    for x, y in ((a, b), (few, fewer)):
        sig = minhash.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 512)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.12
    assert all(((1 - (n / d) ** r) ** b) <= 1e-6 for n, d in ((4, 5), (85, 100)) for r, b in [minhash.banding(n, d)])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.lists(st.text("abc", min_size=1, max_size=12), min_size=1, max_size=6), st.lists(st.text("abcd", max_size=13), max_size=20))
@settings(max_examples=150, deadline=None)
def test_automaton_finds_the_nearest_term(terms, words):
    automaton = levenshtein.Automaton(terms)
    for w in words:
        near = min(((distance(w, t), i) for i, t in enumerate(automaton.terms) if distance(w, t) <= levenshtein.edits(t)), default=None)
        assert automaton.match(w) == near


def test_automaton_forgets_within_its_bound(monkeypatch):
    monkeypatch.setattr(levenshtein, "REMEMBERED", 3)
    automaton = levenshtein.Automaton(["idiot", "moron"])
    assert [automaton.match(w) for w in ("idiot", "idoit", "morn", "xidiot")] == [(0, 0), None, (1, 1), (1, 0)]
