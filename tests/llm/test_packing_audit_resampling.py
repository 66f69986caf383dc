"""Packing, filter audit and resampling, each against a plainer version, and on odd tables."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import filter_audit, packing, queries, resampling

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


@pytest.fixture(scope="module")
def encoder():
    with open(BYTE_BPE, "rb") as f:
        return packing.Encoder.of(f.read())


# Packing


def brute_level(counts, n, size):
    """Of all levels that have a window, and of a new window, that with the least sum of squares, the fullest first."""
    best = None
    for h in range(size - n, -1, -1):
        if h and not counts[h]:
            continue
        after = Counter({k: v for k, v in enumerate(counts)})
        after[h] -= h > 0
        after[h + n] += 1
        total = sum(v * v for k, v in after.items() if 0 < k < size)
        if best is None or total < best[0]:
            best = total, h
    return best[1]


@given(st.lists(st.integers(1, 24), min_size=1, max_size=80), st.integers(1, 12))
@settings(max_examples=150, deadline=None)
def test_levels_have_the_least_sum_of_squares(sizes, most_open):
    packer, windows = packing.Packer(12, most_open), []
    for i, n in enumerate(sizes):
        rest = n % 12
        if rest:
            assert packer.level(rest) == brute_level(packer.counts.tolist(), rest, 12)
        packer.add(i, np.arange(n, dtype="<i4").tobytes())
        assert packer.open == sum(map(len, packer.levels)) == packer.counts.sum() <= most_open
        assert all(sum(len(p[2]) // 4 for p in w) == h for h, ws in enumerate(packer.levels) for w in ws)
        windows += packer.finished()
    packer.end()
    windows += packer.finished()
    seen = defaultdict(list)
    for w in windows:
        total = sum(len(ids) // 4 for _, _, ids in w)
        assert total == 12 or total & (total - 1) == 0
        for document, start, ids in w:
            assert ids and np.frombuffer(ids, "<i4").tolist() == list(range(start, start + len(ids) // 4))
            seen[document] += np.frombuffer(ids, "<i4").tolist()
    assert {i: sorted(x) for i, x in seen.items()} == {i: list(range(n)) for i, n in enumerate(sizes)}


def check_packed(rows, docs, library, size):
    """Pieces make up the library's ids of each row's text and the end id; sequences are whole."""
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in docs)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) > 0
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or (at < size and at & (at - 1) == 0)
    for (id_, tokens), rs in by_doc.items():
        same = [x for x in want.elements() if x[0] == id_ and len(x[1]) == tokens]
        pieces = Counter((r.start, tuple(r.ids)) for r in rs)
        covered = Counter()
        for _, ids in same:
            for start, piece in pieces:
                if ids[start : start + len(piece)] == piece:
                    covered[start, piece] += 1
        assert sum(r.length for r in rs) == tokens * len(same) and all(covered[p] for p in pieces)
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in want.elements())


def test_packing(spark, odd, none, clashing, library):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["alpha", "beta's", "Γδ", "12345", "\n\n", "<|endoftext|>", "😀", "՘x"]) for _ in range(rnd.choice([0, 3, 40, 200, 700]))) for _ in range(120)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for most_open in (3, 4096):
        rows = packing.pack(table, BYTE_BPE, end_id=1, size=128, most_open=most_open).collect()
        check_packed(rows, list(enumerate(texts)), library, 128)
    for df in (odd, clashing):
        rows = packing.pack(df, BYTE_BPE, end_id=1, size=64).collect()
        check_packed(rows, [(r.doc_id, r.text) for r in df.collect()], library, 64)
    assert packing.pack(none, BYTE_BPE, end_id=1).collect() == []
    named = clashing.selectExpr("concat('id ', doc_id) AS doc_id", "text")
    assert {r.doc_id for r in packing.pack(named, BYTE_BPE, end_id=1).collect()} == {f"id {i}" for i in range(6)}
    told = packing.digests(table, BYTE_BPE, end_id=1, size=128).collect()
    given_ = {(r.sequence_id, r.offset): r for r in packing.pack(table, BYTE_BPE, end_id=1, size=128).collect()}
    assert len(told) == len(given_)
    for r in told:
        piece = given_[r.sequence_id, r.offset]
        assert (r.doc_id, r.start, r.length) == (piece.doc_id, piece.start, piece.length)
        assert r.ids_crc32 == zlib.crc32(np.asarray(piece.ids, "<u4").tobytes())


@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", "<|endof", "  \n", "'s", "'T", "\u0085", "​", "\x1c", "İı", "ǅ", "中文", "٣"])), max_size=12))
@settings(max_examples=400, deadline=None)
def test_texts_encode_as_by_the_library(library, encoder, parts):
    text = "".join(parts)
    assert np.frombuffer(encoder.encode(text), "<i4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_settled_character_splits_as_by_the_library(library, encoder):
    """Texts of characters that aren't settled go to the library; all others are encoded here."""
    settled = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x10000))) if not encoder.aside(c)]
    assert len(settled) > 45_000
    texts = [f"a{c}b1 {c}{c}!  {c} x\n{c}'s" for c in settled]
    for text, want in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder.plain(text), "<i4").tolist() == want.ids, text


def test_long_texts_are_cut_between_words(library, encoder, monkeypatch):
    rnd = random.Random(4)
    monkeypatch.setattr(encoder, "whole", None)  # settled texts never go to the library
    text = "".join(rnd.choice(["word", " ", "  ", "it's", "'s", "9", "\n", "ü", "!", " a b"]) for _ in range(4000))
    want = library.encode(text, add_special_tokens=False).ids
    for n in (1, 7, 100):
        monkeypatch.setattr(packing, "LONG", n)
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == want


def test_other_definitions_go_to_the_library(library):
    with open(BYTE_BPE, "rb") as f:
        definition = json.load(f)
    assert packing.ranks_of(definition)
    changed = [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": definition["pre_tokenizer"] | {"add_prefix_space": True}}]
    changed += [{"model": definition["model"] | {"ignore_merges": True}}, {"model": definition["model"] | {"merges": definition["model"]["merges"][::-1]}}]
    for change in changed:
        assert packing.ranks_of(definition | change) is None
    other = packing.Encoder(json.dumps(definition | changed[0]).encode())
    plain = Tokenizer.from_str(json.dumps(definition | changed[0]))
    assert np.frombuffer(other.encode("Some TEXT"), "<i4").tolist() == plain.encode("Some TEXT", add_special_tokens=False).ids


# The filter audit


def brute_audit(docs, labels):
    marks = defaultdict(lambda: [False, False])
    for i, quality, toxic in labels:
        if i is not None:
            marks[i][0] |= quality == 1
            marks[i][1] |= toxic == 1
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    failed = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text]}
        failed.append((part or "", {x for x, y in fails.items() if y}, marks[i] if i is not None else [False, False]))
    out = {}
    for part in {p for p, _, _ in failed}:
        rows = [(f, m) for p, f, m in failed if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(rows)
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                fails = sum(x in f for f, _ in rows)
                left = [r for r in left if x not in r[0]]
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(f == {x} for f, _ in rows), sum(m[0] for _, m in gone), sum(m[1] for _, m in gone)]
    shapley = Counter()
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] += v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = "doc_id long, quality int, toxic int"


def audited(docs, labels):
    rows = filter_audit.audit(docs, labels).collect()
    told = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(told) == len(rows)
    return told


def test_filter_audit(spark, odd, none, clashing):
    rnd = random.Random(5)
    pool = [" ".join(rnd.choice(["a", "b", "Cc", "d%", "e"] + [f"w{i}" for i in range(400)]) for _ in range(n)) for n in (0, 3, 150, 199, 200, 201, 450, 600)]
    pool += [" ".join(["x"] * 300), " ".join(["same words"] * 150), "AB" + "c" * 98, "AB" + "c" * 97, "É" * 50 + "A" + "\t" + "w " * 220]
    docs = [(rnd.randint(0, 60), rnd.choice([*pool, None]), rnd.choice(["p", "q", "r", "", None])) for _ in range(90)]
    docs += [(None, pool[4], "p"), (None, pool[4], "p"), (-5, pool[5], "q"), (-5, pool[5], "q"), (-5, pool[5], "r")]
    labels = [(rnd.randint(0, 60), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(70)] + [(None, 1, 1)]
    made = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    assert audited(made, spark.createDataFrame(labels, LABELS)) == brute_audit(docs, labels)
    few = spark.createDataFrame([(i, 1, 1, "x", 2) for i in range(6)], LABELS + ", mask string, n int")
    for df in (odd, clashing):
        assert audited(df, few) == brute_audit([(r.doc_id, r.text, r.source) for r in df.collect()], [(i, 1, 1) for i in range(6)])
        assert audited(df, few.limit(0)) == brute_audit([(r.doc_id, r.text, r.source) for r in df.collect()], [])
    assert audited(none, few) == {}


def test_parity_sums_are_inverted_exactly(spark):
    rnd = random.Random(1)
    rows = [("p", m, bool(m % 2), m % 3 == 0, rnd.randint(0, 1 << 40)) for m in range(32)]
    counted = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean, n long")
    sums = {r.label: r.sums for r in filter_audit.parity_sums(counted).collect()}
    assert all(sums["all"][s] == sum(n * (-1) ** bin(s & m).count("1") for _, m, _, _, n in rows) for s in range(32))
    row = filter_audit.cells(filter_audit.parity_sums(counted)).first()
    assert row["all"] == [r[4] for r in rows] and row.good == [r[4] * r[2] for r in rows] and row.toxic == [r[4] * r[3] for r in rows]


# Resampling


def brute_resample(docs, target, most, buckets, percent, min_words=20):
    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(words) - k + 1)]

    found = [features(t) for _, t in docs]
    s, t = Counter(b for f in found for b in f), Counter(b for x in target for b in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for (i, _), f in zip(docs, found, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return Counter([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in (Counter(rows) - Counter(drawn)).elements()])


@pytest.mark.parametrize(("most", "buckets", "percent"), [(1, 10_000, 50), (3, 97, 100)])
def test_resampling(spark, odd, none, clashing, monkeypatch, most, buckets, percent):
    monkeypatch.setattr(resampling, "SPLIT_BLOCKS", 1)
    rnd = random.Random(2)
    word = lambda: rnd.choice(["the", "The", "naïve", "中", "x9", "y" * 100, f"w{rnd.randint(0, 300)}"])
    docs = [(rnd.choice([None, *range(40)]), " ".join(word() + rnd.choice(["", "!", "-"]) for _ in range(rnd.choice([0, 5, 19, 20, 60, 400])))) for _ in range(80)]
    docs += [(7, "one text " * 30)] * 5 + [(None, None), (8, None)]
    target = [" ".join(word() for _ in range(30)) for _ in range(6)] + [None, ""]
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")

    def told(df, aim_, percent=percent):
        rows = resampling.resample(df, aim_, most=most, buckets=buckets, percent=percent).collect()
        return Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in rows)

    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert told(made, aim) == brute_resample(docs, target, most, buckets, percent)
    for df in (odd, clashing):
        assert told(df, aim) == brute_resample([(r.doc_id, r.text) for r in df.collect()], target, most, buckets, percent)
    assert told(odd, aim.limit(0)) == brute_resample([(r.doc_id, r.text) for r in odd.collect()], [], most, buckets, percent)
    assert told(none, aim) == Counter()


@given(st.lists(st.binary(max_size=90), max_size=30))
def test_crc32_of_many(parts):
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts]).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
    starts = ends - np.array([len(p) for p in parts], dtype=np.int64)
    assert resampling.crc32(data, starts, ends).tolist() == [zlib.crc32(p) for p in parts]


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_importance_resampling"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = queries.queries()[name](spark, DATA).collect()
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=str) == sorted(want.fetchall(), key=str)
