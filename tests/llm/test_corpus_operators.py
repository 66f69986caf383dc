"""Each operator against a plainer version, and on odd tables."""

import base64
import gzip
import hashlib
import json
import math
import pathlib
import random
import re
import struct
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import archives, byte_bpe, decontaminate, imatch, levenshtein, licences, near_dedup, quality, sharding, sstable, text, toxicity
from tidemark.llm.shared import Workspace, drop

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")


def prose(rnd, n):
    return " ".join("".join(rnd.choice(["th", "an", "er", "on", "re", "sh", "le"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_groups(rows, k, num, den):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


@pytest.mark.parametrize(("k", "num", "den"), [(3, 85, 100), (5, 4, 5)])
def test_near_duplicates(spark, k, num, den):
    rnd = random.Random(5)
    rows, texts = [], []
    for _ in range(40):
        t = prose(rnd, rnd.choice([2, 8, 40, 200]))
        for _ in range(rnd.randint(1, 5)):
            w = t.split()
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = prose(rnd, 1)
            texts.append(" ".join(w))
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k, num=num, den=den)
    assert sorted(tuple(r) for r in got.collect()) == brute_groups(rows, k, num, den)


@given(st.integers(0, 10**6), st.sampled_from([(85, 100), (4, 5), (1, 2)]))
@settings(max_examples=60, deadline=None)
def test_a_bucket_is_searched_as_by_all_pairs(seed, share):
    rnd = random.Random(seed)
    base = [prose(rnd, 1) for _ in range(rnd.choice([1, 4, 30]))]
    texts = []
    for _ in range(rnd.randint(2, 40)):
        w = list(base) if rnd.random() < 0.8 else [prose(rnd, 1) for _ in range(rnd.randint(1, 30))]
        for _ in range(rnd.choice([0, 1, 1, 2, 5])):
            w[rnd.randrange(len(w))] = prose(rnd, 1)
        texts.append(" ".join(w))
    table = pa.table({"doc": list(range(len(texts))), "comp": list(range(len(texts))), "text": texts})
    links = near_dedup._search(3, *share)(table)
    root = {i: i for i in range(len(texts))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True):
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(texts))] == [c for _, _, c, _ in brute_groups(list(enumerate(texts)), 3, *share)]


@pytest.mark.parametrize("bound", [1 << 21, 100])
def test_near_duplicates_in_one_bucket_of_many(spark, monkeypatch, bound):
    """Texts that share a bucket but not the link to its centre still find their own links, in one task or by a join."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", bound)
    rnd = random.Random(2)
    base = prose(rnd, 60).split()
    rows = []
    for i in range(60):
        w = list(base)
        for j in rnd.sample(range(60), 3):
            w[j] = f"x{i}y{j}"
        rows.append((i, " ".join(w)))
        if i % 6 == 0:
            rows.append((100 + i, " ".join([*w[:-1], "end"])))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, num=85, den=100)
    assert sorted(tuple(r) for r in got.collect()) == brute_groups(rows, 3, 85, 100)


def test_pairs_of_a_crowded_bucket_grow_with_its_members(spark, tmp_path):
    """20,000 texts of one template share buckets, but no link: no pair of them is made, and planted links are found."""
    rnd = random.Random(4)
    base, rows = prose(rnd, 60).split(), []
    for i in range(20_000):
        w = list(base)
        for j in rnd.sample(range(2, 58, 4), 3):
            w[j] = f"x{i}y{j}"
        rows.append((i, i, " ".join(w)))
    rows += [(20_000 + i, 20_000 + i, rows[i][2] + " end") for i in range(0, 20_000, 2000)]
    members = spark.createDataFrame(rows, "doc long, comp long, text string")
    near_dedup.ship(spark)
    work = near_dedup.Workspace(spark, "crowd")
    pairs = {(r.a, r.b) for r in near_dedup.rare_pairs(members, 3, 85, 100, work).collect()}
    assert pairs == {(i, 20_000 + i) for i in range(0, 20_000, 2000)}
    got = near_dedup.near_duplicates(members.select(F.col("doc").alias("doc_id"), "text"), shingle=3, num=85, den=100)
    assert {(r.doc_id, r.component_id) for r in got.where("NOT kept").collect()} == {(b, a) for a, b in pairs}


def test_near_duplicates_odd(odd, none, clashing):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()}
    assert got[(1, 0)] == (1, True) and got[(2, 0)] == (2, True) and got[(3, 0)] == (3, True)
    assert got[(4, 29996)] == (4, True) and got[(5, 29997)] == (4, False)
    assert got[(6, 1)] == (6, True) and got[(7, 1)] == (6, False) and got[(None, 1)] == (None, True)
    assert {v for k, v in got.items() if k[0] == 8} == {(8, True)}
    assert near_dedup.near_duplicates(odd).count() == 11
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.near_duplicates(clashing).count() == 6


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark, odd, none, clashing, encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "DEALT", 500)
    monkeypatch.setattr(byte_bpe, "DEALT_OVERLAP", 60)
    monkeypatch.setattr(byte_bpe, "CHUNK", 100)
    monkeypatch.setattr(byte_bpe, "OVERLAP", 20)
    extra = spark.createDataFrame([(20, "a  b\n\n" * 300 + "x" * 3000 + " y" * 400), (21, "'ll it's" * 200 + " " * 900 + "z")], "doc_id long, text string")
    rows = odd.select("doc_id", "text").unionByName(extra)
    encoded = byte_bpe.encode(rows, RANKS, PATTERN)
    want = sorted(((r.doc_id, encoding.encode_ordinary(r.text or "")) for r in rows.collect()), key=str)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str) == want
    back = byte_bpe.decode(encoded, RANKS, PATTERN)
    assert sorted(((r.doc_id, bytes(r.bytes).decode()) for r in back.collect()), key=str) == sorted(((r.doc_id, r.text or "") for r in rows.collect()), key=str)
    verified = byte_bpe.encode_and_decode(rows, RANKS, PATTERN).collect()
    assert sorted(((r.doc_id, r.ids) for r in verified), key=str) == want
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in verified) == sorted((str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows.collect())
    told = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in byte_bpe.digests(rows, RANKS, PATTERN).collect()}
    assert told == {(d, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()) for d, i in want}
    assert byte_bpe.digests(none, RANKS, PATTERN).count() == 0
    assert byte_bpe.encode(clashing, RANKS, PATTERN).count() == 6


@given(st.text(alphabet="ab'lst .\n\t 12é中!", min_size=1, max_size=300), st.integers(8, 60), st.integers(6, 20))
@settings(max_examples=200, deadline=None)
def test_stitching(t, chunk, overlap):
    with open(RANKS, "rb") as f:
        vocabulary = byte_bpe.Vocabulary.of(f.read(), PATTERN)
    bases = list(range(0, max(1, len(t) - overlap), chunk))
    scans = [byte_bpe.chunk_scan(t[b : b + chunk + overlap], b + chunk + overlap >= len(t), vocabulary) for b in bases]
    assert byte_bpe.stitch(bases, scans) in (None, vocabulary.encode(t))


@given(st.text(alphabet="ab'lst .\n\t 12é中!", min_size=1, max_size=300), st.integers(8, 60), st.integers(6, 20))
@settings(max_examples=300, deadline=None)
def test_pieces_of_chunks_are_those_of_one_scan(t, chunk, overlap):
    with open(RANKS, "rb") as f:
        vocabulary = byte_bpe.Vocabulary.of(f.read(), PATTERN)
    kept = byte_bpe.CHUNK, byte_bpe.OVERLAP
    byte_bpe.CHUNK, byte_bpe.OVERLAP = chunk, min(overlap, chunk - 1)
    try:
        assert vocabulary.pieces(t) == vocabulary.scan(t)
    finally:
        byte_bpe.CHUNK, byte_bpe.OVERLAP = kept


def brute_ids(rows):
    t, out, start = Tokenizer.from_file(WORDS), [], 0
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, SEED if r[1] is None else spark_hash(r[1]))):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_sstable(spark, odd, none, clashing, tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    extra = [(-5, "<|endoftext|> x\x1cy"), (10**12, "It's ÀÉ 12² naïve Ａ İ ǅ ́ ½"), *[(i, f"text {i} " * (i % 9)) for i in range(100, 160)]]
    rows = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = sorted((tuple(r) for r in sstable.roundtrip(rows, WORDS).collect()), key=lambda r: r[1])
    assert got == brute_ids([tuple(r) for r in rows.collect()])
    path = str(tmp_path / "shards")
    sstable.write(rows, path, WORDS, shard_bytes=2000)
    sstable.write_manifest(spark, path)
    assert spark.read.parquet(f"{path}-manifest").count() > 3
    found = {r.doc_id: r.ids for r in sstable.lookup(spark, path, [120, 100, 99999]).collect()}
    t = Tokenizer.from_file(WORDS)
    assert found == {i: [*t.encode(f"text {i} " * (i % 9), add_special_tokens=False).ids, 1] for i in (100, 120)}
    assert sstable.lookup(spark, path, [99999]).count() == 0 and sstable.get(spark, path, 99999) == []
    assert [x.tolist() for x in sstable.get(spark, path, 120)] == [found[120]] and len(sstable.get(spark, path, 6)) == 2
    assert sstable.roundtrip(none, WORDS).count() == 0
    assert sstable.roundtrip(clashing, WORDS).count() == 6


@given(st.lists(st.text(max_size=30), max_size=4))
@settings(max_examples=300, deadline=None)
def test_runs_encode_as_whole_texts(parts):
    with open(WORDS, "rb") as f:
        words = sstable.Words.of(f.read())
    t = " ".join(parts)
    assert words.encode(t) == words.whole(t)


def test_other_definitions_encode_whole_texts():
    with open(WORDS, "rb") as f:
        plain = json.load(f)
    assert sstable.splits_as_here(json.dumps(plain).encode())
    plain["normalizer"]["normalizers"].pop()
    words = sstable.Words(json.dumps(plain).encode())
    assert not words.by_runs and words.encode("Some Text") == words.whole("Some Text") != sstable.Words.whole(words, "some text")


def test_shard_checks_its_bytes():
    data = bytearray(sstable.build([(sstable.key_of(1), struct.pack("<I", 70000))], 0, 0) + b"\n")
    assert [ids.tolist() for _, ids in sstable.Shard.of(bytes(data))] == [[70000]]
    data[0] ^= 1
    with pytest.raises(ValueError):
        sstable.Shard.of(bytes(data))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_files(version):
    records = [archives.ArcRecord(f"http://x/{i}", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.1 200 OK\r\n\r\n" + b"a\n\nb" * i) for i in range(4)]
    data = archives.write_arc(iter(records), version)
    assert list(archives.read_arc(data)) == records
    with pytest.raises(ValueError):
        list(archives.read_arc(data[:-3]))
    with pytest.raises(ValueError):
        list(archives.read_arc(data.replace(b"%d 0 tidemark" % version, b"7 0 tidemark")))
    assert archives.timestamp("20010203040506") == "2001-02-03T04:05:06Z"


def test_legacy_files_of_any_bytes_become_warc(spark, tmp_path):
    """ARC files, plain and of gzip members, with Latin-1 and binary records; WARC files bounded in bytes."""
    bodies = ["häßlich".encode("latin-1"), bytes(range(256)) * 50, b"HTTP/1.1 200 OK\r\nX: \xe9\r\n\r\n" + b"\xff\xfe\r\n\r\n\0", b"", b"x" * 5000]
    records = [archives.ArcRecord(f"http://x/{i}", "1.2.3.4", "20010203040506", "image/x", b) for i, b in enumerate(bodies)]
    plain = archives.write_arc(iter(records[:2]), 1)
    (tmp_path / "a.arc").write_bytes(plain)
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(archives.write_arc(iter(records[2:4]), 2)))
    lead = archives.write_arc(iter([]), 1)
    (tmp_path / "c.arc.gz").write_bytes(gzip.compress(lead) + gzip.compress(archives.write_arc(iter(records[4:]), 1)[len(lead) :]))
    parts = archives.read_arc_files(spark, str(tmp_path / "*.arc*"))
    shared = archives.first_of_payloads(parts.select("sha1", "bytes", "page", "url", "date"))
    archives.write_warc(archives.with_revisits(parts, shared), str(tmp_path / "warc"), file_bytes=100)
    files = [f.read_bytes() for f in (tmp_path / "warc").glob("part-*")]
    assert len(files) == 5 and all(len(list(archives.members(f))) == 1 for f in files)
    blocks = {f["WARC-Target-URI"]: (b, f["WARC-Date"]) for data in files for f, b in archives.read_records(data)}
    assert blocks == {r.url: (r.content, "2001-02-03T04:05:06Z") for r in records}
    want = [b if not b.startswith(b"HTTP/") else b.split(b"\r\n\r\n", 1)[1] for b in bodies]
    got = sorted((r.uri, r.payload_bytes, r.payload_digest, r.record_type) for r in archives.read_warc(spark, str(tmp_path / "warc")).collect())
    assert got == [(f"http://x/{i}", len(b), archives.sha1(b), "response") for i, b in enumerate(want)]


def test_a_member_ends_in_a_zero_byte():
    for data in (b"", b"x" * ((1 << 24) + 5)):
        packed = archives._member(data)
        assert packed[-1] == 0 and b"".join(archives.members(packed)) == data


def test_members_of_any_size_are_read_in_their_bytes(monkeypatch):
    """Members about as long as what a decompressor is given, and many small ones, whose reading isn't the square of a file."""
    rnd, fixed = random.Random(5), archives.MEMBER_BYTES
    sizes = [0, 1, *(fixed * k + d for k in (1, 2, 3, 7) for d in range(-30, 3)), 300_000]
    plain = [rnd.randbytes(n) for n in sizes] + [b"\0" * 5_000_000]
    file = b"".join(gzip.compress(x, mtime=0) for x in plain)
    assert list(archives.members(file)) == plain
    for end in (1, 17, fixed, fixed + 1, len(file) - 1):
        with pytest.raises(ValueError):
            list(archives.members(file[:end]))
    taken = []

    class Counted:
        def __init__(self, *of):
            self.d = made(*of)

        def decompress(self, data):
            taken.append(len(data))
            return self.d.decompress(data)

        def __getattr__(self, name):
            return getattr(self.d, name)

    made = zlib.decompressobj
    monkeypatch.setattr(archives.zlib, "decompressobj", Counted)
    small = [rnd.randbytes(fixed // 2) for _ in range(2000)]
    file = b"".join(archives._member(x) for x in small)
    assert [x for x in archives.members(file) if x] == small
    assert sum(taken) < 8 * len(file)


def test_archive(spark):
    rows = [(3, "http://a b", "<p>same</p>"), (1, None, "<p>same</p>"), (2, "u", None), (5, "u", ""), (4, "u", "WARC/1.1\r\n\r\n\r\nx" * 3), (None, "u", "<p>same</p>"), (6, "u", "é中"), (7, "u", "<p>long</p>" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted((tuple(r) for r in archives.archive(pages).collect()), key=str)

    def want(i, u, h):
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        other = i is not None and min(same) != i
        url = {"http://a b": "http://a%20b", None: "unknown:"}.get(u, u)
        return (i, len((h or "").encode()), archives.sha1((h or "").encode()), "revisit" if other else "response", min(same) if other else None, url)

    assert got == sorted((want(*r) for r in rows), key=str)
    assert archives.archive(pages, min_bytes=1).where("payload_bytes = 0 AND record_type = 'revisit'").count() == 0
    assert archives.archive(pages.where("page_id > 99")).count() == 0


def test_sharding(spark, odd, none, clashing):
    rnd = random.Random(4)
    rows = [(i, "x" * rnd.choice([0, 10, 100, 900])) for i in range(500)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), byte_limit=2000).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows]
    size = dict(rows)
    by = {}
    for r in got:
        bits = f"{int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16):060b}"
        assert bits.startswith(r.shard) and len(r.shard) == r.depth and r.fits
        by.setdefault(r.shard, []).append(r)
    for shard, rs in by.items():
        assert sum(len(size[r.doc_id]) for r in rs) == rs[0].shard_bytes <= 2000
        parent = sum(len(t) for i, t in rows if f"{int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16):060b}".startswith(shard[:-1]))
        assert shard == "" or parent > 2000
    table = sharding.directory(spark.createDataFrame(got))
    slots = [x for r in table.collect() for x in range(r.first_slot, r.last_slot + 1)]
    assert len(set(slots)) == len(slots) and 0.99 * 2 ** table.first().global_depth < len(slots) and max(slots) < 2 ** table.first().global_depth
    keys = spark.createDataFrame([(i,) for i, _ in rows], "doc_id long")
    assert {r.doc_id: r.shard for r in sharding.shards_of(keys, table).collect()} == {r.doc_id: r.shard for r in got}
    hot = spark.createDataFrame([(1, "x" * 100)] * 50 + [(2, "y" * 5000)], "doc_id long, text string")
    got = sharding.assign(hot, byte_limit=1000).collect()
    assert len(got) == 51 and all(r.fits for r in got if r.doc_id == 1) and [r.fits for r in got if r.doc_id == 2] == [False]
    got = {(r.doc_id, r.shard_bytes, r.fits) for r in sharding.assign(odd, byte_limit=1000).collect()}
    assert {r[0] for r in got if not r[2]} == {4, 5} and all(r[1] <= 1000 for r in got if r[2]) and len({r[0] for r in got}) == 9
    assert sharding.assign(none).count() == 0 and sharding.assign(clashing).count() == 6


def test_licences(spark, odd, none, clashing):
    mit = licences.KNOWN["MIT"][2]
    rows = [(1, "Copyright (c) 2020 Some Body\n" + mit.upper().replace(" ", "  ")), (2, "a text\nLICENSED under the Apache Licence - version 2.0\nrest"), (3, "All rights reserved\n© 2021 x\nReleased under the MIT license"), (4, "nothing")]
    got = {r.doc_id: (r.license, r.notices, r.n_notices, r.n_copyright) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", "", 0, 1), 2: (None, "Apache-2.0", 1, 0), 3: (None, "All-Rights-Reserved,MIT", 2, 1), 4: (None, "", 0, 0)}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    want = con.execute(licences.oracle())
    columns = [c[0] for c in want.description]
    mine = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).select(*columns).collect()
    assert sorted((tuple(r) for r in mine), key=str) == sorted(want.fetchall(), key=str)
    assert licences.scan(odd).count() == 11 and licences.scan(none).count() == 0 and licences.scan(clashing).count() == 6


def test_whole_licences_and_headers(spark):
    """Texts as they are found in files: titled, wrapped, without their appendix, and headers in comments."""
    folder = pathlib.Path(licences.__file__).parent / "licence_texts"
    rows, want = [], {}

    def add(body, name):
        rows.append((len(rows), body))
        want[rows[-1][0]] = name

    for f in sorted(folder.glob("*.txt")):
        body, name = f.read_text(encoding="utf-8"), f.stem.split("~")[0]
        add(body, name)
        add("Copyright (c) 2024 A. Person\n\n" + body.replace("\n", "\r\n"), name)
        add("\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", body)), name) if "BSD" not in name else None
    mit = licences.KNOWN["MIT"][2].replace("\n", "\n\n")
    bsd = (folder / "BSD-3-Clause.txt").read_text()
    gpl = (folder / "GPL-3.0.txt").read_text()
    for width in (66, 72, 78, 80):
        add("# The MIT License (MIT)\n\nCopyright (c) 2020 Some Body\n\n" + "\n\n".join(textwrap.fill(p, width) for p in mit.split("\n\n")), "MIT")
    add("MIT License\n\nCopyright (c) 2020 Some Body\nAll rights reserved.\n\n" + mit, "MIT")
    add("BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + bsd.replace("* ", "1. ", 1).replace("* ", "2. ", 1).replace("* ", "3. ", 1), "BSD-3-Clause")
    add(gpl[: gpl.index("How to Apply")], "GPL-3.0")
    add("MIT License\nand some other words", None)
    rows.append((len(rows), '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use\n// SPDX-License-Identifier: GPL-2.0-or-later\n * License, v. 2.0. If a copy of the MPL was not distributed with this'))
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k].license for k in want} == want
    assert (got[len(rows) - 1].notices, got[len(rows) - 1].n_notices) == ("Apache-2.0,GPL-2.0,MPL-2.0", 3)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    told = {r[0]: r[2:5] for r in con.execute(licences.oracle()).fetchall() if "\r" not in rows[r[0]][1]}
    assert told == {k: (got[k].license, got[k].notices, got[k].n_notices) for k in told}


SEED = 42


def spark_hash(*values):
    """xxhash64 of whole numbers (64 bits, 32 bits as a pair with its width) and texts, each with the one before as seed."""
    h = SEED
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(data, seed=h)
    return h - (1 << 64) if h >> 63 else h


def brute_prints(texts, low, high):
    """Fingerprints as strings, by plain loops over words."""
    terms = [{spark_hash(w) for w in re.findall(r"[^\W_]+", t.lower())} for t in texts]
    df = {}
    for ts in terms:
        for t in ts:
            df[t] = df.get(t, 0) + 1
    band = {t for t, n in df.items() if max(2, low * len(texts)) <= n <= max(2, high * len(texts))}

    def of(text):
        every = sorted({spark_hash(w) for w in re.findall(r"[^\W_]+", text.lower())})
        held = [t for t in every if t in band]
        level = len(held).bit_length() - 1 if held else 0
        parts = []
        for depth in range(level, level + 3):
            for j in range(imatch.SUBSETS):
                drawn = [h for h in (spark_hash(t, (j // 3,)) for t in held) if not h & ((1 << depth) - 1) << j % 3 * 21]
                parts.append(f"{spark_hash(*drawn) & 0xFFFF:04x}" if drawn else "-")
        return ".".join([str(level), f"{spark_hash(*(held or every)) & (1 << 64) - 1:016x}", *parts])

    return of


def brute_likeness(a, b):
    if a == b:
        return 1.0
    (la, _, *x), (lb, _, *y) = a.split("."), b.split(".")
    at = lambda l, parts: {(int(l) + k // imatch.SUBSETS, k % imatch.SUBSETS): p for k, p in enumerate(parts)}  # noqa: E731,E741
    x, y = at(la, x), at(lb, y)
    told = [(x[k], y[k]) for k in x.keys() & y.keys() if (x[k], y[k]) != ("-", "-")]
    return sum(p == q for p, q in told) / len(told) if told else 0.0


def brute_edited(rows, low, high):
    """The result's rows from (id, text) rows: repeats of both are one document."""
    of = brute_prints([t or "" for _, t in rows], low, high)
    key = lambda r: (r[0] is not None, r[0] or 0, spark_hash(*([] if r[0] is None else [r[0]]), r[1]), spark_hash(r[1], (1,), *([] if r[0] is None else [r[0]])))
    rows = [(i, t or "") for i, t in rows]
    order = sorted(set(rows), key=key, reverse=True)
    out = {}
    for k, (i, t) in enumerate(order):
        following, cut = order[(k + 1) % len(order)][1], len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        a, b, c = of(t), of(edited), of(following)
        out[(i, t)] = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, brute_likeness(a, b), brute_likeness(a, c))
    return sorted((out[r] for r in rows), key=str)


def test_fingerprints(spark, odd, none, clashing):
    rnd = random.Random(9)
    rows = [(i, prose(rnd, rnd.choice([3, 30, 120, 300]))) for i in range(40)] + [(99, ""), (97, None)]
    rows += [(98, rows[3][1]), (5, rows[5][1]), (5, "other words of one id"), (None, rows[6][1]), (None, "no id")]
    for low, high in ((0.05, 0.3), (0.0005, 0.05)):
        df = imatch.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), low=low, high=high)
        got = sorted((tuple(r) for r in df.collect()), key=str)
        assert [r[:5] for r in got] == [r[:5] for r in brute_edited(rows, low, high)]
        assert all(abs(x - y) < 1e-12 for r, w in zip(got, brute_edited(rows, low, high), strict=True) for x, y in zip(r[5:], w[5:], strict=True))
    assert np.mean([r[5] for r in got]) > np.mean([r[6] for r in got]) + 0.1
    plain = [(r.doc_id, r.text) for r in odd.collect()]
    told = sorted((tuple(r) for r in imatch.edited_fingerprints(odd).collect()), key=str)
    assert [r[:5] for r in told] == [r[:5] for r in brute_edited(plain, imatch.LOW, imatch.HIGH)]
    assert imatch.edited_fingerprints(none).count() == 0
    same = [(r.doc_id, r.text) for r in clashing.collect()]
    assert sorted((tuple(r)[:5] for r in imatch.edited_fingerprints(clashing).collect()), key=str) == [r[:5] for r in brute_edited(same, imatch.LOW, imatch.HIGH)]


def brute_bm25(index, hashes):
    units = {}
    for t in set(hashes):
        if t in index.lists:
            for k, x in zip(*index.lists[t], strict=True):
                units[int(k)] = units.get(int(k), 0.0) + float(x)
    return {k: x for k, x in units.items() if x >= decontaminate.THRESHOLD - 1e-9}


def test_block_max_wand_gives_all_above_the_threshold():
    rnd = random.Random(8)
    items = [(i, prose(rnd, rnd.randint(5, 150)) + ". " + prose(rnd, 3) + ".") for i in range(120)]
    index = decontaminate.Index(items)
    for _ in range(150):
        words = prose(rnd, 80).split()
        for _ in range(rnd.randint(0, 3)):
            t = items[rnd.randrange(120)][1].split()
            at, a = rnd.randrange(40), rnd.randrange(len(t))
            words[at:at] = t[a : a + rnd.choice([10, 30, 64])]
        passage = decontaminate._word_hashes([" ".join(words)])[0].tolist()
        found = index.search(sorted(set(passage)))
        assert len(found) == len(dict(found))
        want = brute_bm25(index, passage)
        assert set(dict(found)) == set(want)
        assert all(abs(want[k] - x) < 1e-9 for k, x in found)


def brute_contaminated(docs, items):
    """What the operator tells, by every passage scored against every unit of every item, in plain Python."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    units = [(i, k, Counter(w[at : at + 64])) for k, (i, t) in enumerate(items) for w in [words(t)] for at in range(0, len(w), 64)]
    df, mean = Counter(t for _, _, u in units for t in u), sum(sum(u.values()) for _, _, u in units) / max(len(units), 1)
    weight = []
    for _, _, u in units:
        size = sum(u.values())
        raw = {t: math.log(1 + (len(units) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean)) for t, f in u.items()}
        weight.append({t: x / sum(raw.values()) for t, x in raw.items()})
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    out = {}
    for d, t in docs:
        w, places = words(t), {}
        for a in range(0, max(len(w), 1), 64):
            held = set(w[a : a + 128])
            for (_, k, _), x in zip(units, weight, strict=True):
                score = sum(v for term, v in x.items() if term in held)
                if score >= 0.6 - 1e-9:
                    places.setdefault(k, []).append((a, min(a + 128, len(w)), score))
        for k, found in places.items():
            item, body = items[k]
            q, s = decontaminate.split_answer(body)
            asked, said, gap, regions = words(q), set(words(s)), 128 + math.ceil(0.2 * len(words(body))), []
            for a, b, score in found:
                if regions and a - regions[-1][1] <= gap:
                    regions[-1] = [regions[-1][0], b, max(score, regions[-1][2])]
                else:
                    regions.append([a, b, score])
            n = min(5, len(asked))
            for a, b, score in regions:
                want, have = grams(asked, n), set(w[a:b])
                share = len(want & grams(w[a:b], n)) / len(want) if want else 1.0
                told = len(said & have) / len(said) if said else 1.0
                if share >= 0.8 - 1e-9 and told >= 0.5 - 1e-9:
                    out[(d, item)] = max(out.get((d, item), (0, 0, 0)), (score, share, told))
    return out


def partly_leaked(rnd, n_items=40, n_docs=240):
    items = [(f"item-{i}", prose(rnd, rnd.choice([20, 60, 100, 200])) + ". " + prose(rnd, 4) + ".") for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        w = items[rnd.randrange(n_items)][1].split()
        for _ in range(rnd.choice([0, 1, 3, 8])):
            w[rnd.randrange(len(w))] = prose(rnd, 1)
        cut = rnd.randrange(len(w) // 2)
        docs.append((d, " ".join([prose(rnd, 90), *w[cut if d % 3 == 0 else 0 :], prose(rnd, 30)])))
    return items, docs


def test_decontamination_in_blocks(spark):
    """Text ids, passages leaked in part, and one block or many: always the rows and scores of the brute-force version."""
    items, docs = partly_leaked(random.Random(21))
    brute = brute_contaminated(docs, items)
    assert 40 < len(brute) < 240
    bench, table = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for block_bytes in (None, 4000):
        got = {(r.doc_id, r.item_id): tuple(r)[2:] for r in decontaminate.contaminated(table, bench, block_bytes=block_bytes).collect()}
        assert got.keys() == brute.keys()
        assert all(abs(x - y) < 1e-6 for k in got for x, y in zip(got[k], brute[k], strict=True))
        kept = decontaminate.keep_uncontaminated(table, bench, block_bytes=block_bytes)
        assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in docs} - {d for d, _ in brute})


def test_question_and_answer_must_be_in_one_place(spark):
    rnd = random.Random(22)
    question, answer = prose(rnd, 120) + "?", "zebra quartz violin"
    docs = [(0, f"{question} {answer}"), (1, f"{question} {prose(rnd, 900)} {answer}"), (2, f"{prose(rnd, 300)} {question} {prose(rnd, 30)} {answer}")]
    bench = spark.createDataFrame([(7, f"{question} {answer}")], "item_id int, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id int, text string"), bench).collect()
    assert sorted(r.doc_id for r in got) == sorted({d for d, _ in brute_contaminated(docs, [(7, f"{question} {answer}")])}) == [0, 2]


def test_decontamination(spark, odd, none, clashing):
    rnd = random.Random(6)
    items = [(i, prose(rnd, rnd.choice([3, 20, 60, 150])).capitalize() + ". " + prose(rnd, 4) + ".") for i in range(60)] + [(None, None), (61, "")]
    docs, want = [], set()
    for d in range(200):
        words = [prose(rnd, rnd.choice([5, 90, 400]))]
        if d % 4 == 0:
            k = rnd.randrange(60)
            words.insert(rnd.randrange(2), items[k][1].upper() if d % 8 else items[k][1])
        docs.append((d, " ".join(words)))
    held = [(i, " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " ") for i, t in items]
    for d, t in docs:
        body = " " + " ".join(re.findall(r"\w+", t.lower())) + " "
        want |= {(d, i) for i, x in held if x.strip() and x in body}
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = decontaminate.contaminated(table, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    brute = brute_contaminated(docs, items)
    assert got == set(brute) and got >= want
    assert all(abs(x - y) < 1e-6 for r in rows for x, y in zip(tuple(r)[2:], brute[(r.doc_id, r.item_id)], strict=True))
    kept = decontaminate.keep_uncontaminated(table, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.keep_uncontaminated(odd, bench).count() == 11
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(clashing, bench.limit(0)).count() == 0


def test_decontamination_of_tables_with_clashing_names(spark, clashing):
    items = [(7, "text number 3 of a small set of texts"), (9, "nothing of this kind is in there at all")]
    bench = spark.createDataFrame([(*x, 1, 2.0, "h", 3, 4) for x in items], "item_id long, text string, doc_id long, score double, hash string, row long, n long")
    docs = [(r.doc_id, r.text) for r in clashing.collect()]
    brute = set(brute_contaminated(docs, items))
    assert (3, 7) in brute
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(clashing, bench).collect()} == brute
    kept = decontaminate.keep_uncontaminated(clashing, bench)
    assert kept.columns == clashing.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in brute}


def test_indexes_of_many_items_come_in_blocks(spark):
    bench = spark.createDataFrame([(i, f"item number {i} " * 20) for i in range(40)], "item_id long, text string")
    blocks = list(decontaminate.indexes(bench, block_bytes=4000))
    assert len(blocks) > 1 and sorted(i for b in blocks for i in b.ids) == list(range(40))


def test_factorisation_machine_identity():
    rng = np.random.default_rng(0)
    present, stats = rng.random((5, quality.BUCKETS)) < 0.05, rng.random((5, len(quality.STATISTICS))).astype(np.float32)
    width = quality.BUCKETS + 3 * len(quality.STATISTICS)
    m = quality.Machine(np.zeros(len(quality.STATISTICS)), np.ones(len(quality.STATISTICS)), 0.1, rng.normal(size=width) * 0.1, rng.normal(size=(width, 3)) * 0.1)
    x = m.matrix(present, stats, m.mean, m.scale)
    for row, got in zip(x, m.score(present, stats), strict=True):
        i, j = np.triu_indices(width, 1)
        y = m.w0 + row @ m.w + ((m.v[i] * m.v[j]).sum(axis=1) * row[i] * row[j]).sum()
        assert abs(1 / (1 + np.exp(-y)) - got) < 1e-4


def labelled_table(spark, rnd, bad, n=400, column="quality", value=0):
    docs, labels = [], []
    for i in range(n):
        odd_one = i % 4 == 0
        docs.append((i, bad(prose(rnd, 60)) if odd_one else prose(rnd, 60)))
        labels.append((i, value if odd_one else 1 - value))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {column} int")


def test_quality(spark, odd, none, clashing):
    docs, labels = labelled_table(spark, random.Random(1), lambda t: " ".join(w.upper() + "!!" for w in t.split()))
    machine = quality.train(docs, labels)
    rows = quality.score(docs, machine).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in quality.score(docs, machine).collect())
    assert quality.keep_good(docs, machine).count() == quality.score(docs, machine).where("predicted = 1").count()
    assert quality.score(odd, machine).count() == 11 and quality.score(none, machine).count() == 0
    assert quality.keep_good(clashing, machine).columns == clashing.columns
    empty = quality.train(none, labels)
    assert quality.score(odd, empty).where("score = 0.5").count() == 11


def test_toxicity(spark, odd, none, clashing):
    rnd = random.Random(3)
    docs, labels = labelled_table(spark, rnd, lambda t: t.replace(" ", f" {rnd.choice(['idiot', 'worthless'])} ", 2), column="toxic", value=1)
    lexicon = toxicity.train(docs, labels)
    assert lexicon.terms == ["idiot", "worthless"]
    rows = toxicity.score(docs, lexicon).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and sum(r.predicted == r.toxic for r in rows) >= 0.97 * len(rows)
    reader = toxicity.Reader(lexicon)
    part = next(text.slices(toxicity.lowered(pa.array(["you Idiot", "you idiott", "the word “idiot” is said", "nothing", None]))))[1]
    x = reader.features(part)
    assert x[0, 0] > 0 and x[0, 5] > 0 and x[1, 2] > 0 and x[1, 0] == 0 and x[2, 4] > 0 and x[2, 0] == 0 and not x[3:].any()
    assert toxicity.score(odd, lexicon).count() == 11 and toxicity.score(none, lexicon).count() == 0
    assert toxicity.keep_clean(clashing, lexicon).columns == clashing.columns
    unlearnt = toxicity.train(none, labels)
    assert unlearnt.terms == [] and toxicity.score(odd, unlearnt).count() == 11


def test_words_of_any_length_are_matched():
    term = "неприятность" * 9
    lexicon = toxicity.Lexicon([term], [3.0], reporting=frozenset({"told"}), addressing=frozenset({"thee"}))
    reader = toxicity.Reader(lexicon)
    part = next(text.slices(toxicity.lowered(pa.array([f"thee {term}ы", f"told {term}", f"x {term}яяя", "q" * 100_000]))))[1]
    x = reader.features(part)
    assert x[0, 2] > 0 and x[0, 5] > 0 and x[1, 4] > 0 and not x[2:].any()


def test_terms_of_a_set_phrase_are_learnt_and_words_of_copies_are_not(spark):
    rnd = random.Random(11)
    docs, labels = labelled_table(spark, rnd, lambda t: t.replace(" ", " such zzvermin ", 1), column="toxic", value=1)
    copied = prose(rnd, 60).split()
    copies = []
    for i in range(60):
        w = list(copied)
        w[rnd.randrange(60)], w[rnd.randrange(60)] = prose(rnd, 1), "qqcopied"
        copies.append((1000 + i, " ".join(w)))
    docs = docs.union(spark.createDataFrame(copies, docs.schema))
    labels = labels.union(spark.createDataFrame([(i, 1) for i, _ in copies], labels.schema))
    terms = toxicity.train(docs, labels).terms
    assert "zzvermin" in terms and "qqcopied" not in terms


def test_lexicon_terms_are_told_exactly(spark, monkeypatch):
    """The bitmap's size must not count: a term outside the band that shares a slot with one inside is no lexicon term."""
    rnd = random.Random(12)
    rows = spark.createDataFrame([(i, prose(rnd, 120)) for i in range(30)], "doc_id long, text string")
    found = {}
    for slots in (8, 21):
        monkeypatch.setattr(imatch, "SLOTS", slots)
        found[slots] = {r.doc_id: (r.fingerprint, r.edited_fingerprint) for r in imatch.edited_fingerprints(rows, low=0.05, high=0.3).collect()}
    assert found[8] == found[21]


def test_scores_of_items_do_not_depend_on_the_blocks(spark):
    rnd = random.Random(13)
    bench = spark.createDataFrame([(i, prose(rnd, rnd.choice([20, 60, 100]))) for i in range(60)], "item_id long, text string")

    def weights(blocks):
        return {(b.ids[b.item[k]], t, round(float(x), 9)) for b in blocks for t, (ks, xs) in b.lists.items() for k, x in zip(ks, xs, strict=True)}

    blocks = list(decontaminate.indexes(bench, block_bytes=4000))
    assert len(blocks) > 1 and weights(blocks) == weights(decontaminate.indexes(bench))


def test_words_of_very_long_texts_tell():
    """Two texts that have every bucket, but not as often, have different word features."""
    every = [f"word{i}" for i in range(20_000)]
    part = next(text.slices(pa.array([" ".join(every + every[:4000]), " ".join(every + every[4000:8000])], pa.large_string())))[1]
    present, stats = quality.features(part)
    x = quality.Machine.matrix(present, stats, stats.mean(axis=0), stats.std(axis=0) + 1e-3)[:, : quality.BUCKETS]
    assert (x > 0).all() and np.abs(x[0] - x[1]).max() > 1e-3


def test_buckets_of_long_texts_and_hot_centres_give_the_same_groups(spark, monkeypatch):
    """Texts that repeat one line have few shingles and many bytes; a centre of many members is dealt out."""
    rnd = random.Random(21)
    base = prose(rnd, 60).split()
    rows = [(i, "one line of many words that is there again\n" * (200 + i)) for i in range(6)]
    for i in range(120):
        w = list(base)
        w[rnd.randrange(60)] = prose(rnd, 1)
        rows.append((100 + i, " ".join(w)))
    other = prose(rnd, 60).split()
    for i in range(40):
        w = list(other)
        for _ in range(rnd.randint(1, 4)):
            w[rnd.randrange(60)] = prose(rnd, 1)
        rows.append((400 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows, 3, 85, 100)
    for block, few in ((1 << 26, 1000), (500, 7)):
        monkeypatch.setattr(near_dedup, "BLOCK_BYTES", block)
        monkeypatch.setattr(near_dedup, "FEW_ROWS", few)
        got = near_dedup.near_duplicates(docs, shingle=3, num=85, den=100).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(want)


def test_near_duplicates_of_ids_of_any_type(spark, odd):
    rnd = random.Random(22)
    texts = [prose(rnd, 30) for _ in range(5)]
    rows = [(f"id {9 - i % 10}{'x' * (i // 10)}", texts[i % 5]) for i in range(20)] + [(None, texts[0]), ("alone", "nothing like it here"), ("alone", "nothing like it here"), ("empty", None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    least = {t: min(i for i, u in rows if i is not None and u == t) for t in texts}
    want = [(i, i if t not in least else least[t] if i is not None else None) for i, t in rows]
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    as_text = near_dedup.near_duplicates(odd.selectExpr("lpad(doc_id, 3, '0') AS doc_id", "text")).collect()
    as_long = near_dedup.near_duplicates(odd).collect()
    name = lambda i: None if i is None else f"{i:03d}"
    assert sorted(map(tuple, as_text), key=str) == sorted(((name(r.doc_id), r.n_shingles, name(r.component_id), r.kept) for r in as_long), key=str)


def plain_toxicity(lexicon, value):
    """The score of a text, each word held against each term by its edit distance."""

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    value = (value or "").lower()
    words = [(m[0], m.start(), m.end()) for m in re.finditer("[a-z0-9\u00aa\u00b5\u00ba\u00c0-\u1fff\u2070-\u2fff\u3040-\U0010ffff]+", value)]
    exact, near, quoted, addressed = [], [], 0, 0
    for i, (w, a, b) in enumerate(words):
        found = min(((edits(w, t), k) for k, t in enumerate(lexicon.terms) if edits(w, t) <= levenshtein.edits(t)), default=None)
        if not found or (found[0] and w in lexicon.spared):
            continue
        around = {x for j, (x, _, _) in enumerate(words) if j != i and abs(j - i) <= toxicity.WINDOW}
        left, right = value[:a].encode()[-lexicon.marks :], value[b:].encode()[: lexicon.marks]
        marked = (left.count(b'"') % 2 == 1 and b'"' in right) or any(left.rfind(o.encode()) > left.rfind(c.encode()) and c.encode() in right for o, c in zip("“„«‹", "”“»›", strict=True))
        to = bool(around & lexicon.addressing)
        if marked or (around & lexicon.reporting and not to):
            quoted += 1
            continue
        addressed += to
        (near if found[0] else exact).append(lexicon.weights[found[1]] / (1 + found[0]))
    x = [max(exact, default=0) / 5, math.log1p(len(exact)), max(near, default=0) / 5, math.log1p(len(near)), math.log1p(quoted), math.log1p(addressed), 10 * (len(exact) + len(near) + quoted) / max(len(words), 1)]
    return 1 / (1 + math.exp(-(lexicon.intercept + sum(p * q for p, q in zip(x, lexicon.coefficients, strict=True)))))


def test_toxicity_scores_are_those_of_a_plain_version(spark, odd, clashing):
    rnd = random.Random(31)
    terms = ["idiot", "scoundrel", "worthless"]
    lexicon = toxicity.Lexicon(terms, [3.0, 2.0, 4.0], frozenset({"idiom"}), intercept=-2.0, coefficients=[1.5, 0.7, 0.9, 0.4, -0.8, 0.6, 0.2], marks=12)
    vocabulary = [*terms, "idiott", "idoit", "idiom", "scoundrl", "worthles", "you", "said", "«", "»", '"', "“", "”", "word", "plain", "text", "of", "more", "words"]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30)))) for i in range(150)]
    tables = [spark.createDataFrame(rows, "doc_id long, text string"), odd, clashing]
    for docs in tables:
        told = sorted(((r.doc_id, round(r.score, 9), r.predicted) for r in toxicity.score(docs, lexicon).collect()), key=str)
        want = [(r.doc_id, plain_toxicity(lexicon, r.text)) for r in docs.collect()]
        assert told == sorted(((i, round(x, 9), int(x >= 0.3)) for i, x in want), key=str)


def test_lexicon_is_bounded_and_no_column(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"common{i % 3} shared{i % 5} own{i}") for i in range(60)], "doc_id long, text string")
    work = Workspace(spark, "lexicon-test")
    held = imatch.lexicon(rows, work, low=0.05, high=0.3)
    assert len(held.first()["hashes"]) == 5  # "shared" words are in a fifth, "common" ones in a third, own words in one
    plan = imatch.fingerprint(rows, F.col("text"), held, "print")._jdf.queryExecution().executedPlan().toString()
    assert "_lexicon" not in plan and "Subquery" in plan
    monkeypatch.setattr(imatch, "MOST", 4)
    with pytest.raises(ValueError, match="raise low"):
        imatch.lexicon(rows, work, low=0.05, high=0.3)
    drop(spark, work.root)
