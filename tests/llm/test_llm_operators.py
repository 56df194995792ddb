"""Each operator against a plain Python version, an exact round trip or held-out labels."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearthvale.llm import decontaminate, licenses, line_dedup, packing, passages, queries, simhash, token_store, tokens, topk
from hearthvale.llm import wordhash
from hearthvale.llm.common import scratch
from hearthvale.llm.components import components

SMALL = "/root/testdata/sf0.001"
WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries._tokenizer(name))


ODD = ["a", "b", "Z", "é", "É", "é", "'", "'s", "don't", "I'm", "|", " | ", "\n", "\n\n", " ", "  ", "\t", "\r", "\x0b",
       "\x1c", "\x85", "\xa0", " ", "​", "　", ",", ".", "!!", "1", "23", "½", "世界", "🙂", "ß", "İ", "ſ",
       "́", "", "", "<|endoftext|>", "<|startoftext|>", "<|ENDofTEXT|>", "<|endof", "text|>", "\x00", "the ", " of", "and", "Hello", "international", " Unbelievably", "straße", "àéîõüÿ", "Ångström", " façade", "ÀÖØ", "aà", "í", "Ð"]


@pytest.mark.parametrize("name,mode", [(WORD, "word"), (BYTE, "byte")])
def test_cached_encoder_equals_the_library(name, mode, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    rnd = random.Random(5)
    texts = ["", " ", "a ", " a", "a  b", "\n", "a\nb", "a \nb", "|"] + [
        "".join(rnd.choice(ODD) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    enc, lib = tokens.CachedEncoder(queries._tokenizer(name), mode), library(name)
    for i in range(0, len(texts), 200):
        some = texts[i:i + 200]
        for text, ids in zip(some, enc.encode(pa.array(some)).to_pylist()):
            assert np.frombuffer(ids, enc.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids + [2], text


def test_packing_is_gapless_and_exact(spark, docs):
    got = queries.op1_packing(spark, SMALL).toPandas().sort_values(["sequence_id", "offset"])
    lib, ids = library(WORD), {}
    for r in docs.select("doc_id", "text").collect():
        ids[r.doc_id] = np.array(lib.encode(r.text, add_special_tokens=False).ids + [2], "<u4")
    place = got.sequence_id * 4096 + got.offset
    assert (place.values == np.r_[0, np.cumsum(got.length)[:-1]]).all()
    assert got.length.sum() == sum(map(len, ids.values()))
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])


def test_perfect_hash_is_minimal_and_total():
    keys = np.unique(np.random.default_rng(1).integers(-2 ** 62, 2 ** 62, 20000)).view(np.uint64)
    h = token_store.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))


def test_store_round_trip_in_key_order(spark, docs):
    got = queries.op4_token_store(spark, SMALL).toPandas().sort_values("doc_id")
    lib = library(BYTE)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want = [np.array(lib.encode(texts[i], add_special_tokens=False).ids + [2], "<u4") for i in sorted(texts)]
    assert got.doc_id.tolist() == sorted(texts)
    assert got.ids_crc32.tolist() == [zlib.crc32(x.tobytes()) for x in want]
    assert got.start.tolist() == [0, *np.cumsum([len(x) for x in want])[:-1].tolist()]


def test_store_hot_key_nulls_and_absent_keys(spark):
    rows = [(7, f"copy {i % 3}") for i in range(300)] + [(None, "lost"), (None, None), (1, ""), (9, "x")]
    path = scratch(spark, "store")
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), path, queries._tokenizer(BYTE), shards=5)
    asked = spark.createDataFrame([(7,), (7,), (None,), (1,), (2,), (10 ** 15,)], "doc_id long")
    got = token_store.read_keys(spark, path, asked).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", *["7"] * 300, "None", "None"]
    assert sorted(r.start for r in got)[0] == 0 and len({r.start for r in got}) == 303


def test_store_manifest_is_one_file_with_a_row_per_shard(spark):
    path = scratch(spark, "store")
    rows = [(i, f"text {i}") for i in range(400)] + [(None, "lost")]
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), path, queries._tokenizer(BYTE), shards=6)
    manifest = spark.read.parquet(f"{path}/manifest")
    got = sorted(manifest.collect())
    assert len(manifest.inputFiles()) == 1
    assert [r["shard"] for r in got] == list(range(6)) and sum(r["rows"] for r in got) == 401 and sum(r["nulls"] for r in got) == 1
    assert all(a["high"] < b["low"] for a, b in zip(got, got[1:]))


def test_word_hashes_of_long_and_null_texts():
    h, cut = wordhash.word_hashes(pa.array(["The the, THE é-è", None, "", "a" * 3_000_000 + " b", " b c"]))
    assert cut.tolist() == [0, 5, 5, 5, 7, 9] and h[0] == h[1] == h[2] and h[6] == h[7]


def test_components_of_path_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[i] for i in range(1000, 1300)}) == 1
    assert len(set(got.values())) == 3


def brute_components(f):
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1:]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


@pytest.mark.parametrize("bucket", [3, 10 ** 6])
def test_simhash_links_equal_brute_force(spark, bucket):
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2 ** 64, 6, dtype=np.uint64)
    f = [int(c) for c in centre]
    for c in centre:                                   # dense groups of near fingerprints, and loose ones
        for _ in range(40):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            f.append(x)
    f = np.unique(np.array(f, np.uint64))
    fps = spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(f.view(np.int64))], "id long, fp long")
    got = {r.fp: r.component_id for r in simhash.classes(fps, "id", bucket).collect()}
    assert [got[int(x)] for x in f.view(np.int64)] == brute_components(f)


def test_simhash_documents(spark, docs):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    f = np.array([simhash.fingerprint(r.text) for r in rows], np.uint64)
    root = brute_components(f)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, SMALL).collect()}
    assert got == {r.doc_id: (f"{int(x):016x}", rows[k].doc_id) for r, x, k in zip(rows, f, root)}


def test_simhash_keep_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(3, text, "a"), (2, text, "b"), (2, text, "b"), (None, text, "c"), (8, "quite another text", None), (9, None, None), (10, "", "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id, r.fp) for r in simhash.keep_one(d).collect() if r.doc_id != 9)
    assert got == [(2, "b"), (8, None)]


def test_licences_equal_plain_scan(spark):
    notice = "Released under\nthe MIT License."
    texts = ["CC-BY, cc by CC.BY", "All rights reserved. " + notice, "This work is licensed under the GNU General Public License, version 3.",
             "licensed under the gnu lesser general public license", "released under the fit license", "rights reserved all", "", None, "by", "é cc　by"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(d).collect()}
    word, low = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in enumerate(texts):
        w = word.findall((text or "").translate(low))
        at = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k:k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[1].labels == "mit,reserved" and got[2].labels == "gpl,gpl-3.0" and got[3].labels == "gpl,lgpl" and got[4].labels == ""


def test_leaks_exact_and_edited_but_not_clean(spark):
    rnd = random.Random(2)
    new = lambda n: [f"v{rnd.randrange(10 ** 6)}" for _ in range(n)]
    items = [(i, " ".join(new(30))) for i in range(5)] + [(5, "just three words"), (6, None), (7, "")]
    words = items[1][1].split()
    edited = [w if i % 9 else "changed" for i, w in enumerate(words)]
    half = words[:12]
    texts = [" ".join(new(50) + words + new(50)), " ".join(new(20) + edited + new(9)).upper(), " ".join(new(40) + half + new(40)),
             " ".join(new(200)), "", None, "so it is just three words, yes", " ".join(words)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(d, b, ["doc_id"], F.col("text")).collect())
    assert got == [(0, 1), (1, 1), (6, 5), (7, 1)]
    kept = decontaminate.clean(d.withColumn("item_id", F.lit(1)), b)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5] and kept.columns == ["doc_id", "text", "item_id"]


@pytest.mark.parametrize("n", [5, 10, 15, 30, 40, 60])
def test_leaks_edited_copies_beside_exact_ones(spark, n):
    rnd = random.Random(n)
    new = lambda k: [f"v{rnd.randrange(10 ** 6)}" for _ in range(k)]
    words, docs, want = new(n), [], set()
    for step in (5, 6, 7, 8):
        for first in range(step):
            edited = ["changed" if i % step == first else w for i, w in enumerate(words)]
            if sum(a == b for a, b in zip(words, edited)) >= 0.8 * n:
                want.add(len(docs))
            docs.append(new(30) + edited + new(30))
    for _ in range(5):                                 # exact copies, so every gram of the item is frequent
        want.add(len(docs))
        docs.append(new(20) + words + new(20))
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.leaks(d, b, ["doc_id"], F.col("text")).collect()}
    assert len(want) > 5 and got >= want               # chance matches of an edge word may add documents


def test_alignment_counts_matched_words():
    a, b = np.arange(10, dtype=np.uint64), np.array([90, 0, 1, 2, 91, 4, 5, 6, 7, 92, 8, 9, 93], np.uint64)
    assert decontaminate.align(a, b) == (9, 12)
    assert decontaminate.align(a, b[:0]) == (0, 0)


def test_passages_found_across_documents(spark):
    rnd = random.Random(3)
    new = lambda n: [f"v{rnd.randrange(10 ** 6)}" for _ in range(n)]
    shared, other = new(70), new(90)
    fuzzy = [w if i % 17 else "edit" for i, w in enumerate(other)]
    copy = new(200)
    texts = [new(80) + shared + new(30), new(10) + shared, other + new(300), new(100) + fuzzy, new(400), copy, copy, [], new(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(50, None), (None, " ".join(new(5) + shared))]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {frozenset((r.doc_id, r.other_id)): r for r in got}
    assert {frozenset((2, 3)), frozenset((5, 6))} <= set(pairs)
    linked = [p for p in pairs if p <= {0, 1, None}]
    assert len(set().union(*linked)) == 3 and len(pairs) == len(linked) + 2
    r = pairs[frozenset((5, 6))]
    assert (r.begin, r.end, r.other_begin, r.other_end, r.identity) == (0, 200, 0, 200, 1.0)


@pytest.mark.parametrize("copies", [1, 12])
def test_passages_whose_halves_stand_earlier_elsewhere(spark, copies):
    rnd = random.Random(6)
    new = lambda n: [f"v{rnd.randrange(10 ** 6)}" for _ in range(n)]
    x, y, long = new(30), new(30), new(80)
    edited = [w if i % 3 else f"e{i}" for i, w in enumerate(long)]      # too far from the original, itself copied
    texts = [new(9) + x + new(40) for _ in range(copies)] + [new(40) + y + new(9) for _ in range(copies)]
    texts += [new(50) + x + y + new(20), new(10) + x + y + new(60), new(5) + long, new(30) + edited, edited + new(7)]
    n = len(texts) - 5
    got = passages.shared_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    pairs = {frozenset((r.doc_id, r.other_id)): (r.end - r.begin, r.identity) for r in got.collect()}
    assert pairs == {frozenset((n, n + 1)): (60, 1.0), frozenset((n + 3, n + 4)): (80, 1.0)}


def test_edited_passage_of_frequent_seeds_alone(spark):
    rnd = random.Random(12)
    new = lambda n: [f"v{rnd.randrange(10 ** 6)}" for _ in range(n)]

    def seeded(n):                                                  # words that hold a seed
        while True:
            words = new(n)
            g = wordhash.grams(wordhash.word_hashes(pa.array([" ".join(words)]))[0], passages.K)
            if (g.view(np.uint64) % np.uint64(passages.RARITY) == 0).any():
                return words

    parts, between = [new(20) for _ in range(4)], [seeded(5) for _ in range(3)]
    texts = [new(10) + part + new(10) for part in parts + between for _ in range(9)]     # each stands earlier, and often
    edited = parts[0] + sum((b + p for b, p in zip(between, parts[1:])), [])
    texts += [new(40) + sum(parts, []) + new(20), new(10) + edited + new(50)]
    got = passages.shared_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert [(r.doc_id, r.begin, r.end, r.other_id, r.other_begin, r.other_end, round(r.identity, 2)) for r in got.collect()] == [
        (64, 10, 105, 63, 40, 120, 0.84)]


def test_every_two_occurrences_of_a_seed_are_linked(spark, monkeypatch):
    monkeypatch.setattr(passages, "PAIRED", 8)
    monkeypatch.setattr(passages, "PAIRS", 20)
    rng = np.random.default_rng(5)
    seeds = {h: sorted({(None if d == 0 else int(d), int(a), int(p)) for d, a, p in rng.integers(0, [9, 2, 4], (n, 3))},
                       key=lambda x: (x[0] is not None, x)) for h, n in enumerate([1, 2, 5, 8, 9, 16, 17, 30, 60])}
    frame = spark.createDataFrame(list(seeds.items()), "h long, at array<struct<doc: long, alt: int, pos: int>>")
    key = lambda x: tuple((v is not None, v) for v in x)
    got = sorted((tuple(r) for r in passages.linked(frame).collect()), key=key)
    assert got == sorted(((*r[:2], *q[:2], r[2], q[2]) for at in seeds.values() for i, r in enumerate(at) for q in at[i + 1:] if r[:2] != q[:2]), key=key)


def test_passages_edited_at_even_steps_and_at_random(spark):
    rnd = random.Random(7)
    new = lambda n: [f"v{rnd.randrange(10 ** 6)}" for _ in range(n)]
    rows, kinds = [], [6, 8, 10, 12, 17, 0.05, 0.1, 0.15]
    for kind in kinds:
        for _ in range(40):
            words = new(60)
            hit = set(range(kind // 2, 60, kind)) if kind >= 1 else set(rnd.sample(range(60), int(60 * kind)))
            rows += [new(40) + words + new(40), new(40) + [f"e{rnd.random()}"[:12].replace(".", "") if i in hit else w for i, w in enumerate(words)] + new(40)]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {(min(r.doc_id, r.other_id), max(r.doc_id, r.other_id)) for r in passages.shared_passages(d).collect()}
    assert all(a % 2 == 0 and b == a + 1 for a, b in got)
    for k, kind in enumerate(kinds):
        assert sum((i, i + 1) in got for i in range(80 * k, 80 * k + 80, 2)) >= 36, kind


def test_every_copy_is_linked_to_every_other_document_of_the_passage(spark):
    rnd = random.Random(3)
    new = lambda n: " ".join(f"v{rnd.randrange(10 ** 6)}" for _ in range(n))
    shared = new(90)
    texts = {1: "a " + shared, 5: "a " + shared, None: "a " + shared, 3: shared + " " + new(60), 4: shared + " " + new(60), 7: new(80)}
    texts[9] = texts[4]
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    links = passages.shared_passages(d).collect()
    key = lambda x: (x is not None, x or 0)
    docs = sorted((x for x in texts if x != 7), key=key)
    assert sorted(((r.other_id, r.doc_id) for r in links), key=lambda r: [key(x) for x in r]) == [(a, b) for i, a in enumerate(docs) for b in docs[i + 1:]]
    for r in links:
        begin, end = (texts[x].split()[y:z] for x, y, z in ((r.doc_id, r.begin, r.end), (r.other_id, r.other_begin, r.other_end)))
        assert begin == end and (len(begin) == 90) == (texts[r.doc_id] != texts[r.other_id])
    got = passages.passage_classes(d).collect()
    assert {r.doc_id: r.n_links for r in got} == {x: 5 for x in docs}
    assert {r.class_id for r in got} == {1} and {r.doc_id: r.n_words for r in got} == {None: 91, 1: 91, 5: 91, 3: 90, 4: 150, 9: 150}


def test_passage_classes_have_a_row_per_document(spark):
    rnd = random.Random(9)
    new = lambda n: [f"v{rnd.randrange(10 ** 6)}" for _ in range(n)]
    base, shared, tail = new(300), new(80), new(90)
    texts = {i: [w if rnd.random() > 0.04 else f"e{rnd.random()}".replace(".", "") for w in base] for i in range(60)}      # near copies
    texts |= {100: new(20) + shared + new(30), 101: new(50) + shared + new(40) + tail, 102: tail + new(60), 200: new(300), 201: new(20)}
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    rows += [(101, " ".join(texts[7])), (None, " ".join(new(9) + shared)), (100, rows[60][1])]       # a key of two texts, no key, a row twice
    d = spark.createDataFrame(rows, "doc_id long, text string")
    links, got = passages.shared_passages(d).collect(), passages.passage_classes(d).collect()
    assert len(links) > 4 * len(got)                               # each near copy meets several representatives
    assert {r.doc_id for r in got} == {x for r in links for x in (r.doc_id, r.other_id)}
    assert len(got) == len({(r.doc_id, r.text_hash) for r in got}) == 60 + 3 + 2 and sum(r.n_links for r in got) == 2 * len(links)
    of = {(r.doc_id, r.text_hash): r for r in got}
    copies = [r for r in got if r.doc_id is not None and r.doc_id < 60]
    assert {r.class_id for r in copies} == {0} and len({r.class_hash for r in copies}) == 1
    both = sorted((r for r in got if r.doc_id == 101), key=lambda r: r.class_id)
    assert [r.class_id for r in both] == [0, 100]                  # each text has a class of its own
    assert sorted(r.doc_id or -1 for r in got if r.class_id == 100) == [-1, 100, 101, 102]
    stretches = [(s.begin, s.end) for s in both[1].passages]
    assert stretches == [(50, 130), (170, 260)] and both[1].n_words == 170 and len(of) == 65


def test_stretches_aligned_as_by_the_full_table():
    rng = np.random.default_rng(4)

    def plain(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    def run(a, b):
        best, score, same, kept = 0, 0, 0, (0, 0)
        for i, (x, y) in enumerate(zip(a, b)):
            score, same = score + (1 if x == y else -1), same + (x == y)
            if max(best, 0) - score >= passages.DROP:
                break
            if score > best:
                best, kept = score, (i + 1, same)
        return kept

    for _ in range(1500):
        a = rng.integers(0, rng.integers(2, 30), rng.integers(0, 25)).astype("<u2")
        b = a.copy() if rng.random() < 0.6 else rng.integers(0, 30, rng.integers(0, 25)).astype("<u2")
        for _ in range(rng.integers(0, 4)):
            if len(b):
                at = rng.integers(len(b))
                b = [np.delete(b, at), np.insert(b, at, 99), np.r_[b[:at], [98], b[at + 1:]].astype("<u2")][rng.integers(3)]
        assert passages.edit_matches(a, b) == plain(a, b)
        assert passages.extend(a, b) == run(a, b)


def test_seeds_grouped_over_batches_with_null_documents(spark):
    rng = np.random.default_rng(8)
    rows = [(int(h), None if d == 3 else int(d), int(a), int(p)) for h, d, a, p in rng.integers(0, [40, 9, 2, 50], (700, 4))]
    rows += [(2 ** 62, i, 0, 5) for i in range(120)] + [(-2 ** 63, None, 1, 1), (2 ** 63 - 1, 1, 1, 1)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")     # groups go over several batches
    try:
        frame = passages.grouped(spark.createDataFrame(rows, "h long, doc long, alt int, pos int"))
        got = {r["h"]: [tuple(x) for x in r["at"]] for r in frame.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = {}
    for h, *o in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2:])):
        want.setdefault(h, []).append(tuple(o))
    assert got == {h: at for h, at in want.items() if len(at) > 1}
    assert "ObjectHashAggregate" not in frame._jdf.queryExecution().toString()


def test_seeds_of_documents_taken_together_as_of_each_alone(monkeypatch):
    class Rows:
        def mapInArrow(self, run, schema):
            return run

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 6, n)) for n in rng.integers(0, 60, 80)] + ["", "a", "a " * 200, "a a a", None, "a " * 90]

    def seeds(batches):
        run = passages.seeds(Rows())
        cols = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in b], pa.int64()), pa.array([0] * len(b), pa.int32()), pa.array([t for _, t in b], pa.string())],
                                           names=["doc", "alt", "text"]) for b in batches]
        return [r for b in run(iter(cols)) for r in b.to_pylist()]

    docs = list(enumerate(texts))
    monkeypatch.setattr(passages, "WINDOW", 100)
    together = seeds([docs])
    assert together == seeds([[d] for d in docs]) and len({r["doc"] for r in together}) > 60
    for d in (82, 85):         # a run of one gram: every RUN-th of it, if its hash is picked at all
        assert [r["pos"] for r in together if r["doc"] == d] in ([], list(range(0, len(texts[d].split()) - passages.K + 1, passages.RUN)))


def test_chains_are_collinear_and_disjoint():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    seen = set()
    for c in passages.chains(a, b):
        assert (np.diff(a[c]) > 0).all() and (np.diff(b[c]) > 0).all() and not seen & set(c.tolist())
        seen |= set(c.tolist())


def test_topk_equals_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(8)
    vecs = [rng.normal(size=8) * rng.choice([0.1, 1, 5]) for _ in range(400)]
    vecs[7] = vecs[3] = vecs[200] = vecs[11]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    bad = [(1000, None), (1050, [float("nan")] * 8), (1100, [1.0, None] * 4), (1150, [float("inf")] * 8), (None, rows[0][1]), (1200, []), (1250, [1.0, 2.0])]
    got = topk.top_products(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, 5).collect()
    m = np.floor(256 * np.array(vecs)).astype(np.int64)
    want = set()
    for q in range(0, 400, 50):
        s = m @ m[q]
        best = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        want |= {(q, k + 1, int(i), int(s[i])) for k, i in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_line_dedup_equals_plain_count(spark):
    rows = [(i, f"https://u@Host{i % 2}.org:80/p{i}", "menu\n" + f"line {i}\n\nline {i % 7}\nmenu ") for i in range(40)]
    rows += [(100, None, "menu"), (101, "no url", None), (102, "http://host0.org/x", "")]
    d = spark.createDataFrame(rows, "page_id long, url string, text string")
    got = {r.page_id: r for r in line_dedup.drop_boilerplate(d, line_dedup.host_of(F.col("url")), F.col("text"), host_out="host", dropped_out="n").collect()}
    assert len(got) == 43 and got[101].text is None and got[102].text == "" and got[100].text == "menu"
    assert got[5].host == "host1.org" and got[5].n == 2 and got[5].text == "line 5\n\nline 5"


def test_registered_sql_matches(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        a = queries.QUERIES[name](spark, SMALL).toPandas()
        b = con.execute(sql).df()[list(a.columns)]
        key = list(a.columns[:2])
        assert a.sort_values(key).values.tolist() == b.sort_values(key).values.tolist()


def test_block_max_search_equals_full_scan():
    from hearthvale.llm.toxicity import BlockMaxIndex

    rng = np.random.default_rng(0)
    n, t = 700, 50
    ex, te = np.repeat(np.arange(n), 6), np.concatenate([rng.choice(t, 6, replace=False) for _ in range(n)])
    w = rng.random(n * 6).round(2)
    index, dense = BlockMaxIndex(ex, te, w, n, t), np.zeros((n, t))
    dense[ex, te] = w
    for _ in range(100):
        q, qw, out = rng.choice(t, 5, replace=False), rng.random(5).round(2), int(rng.integers(n))
        s = dense[:, q] @ qw
        s[out] = -1
        assert index.nearest(q, qw, 15, out)[0].tolist() == [i for i in np.lexsort((np.arange(n), -np.round(s, 12))) if s[i] > 0][:15]
