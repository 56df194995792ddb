"""The Merkle manifest against a plain Python tree."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hearthvale.llm import merkle, queries

SMALL = "/root/testdata/sf0.001"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, h string, g string, idx string, path string, k string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Levels of nodes from the leaves to the root."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i:i + 2])) for i in range(0, len(last), 2)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        other = i ^ 1
        out.append((i % 2 == 1, nodes[other] if other < len(nodes) else None))
        i //= 2
    return out


def fold(now, path):
    for before, sib in path:
        now = digest((sib if before else now) + ((now if before else sib) or ""))
    return now


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[2] is not None, (r[2] or "").encode())].append(((r[0] is not None, r[0] or 0), leaf(r), r))
    names = sorted(groups)
    trees = {g: (sorted(groups[g], key=lambda x: x[:2]), tree([x[1] for x in sorted(groups[g], key=lambda x: x[:2])])) for g in names}
    top = tree([trees[g][1][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        ordered, levels = trees[g]
        for i, (_, h, r) in enumerate(ordered):
            path = siblings(levels, i) + siblings(top, j)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            root = fold(leaf((*r[:3], r[3] + 1, r[4])) if changed else h, path)
            out.append((r[0], h, levels[-1][0], top[-1][0], digest("".join(s or "" for _, s in path)), root, root == top[-1][0]))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def proofs(docs, levels=merkle.LEVELS):
    changed = merkle.leaf_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, changed)
    p = merkle.manifest(docs, FIELDS, "lang", "doc_id", {"tampered": tampered}, levels)
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return p.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), folded, folded == F.col("root"))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", "g", "i", "p", "k") for r in rows], SCHEMA)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_odd_rows_and_group_sizes(spark, levels):
    rows = [(i, "s", f"l{n}", i % 3 or None, f"text {i}" * (i % 4)) for n in (1, 2, 3, 5, 8, 17) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "", "", 0, ""), (7, "é", None, 5, "x" * 400_000), (7, "é", None, 5, "x" * 400_000),
             (9, "-", "zß", 1, "1:a"), (9, "-", "zß", 1, "1:a"), (10, None, "Z", 2, "\x00")]
    got = [tuple(r) for r in proofs(frame(spark, rows), levels).collect()]
    want = brute(rows)
    # rows equal in every field may swap places: compare what does not depend on it, and their proofs as a set
    assert sorted(got, key=key) == sorted(want, key=key)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(*FIELDS).collect()]
    got = queries.op12_merkle(spark, SMALL)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()))
    assert got == sorted(brute(rows))
    assert {r[0] for r in got if not r[6]} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None}


def test_a_group_that_holds_most_rows(spark):
    rows = [(i, "s", "hot" if i % 10 else f"l{i % 30}", 1, "same text") for i in range(3000)]
    got = proofs(frame(spark, rows), 4).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_empty_table(spark):
    out = merkle.manifest(frame(spark, []), FIELDS, "lang", "doc_id", {"tampered": F.lit("x")})
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "path", "tampered"] and out.collect() == []
