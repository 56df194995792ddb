"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is four segments of 16 bits on a ring. If two
fingerprints differ in at most 3 bits, some segment starts a chain whose first
1, 2, 3 and 4 segments differ in at most floor(l * 3/4) = 0, 1, 2 and 3 bits.
The first three budgets give the join keys: the starting segment is equal, and
of the four bytes after it either the first two are equal (next segment
differs in 0 bits) or one of the first two and one of the last two (next two
segments differ in at most 1 bit each). That is 4 x 5 keys of 32 bits for each
distinct fingerprint. A pair from a key must pass the whole chain and then the
Hamming check.

A key shared by more than ``BUCKET`` fingerprints (a dense group of near
copies) is not paired: its fingerprints are linked through their
neighbourhoods, exactly and in linear work. If x and y differ in at most 3
bits, some z differs from x in at most 1 and from y in at most 2 bits; each y
with such a z is linked to the smallest fingerprint within 1 bit of z.

Copies of one fingerprint are collapsed first. Edge cases: a null or empty
text has fingerprint zero, linked like any other; rows with a null key get
their group's smallest key (null if it has none); equal keys are separate
rows; an empty table gives no rows; other columns are ignored by
``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthvale.llm.common import ship, staged, text_of
from hearthvale.llm.components import components

BUCKET = 128
SHINGLE, MAX_BITS = 3, 3
STEP = 1 << 18      # hashes expanded to bits at a time


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text (words by ASCII white space)."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()     # bytes.lower: A-Z alone
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), STEP):
        bits = np.unpackbits(h[i:i + STEP].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """``docs`` with its fingerprint as a (signed) long column ``name``."""
    ship(docs.sparkSession)

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        # Few texts at a time become Python strings.
        parts = (t for i in range(0, len(texts), 256) for t in texts.slice(i, 256).to_pylist())
        out = np.fromiter((fingerprint(t, shingle) for t in parts), np.uint64, len(texts))
        return pa.array(out.view(np.int64))

    return docs.withColumn(name, of(text_of(docs, text_col)))


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))


def chain_keys(fp: Column) -> Column:
    """The 20 join keys of a fingerprint."""
    keys = []
    for i in range(4):
        head, one, two = (_segment(fp, i + k) for k in range(3))
        b = [F.shiftrightunsigned(one, 8), one.bitwiseAND(F.lit(255)),
             F.shiftrightunsigned(two, 8), two.bitwiseAND(F.lit(255))]
        for v, (x, y) in enumerate([(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]):
            keys.append(F.lit((5 * i + v) << 32) + F.shiftleft(head, 16) + F.shiftleft(b[x], 8) + b[y])
    return F.array(*keys)


def pigeonring(a: Column, b: Column) -> Column:
    """Some segment starts a chain whose 1, 2, 3 and 4 segments stay within
    their budgets (budgets for 3 bits over 4 segments)."""
    d = [F.bit_count(_segment(a, i).bitwiseXOR(_segment(b, i))) for i in range(4)]
    starts = []
    for i in range(4):
        total, ok = F.lit(0), F.lit(True)
        for length in range(1, 5):
            total = total + d[(i + length - 1) % 4]
            ok = ok & (total <= length * MAX_BITS // 4)
        starts.append(ok)
    return starts[0] | starts[1] | starts[2] | starts[3]


def _flip(place: str) -> Column:
    """A mask of one bit; of none at place 64."""
    return F.expr(f"if({place} < 64, shiftleft(1L, {place}), 0L)")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``fps``: distinct long ``fp``. Links ``a, b`` whose components are those
    of all pairs within 3 bits."""
    keys = staged(fps.select("fp", F.explode(chain_keys(F.col("fp"))).alias("key")), "chain-keys")
    sizes = keys.groupBy("key").count().filter("count > 1")
    shared = staged(keys.join(sizes, "key"), "shared-keys")

    cold = shared.filter(F.col("count") <= bucket)
    a, b = cold.select("key", F.col("fp").alias("a")), cold.select("key", F.col("fp").alias("b"))
    near = (a.join(b, "key").filter("a < b").filter(pigeonring(F.col("a"), F.col("b")))
            .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b"))

    dense = shared.filter(F.col("count") > bucket).select("fp").distinct()
    one = dense.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    centre = (one.select(F.col("fp").bitwiseXOR(_flip("i")).alias("z"), "fp")          # 65 centres each
              .groupBy("z").agg(F.min("fp").alias("b")))
    two = one.select("fp", "i", F.explode(F.sequence(F.least(F.col("i") + 1, F.lit(64)), F.lit(64))).alias("j"))
    wide = two.select(F.col("fp").bitwiseXOR(_flip("i")).bitwiseXOR(_flip("j")).alias("z"), F.col("fp").alias("a"))  # 2 081
    far = wide.join(centre, "z").filter("a <> b").select("a", "b").distinct()
    return near.union(far)


def classes(fps: DataFrame, id_col: str, bucket: int = BUCKET) -> DataFrame:
    """``fp, root, component_id`` for each distinct fingerprint of ``fps``
    (columns ``id_col, fp``)."""
    distinct = staged(fps.groupBy("fp").agg(F.min(id_col).alias("first_id")), "fingerprints")
    roots = components(links(distinct.select("fp"), bucket))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = (rooted.join(roots.select("root").distinct(), "root", "left_semi")
             .groupBy("root").agg(F.min("first_id").alias("least_id")))
    return rooted.join(least, "root", "left").select("fp", "root", F.coalesce("least_id", "first_id").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    bucket: int = BUCKET) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    pairs = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"))
    fps = staged(with_fingerprints(pairs, "text", shingle).select("doc_id", "fp"), "document-fingerprints")
    found = classes(fps, "doc_id", bucket)
    return fps.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay when each group keeps one: the row of the
    smallest key, and of a hash of the whole row among equal keys."""
    cols = docs.columns
    one, two = F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols)        # together they name a row's content
    marked = with_fingerprints(docs, text_col, shingle, "__fp").select(
        F.col(id_col).alias("id"), F.col("__fp").alias("fp"), one.alias("h1"), two.alias("h2"))
    fps = staged(marked, "document-fingerprints")
    order = F.struct(F.col("id").isNull(), "id", "h1", "h2")
    # Rows are counted per content first, so a group of copies is small when it meets.
    rows = fps.groupBy("fp", "id", "h1", "h2").agg(F.count("*").alias("n"))
    best = rows.groupBy("fp").agg(F.min(F.struct(order.alias("o"), "n")).alias("m"))
    found = classes(fps, "id")
    kept = staged(best.join(found, "fp").groupBy("root").agg(F.min("m").alias("m"))
                  .select("m.o.h1", "m.o.h2", "m.n"), "kept")
    keyed = docs.withColumns({"__h1": one, "__h2": two})

    def of(k: DataFrame) -> DataFrame:
        return keyed.join(k.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2")), ["__h1", "__h2"], "left_semi")

    out = of(kept.filter("n = 1")).select(*cols)
    repeated = kept.filter("n > 1")
    if not repeated.isEmpty():          # the kept row itself stands more than once in the input
        out = out.union(of(repeated).dropDuplicates(["__h1", "__h2"]).select(*cols))
    return out
