"""SimHash near-dedup with pivot distance tables.

Fingerprint: A-Z become a-z, words are runs of characters other than blank and 0x09-0x0D, every 3-word shingle (fewer
words: the whole sequence) counts as often as it occurs, and a bit is 1 if it is set in over half of the shingles'
XXH64 hashes. A text without words has fingerprint zero, which links like any other.

Links: every distinct fingerprint gets its Hamming distances to PIVOTS reference fingerprints, seven to a 64-bit word.
By the triangle inequality two fingerprints within D bits differ by at most D in each of these distances, so a pair
is discarded by its largest coordinate difference, all coordinates at once, and only survivors are verified. Distances
of random fingerprints concentrate, so pivots alone would leave a fixed share of all pairs: pairs are therefore formed
only where the pigeonhole principle allows a link. With B blocks of bits, fingerprints within D bits agree in B - D
blocks at least; each choice of B - D blocks is a join key. B follows from the number of fingerprints, so the number
of chance pairs per fingerprint stays small at any size; the links found are the same, all of them.

Copies share a fingerprint and take one row in all this, so a group of copies of any size costs nothing; a block key
that many fingerprints share is joined in cells of bounded size. Components: each part of the links is contracted by
union-find; what is left goes to one task if it is small enough, else through alternating large-star and small-star
contractions, which need a logarithmic number of rounds, with the edges of each written to the shared folder.

Defined cases: null texts count as empty, so they have fingerprint zero; repeated rows are copies of each other and
count one by one in n_near; null ids are linked too, but are never a component's id unless it holds no other; an empty
table gives an empty result; no column besides key and text takes part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import batched, column, cut, fresh, map_arrow, only, skew_lookup, table

DISTANCE = 3
PIVOTS = 14
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lanes of 8 bits, seven to a word: the guard bits, and the distance in each lane.
_GUARD = sum(0x80 << (8 * i) for i in range(7))
_SLACK = sum(DISTANCE << (8 * i) for i in range(7))


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text as an unsigned integer."""
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    h64 = xxhash.xxh64_intdigest
    if len(words) < 3:
        return h64(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    to = (ends[2:] - 1).tolist()
    at = [0, *ends[:-3].tolist()]
    h = np.array([h64(joined[a:b], 42) for a, b in zip(at, to)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 255 * 64):  # bits as bytes, added eight at a time in sums of 255 at most
        lanes = np.unpackbits(h[i : i + 255 * 64].view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        for j in range(0, len(lanes), 255):
            counts += lanes[j : j + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _fp), the fingerprint as a signed 64-bit integer."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["_key", "_fp"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(column(key).alias("_key"), column(text).cast("string").alias("_text")), run, f"_key {kind}, _fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def keys_of(n: int) -> list[int]:
    """Bit masks of the block choices for n fingerprints."""
    blocks = next(b for b, most in ((4, 1 << 14), (5, 1 << 22), (6, 1 << 30), (7, 1 << 99)) if n <= most)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]
    return [_signed(sum(c)) for c in combinations(masks, blocks - DISTANCE)]


def _table(fp: Column, pivots: list[int]) -> Column:
    """Distances to seven pivots, in the lanes of one word."""
    word = F.lit(0).cast("long")
    for i, p in enumerate(pivots):
        word = word + F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"), 8 * i)
    return word


def _near(a: Column, b: Column) -> Column:
    """No lane differs by more than DISTANCE: the guard bit of a + DISTANCE - b survives in each, both ways."""
    one = (a + F.lit(_SLACK)).bitwiseOR(F.lit(_GUARD)) - b
    two = (b + F.lit(_SLACK)).bitwiseOR(F.lit(_GUARD)) - a
    return one.bitwiseAND(two).bitwiseAND(F.lit(_GUARD)) == F.lit(_GUARD)


#: A block key with more fingerprints than this is joined in cells of CELL by CELL.
CELL = 4096
#: Up to so many edges one task finds the components by union-find (16 bytes an edge); above, it only shortens its own part's edges.
ONE_TASK = 1 << 20


def links(nodes: DataFrame) -> DataFrame:
    """All pairs (u, v), u < v, of the distinct fingerprints in _fp that differ in at most DISTANCE bits.

    The fingerprints of one block key meet in the task that has the key. A key with over CELL of them is parted: its
    fingerprints fall into groups, each pair of groups is a cell with a task of its own, so no key outgrows a task.
    """
    n = nodes.count()
    masks = keys_of(n)
    pivots = [r[0] for r in nodes.select("_fp").orderBy(F.xxhash64("_fp"), "_fp").limit(PIVOTS).collect()]
    pivots += [_signed(xxhash.xxh64_intdigest(str(i))) for i in range(PIVOTS - len(pivots))]
    fp = F.col("_fp")
    keyed = nodes.select("_fp", F.posexplode(F.array(*[fp.bitwiseAND(F.lit(m)) for m in masks])).alias("_c", "_k"))
    big = keyed.groupBy("_c", "_k").agg(F.count("*").alias("_m")).where(F.col("_m") > CELL)
    if n > CELL and big.head(1):
        # a hash stands for the key: two keys of one hash would at worst be parted alike
        key = F.xxhash64("_c", "_k").alias("_ck")
        big = cut(big.groupBy(key).agg(F.ceil(F.max("_m") / CELL).cast("long").alias("_parts"), F.sum("_m").alias("_m")), "fingerprint-keys")
        at = skew_lookup(keyed.select("*", key), big, "_ck", "_m", "left")
        parts = F.coalesce("_parts", F.lit(1))
        at = at.select("_fp", "_c", "_k", parts.alias("_parts"), F.pmod(F.xxhash64("_fp"), parts).alias("_g"))
        # a fingerprint of group i stands in the cells (j, i) for j < i, (i, i), and (i, j) for j > i
        cell = lambda j: F.least(F.col("_g"), j) * F.col("_parts") + F.greatest(F.col("_g"), j)
        keyed = at.select("_fp", "_c", "_k", "_g", F.explode(F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: F.struct(cell(j).alias("n"), (j == F.col("_g")).alias("own")))).alias("_cell"))
        keyed = keyed.select("_fp", "_c", "_k", "_g", F.col("_cell.n").alias("_cell"), F.col("_cell.own").alias("_own"))
    else:
        keyed = keyed.withColumns({"_g": F.lit(0), "_cell": F.lit(0), "_own": F.lit(True)})
    rows = keyed.select("_fp", _table(fp, pivots[:7]).alias("_p"), _table(fp, pivots[7:]).alias("_q"), "_c", "_k", "_cell", "_g", "_own")
    a, b = rows.alias("a"), rows.alias("b")
    c = F.col
    return (
        a.join(
            b,
            (c("a._c") == c("b._c"))
            & (c("a._k") == c("b._k"))
            & (c("a._cell") == c("b._cell"))
            & (c("a._own") | (c("a._g") != c("b._g")))
            & (c("a._fp") < c("b._fp"))
            & _near(c("a._p"), c("b._p"))
            & _near(c("a._q"), c("b._q"))
            & (F.bit_count(c("a._fp").bitwiseXOR(c("b._fp"))) <= DISTANCE),
        )
        .select(c("a._fp").alias("u"), c("b._fp").alias("v"))
        .distinct()
    )


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one part as stars: each node with the smallest that it reaches by them."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        r = x
        while (p := up.setdefault(r, r)) != r:
            r = p
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = root(u), root(v)
            if a != c:
                up[max(a, c)] = min(a, c)
    nodes = list(up)
    for i in range(0, len(nodes), 1 << 16):
        some = nodes[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(u, root) for each node of edges (u, v): the smallest node that it reaches.

    Every part of the edges becomes stars by union-find, a map-side combination. When at most `one_task` edges are left,
    one task does the same for all; else large-star and small-star steps contract them, with hubs looked up by broadcast.
    """
    batched(edges.sparkSession)
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"), "components")
    last = None
    while True:
        n, now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if n <= one_task:
            return e.repartition(1).mapInArrow(_stars, "u long, v long").withColumnRenamed("v", "root")
        if (n, now) == last:
            return e.select("u", F.col("v").alias("root"))
        last = (n, now)
        part = e.mapInArrow(_stars, "u long, v long").where("u <> v").distinct()
        both = cut(part.unionByName(part.select(F.col("v").alias("u"), F.col("u").alias("v"))), "component-sides", e)
        low = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("_w")), "component-lows")
        large = cut(skew_lookup(both, low, "u", "_w", "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "component-large", both, low)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_w")), "component-lows")
        small = skew_lookup(large, low, "u", "_w", "inner")
        e = cut(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "components", large, low)


def _classes(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_fp, _n, _first, _linked, _root) of each distinct fingerprint of (_key, _fp), and (_root, component_id, _w)."""
    nodes = cut(fps.groupBy("_fp").agg(F.count("*").alias("_n"), F.min("_key").alias("_first")), "fingerprint-nodes")
    pairs = cut(links(nodes), "fingerprint-links")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = both.groupBy(F.col("u").alias("_fp")).agg(F.count("*").alias("_deg"))
    heavy = cut(degree.join(nodes.select("_fp", "_n"), "_fp"), "fingerprint-degrees")
    linked = skew_lookup(both.select(F.col("u").alias("_to"), F.col("v").alias("_fp")), heavy, "_fp", "_deg", "inner").groupBy(F.col("_to").alias("_fp")).agg(F.sum("_n").alias("_linked"))
    root = components(pairs).withColumnRenamed("u", "_fp")
    full = cut(
        nodes.join(linked, "_fp", "left").join(root, "_fp", "left").select("_fp", "_n", "_first", F.coalesce("_linked", F.lit(0)).alias("_linked"), F.coalesce("root", "_fp").alias("_root")),
        "fingerprint-classes",
        nodes,
        pairs,
        heavy,
    )
    # all fingerprints of a class take its smallest id: a window would put a class into one task
    return full, full.groupBy("_root").agg(F.min("_first").alias("component_id"), F.count("*").alias("_w"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, _fp, n_near, component_id) for each row of docs."""
    fps = cut(fingerprints(docs, key, text), "fingerprints")
    full, lowest = _classes(fps)
    result = skew_lookup(full, lowest, "_root", "_w", "inner").select("_fp", "_n", (F.col("_n") - 1 + F.col("_linked")).cast("long").alias("n_near"), "component_id")
    return skew_lookup(fps, cut(result, "fingerprint-result", full), "_fp", "_n", "inner").select(F.col("_key").alias(key), "_fp", "n_near", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one row of each component: the one with the smallest key, of several such the first text.

    A null key comes last. Keys need not be unique: rows are told apart by key and text.
    """
    at = F.struct(column(key).isNull().alias("x"), column(key).alias("k"), F.xxhash64(column(text)).alias("h"))
    # the hash of its text stands for a row: one key serves the join and the last dedup, so texts shuffle once
    row = lambda c: F.concat(F.coalesce(F.concat(F.lit("s"), c["k"].cast("string")), F.lit("n")), F.lit(":"), c["h"].cast("string"))
    fps = cut(fingerprints(docs.select(at.alias("_at"), column(text).alias("_text")), "_at", "_text"), "fingerprints")
    mark = fresh(docs, "_row")
    first = _classes(fps)[1].select(row(F.col("component_id")).alias(mark))
    return only(docs.withColumn(mark, row(at)).join(first, mark, "left_semi").dropDuplicates([mark]), docs.columns)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    near = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")
