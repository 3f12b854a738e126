"""MinHash near-duplicate grouping: SuperMinHash signatures, banding, exact verification, connected components.

Defined results: a null text or one without words has an empty set and links with nothing; a text of fewer than
``width`` words has its whole sequence as its one shingle; rows with a null id come back unlinked, as their own
group (component null, kept true); rows that share an id are one node. Of members equally central the smallest id
leads. A very long text is a piece of its own, held whole. An empty table gives an empty result. Sets are of 64-bit
hashes of shingles; equal sets are told by their size and two 64-bit sums over them. Only the id and text columns are
read, so other columns may have any names; ids may be of any type that has an order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import M64, Words, mix, pieces, schema_of, small_batches, staged, table_of

M = 128  # signature length
SALTS = 64  # parts that a bucket's rows are dealt to
ROWS = 4  # of a band: at similarity 0.75 the 32 bands miss a pair with probability 6e-6
SIFT_BITS = 24  # log2 of the bits of the sieve for ids that meet anybody: 2 MB on the driver at any input size
BLOCK = 256  # members of a block in the exhaustive comparison of what star links left open
BLOCK_ITEMS = 1_000_000  # shingles that a block's members hold, as far as even lots go

_WORDS = table_of()
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, one row after another, and the rows' bounds in them."""
    h = words.hashes
    n = len(h)
    full = np.zeros(n, np.uint64)
    for t in range(width):
        m = max(0, n - t)
        full[:m] += h[t:] * np.uint64(pow(0xC2B2AE3D27D4EB4F, t + 1, 1 << 64))
    full = mix(full)
    parts, bounds = [], [0]
    for first, count in zip(words.first.tolist(), words.count.tolist(), strict=True):
        if count >= width:
            parts.append(np.unique(full[first : first + count - width + 1]))
        elif count:
            short = np.array([count], np.uint64)
            for i in range(first, first + count):
                short = mix(short ^ h[i : i + 1]) + _GOLD
            parts.append(short)
        bounds.append(bounds[-1] + (len(parts[-1]) if count else 0))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(bounds)


def _uniform(items: np.ndarray, step: int) -> np.ndarray:
    return mix(items + np.uint64((2 * step + 1) * int(_GOLD) & M64))


def super_minhash(items: np.ndarray, bounds: np.ndarray, m: int = M) -> np.ndarray:
    """SuperMinHash signatures of rows of distinct 64-bit items; rows without items hold infinity.

    Step j of an element's random permutation can only yield values from j to j + 1, so a row is done, and its
    elements leave, once no slot of it is above j + 1.
    """
    rows = len(bounds) - 1
    low = np.full(rows * m, np.inf)
    counts = np.diff(bounds)
    row = np.repeat(np.arange(rows), counts)
    live = np.arange(len(items))
    order = None
    for j in range(m):
        x = items[live]
        u = _uniform(x, j)
        r = (u >> np.uint64(40)).astype(np.float64) * 2.0**-24
        k = j + ((u & np.uint64(0xFFFFFF)) * np.uint64(m - j) >> np.uint64(24)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            at = np.arange(len(live))
            slot = order[at, k].astype(np.int64)
            order[at, k] = order[:, j]
            order[:, j] = slot
        np.minimum.at(low, row[live] * m + slot, r + j)
        done = low.reshape(rows, m).max(axis=1) < j + 1
        stay = ~done[row[live]]
        if not stay.any():
            break
        if j == 0:
            live = live[stay]
            order = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(live), m)).copy()
            at = np.arange(len(live))
            first = k[stay]
            order[at, first] = 0
            order[:, 0] = first
        elif not stay.all():
            live, order = live[stay], order[stay]
    return low.reshape(rows, m)


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    n, m = signatures.shape
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(n, m // rows, rows)
    key = np.broadcast_to(np.arange(1, m // rows + 1, dtype=np.uint64) * _GOLD, (n, m // rows)).copy()
    for t in range(rows):
        key = mix(key ^ bits[:, :, t]) + _GOLD
    return key.view(np.int64)


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=run[1:])
    return (run[bounds[1:]] - run[bounds[:-1]]).view(np.int64)


def _features(width: int):
    def each(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, data, bounds in pieces(texts):
                items, at = shingles(Words(data, bounds, _WORDS), width)
                n = np.diff(at)
                keys = band_keys(super_minhash(items, at))
                some = n > 0
                ends = np.concatenate([[0], np.cumsum(some * keys.shape[1])]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(n), pa.array(_sums(mix(items), at)), pa.array(_sums(mix(items ^ _GOLD), at)), bands], ["id", "n", "f1", "f2", "bands"])

    return each


def _sets(width: int, sieve):
    """Shingle sets of the rows whose id may meet another: whole, and as the high halves of the hashes."""

    def each(batches):
        bits = sieve.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for a, b, data, bounds in pieces(batch.column(1)):
                items, at = shingles(Words(data, bounds, _WORDS), width)
                halves = (items >> np.uint64(32)).astype(np.uint32)
                columns = [pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at * k).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())]) for x, k in ((items, 8), (halves, 4))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(at)), *columns], ["id", "n", "items", "halves"])

    return each


def _sieve(ids: DataFrame):
    """A bitmap of fixed size over hashed ids; it only ever lets too many pass."""
    spark = ids.sparkSession
    at = ids.select(_place(F.col("id")).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (SIFT_BITS - 6), np.uint64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bits)


def _place(c):
    return F.pmod(F.xxhash64(c), F.lit(1 << SIFT_BITS))


def _verify(percent: int, kind: type):
    """Keep the pairs linked by their sets; by halves of hashes, those that may be."""

    def each(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_py(), kind), np.frombuffer(y.as_py(), kind)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return each


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked: sifted on half hashes, which miss none, then confirmed on full sets."""
    ends = T.StructType([T.StructField(c, sets.schema["id"].dataType) for c in ("a", "b")])
    for column, kind in (("halves", np.uint32), ("items", np.uint64)):
        mine = sets.select(F.col("id").alias("b"), F.col(column).alias("y"))
        other = sets.select(F.col("id").alias("a"), F.col(column).alias("x"))
        pairs = staged(pairs.join(mine, "b").join(other, "a").select("a", "b", "x", "y").mapInArrow(_verify(percent, kind), ends), "links")
    return pairs


def _block_pairs(percent: int):
    """Pairs of open members of a block and members of other groups that may be linked, by an inverted list over the block."""

    def each(left, right):
        done = pa.schema([("a", left.schema.field("x_id").type), ("b", left.schema.field("x_id").type)])
        if not left.num_rows or not right.num_rows:
            return done.empty_table()
        ids = [left["x_id"].combine_chunks(), right["id"].combine_chunks()]
        comps = [left["x_comp"].to_numpy(), right["comp"].to_numpy()]
        sets = [[np.frombuffer(v.as_py(), np.uint32) for v in t] for t in (left["x_halves"], right["halves"])]
        sizes = np.array([len(s) for s in sets[0]])
        flat = np.concatenate(sets[0])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        got_a, got_b = [], []
        for k, s in enumerate(sets[1]):
            lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(sizes))
            hit = np.flatnonzero((100 * both >= percent * (sizes + len(s) - both)) & (comps[0] != comps[1][k]))
            got_a.append(hit)
            got_b.append(np.full(len(hit), k))
        return pa.table({"a": ids[0].take(pa.array(np.concatenate(got_a))), "b": ids[1].take(pa.array(np.concatenate(got_b)))}, schema=done)

    return each


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each end of an edge (a, b) reaches. Min labels with pointer jumping, staged each round."""
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        jump = step.join(labels.select(F.col("id").alias("comp"), F.col("comp").alias("up")), "comp", "left")
        after = staged(jump.select("id", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
        labels = after.select("id", "comp")
        if after.where("comp <> was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row a document: id, n_shingles, component_id (the smallest id reachable over links), kept (it is its own component).

    Documents are linked when 100 * shared shingles >= percent * shingles of either. Equal sets are one class with a
    representative; representatives meet in bands. Each band's most central member is tried against all others (a
    star, not all pairs); what stays open in a band with members of several components is compared in full, block
    by block. Every link is confirmed on full sets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType
    features = staged(source.mapInArrow(_features(width), schema_of(id=kind, n="long", f1="long", f2="long", bands="array<long>")), "features")
    known = features.where("id is not null and n > 0")
    classes = staged(known.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")), "classes")
    banded = classes.select(F.col("rep").alias("id"), F.explode("bands").alias("band"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    # buckets of two or more, with the salts that their members have as bits; of those with the same members, one stands for all
    buckets = banded.groupBy("band").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("id")).alias("sign"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt)).alias("salts")).where("members > 1")
    buckets = staged(buckets.groupBy("members", "sign").agg(F.min_by(F.struct("band", "salts"), "band").alias("b"), F.count("*").alias("same")).select("b.*", "members", "same"), "buckets")
    bits = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.call_function("shiftright", F.col("salts"), k).bitwiseAND(F.lit(1).cast("long")) == 1)

    def of_bucket(rows: DataFrame, facts: DataFrame) -> DataFrame:
        """Rows with what is known of their band, which goes to each part of the band, by salt, that has rows."""
        spread = facts.join(buckets.select("band", F.explode(bits).alias("salt")), "band")
        return rows.withColumn("salt", salt).join(spread, ["band", "salt"]).drop("salt")

    crowd = staged(of_bucket(banded, buckets.select("band", "members", "same")), "crowd")
    central = crowd.groupBy("id").agg(F.sum(F.col("members") * F.col("same")).alias("score"))
    ranked = crowd.join(central, "id")
    leaders = staged(ranked.groupBy("band").agg(F.min_by("id", F.struct(-F.col("score"), "id")).alias("lead")), "leaders")
    stars = of_bucket(crowd, leaders)
    pairs = stars.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    placed_rows = source.where("id is not null").select("id", "text", _place(F.col("id")).alias("at"))
    sets = staged(placed_rows.mapInArrow(_sets(width, _sieve(crowd)), schema_of(id=kind, n="long", items="binary", halves="binary")), "sets")
    links = _linked(pairs, sets, percent)
    comps = components(links)
    # what is open: a bucket of three or more with members of several components
    placed = stars.where("members > 2").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    lead_comp = placed.where("id = lead").select("band", F.col("comp").alias("main"))
    placed = staged(of_bucket(placed, lead_comp).select("band", "id", "comp", "main"), "placed")
    other = F.col("comp") != F.col("main")
    # alone against the leader only: nothing is left to compare
    left = placed.groupBy("band").agg(F.count("*").alias("all"), F.count_if(other).alias("minor")).where("minor > 0 and all > 2").select("band")
    placed = staged(of_bucket(placed, left).join(sets.select("id", "n"), "id"), "left")
    lots = lambda which: F.greatest(F.ceil(F.count_if(which) / BLOCK), F.ceil(F.sum(F.when(which, F.col("n"))) / BLOCK_ITEMS)).cast("int")
    open_ = placed.groupBy("band").agg(lots(F.lit(True)).alias("na"), lots(other).alias("nm"))
    spread = of_bucket(placed, open_).join(sets.select(F.col("id").alias("sid"), "halves"), F.col("id") == F.col("sid")).drop("sid")
    slot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    minor = spread.where("comp <> main").select("band", slot("nm").alias("i"), F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("j"), "id", "comp", "halves").toDF("x_band", "x_i", "x_j", "x_id", "x_comp", "x_halves")
    every = spread.select("band", F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("i"), slot("na").alias("j"), "id", "comp", "halves")
    more = minor.groupBy("x_band", "x_i", "x_j").cogroup(every.groupBy("band", "i", "j")).applyInArrow(_block_pairs(percent), schema_of(a=kind, b=kind))
    more = _linked(staged(more.distinct(), "more"), sets, percent)
    if not more.isEmpty():
        comps = components(links.union(more))
    of_class = classes.select("n", "f1", "f2", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("comp", "rep").alias("component"))
    out = features.where("n > 0").select("id", "n", "f1", "f2").join(of_class, ["n", "f1", "f2"], "left")
    # empty sets are one key and meet nobody: they stay where they are
    out = out.select("id", "n", "component").union(features.where("n = 0").select("id", "n", F.lit(None).cast(kind)))
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
