"""MinHash near-duplicates with sequential Bayesian verification.

Documents with one shingle set are one class. Classes that share a band of their MinHash signature
are candidates; batches of the signature are compared, and a pair goes as soon as the posterior
probability that it is similar enough falls under a chosen miss probability. What survives is
verified exactly on the whole shingle sets.

A bucket of G classes is not expanded into all pairs: its members are compared with one pivot, then
those in other components with another, and only what is still apart is compared pair by pair.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import components
from ..storage import forget, stored
from .common import chunks, cut, text_key, with_columns_from

CACHE_WORDS = 200_000
#: Buckets of up to this many classes are compared pair by pair in a join; larger ones block against block.
SMALL = 32
#: Buckets are broadcast up to this many (some 12 MB); beyond it they are joined with a shuffle.
BROADCAST_ROWS = 500_000
#: Members of a pivot under one join key.
PIVOT_MEMBERS = 256
#: Mean number of classes in a block, and of their shingles, which it holds as well.
BLOCK = 256
BLOCK_SHINGLES = 1 << 21
MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text; words are split at ASCII white
    space and A-Z lower-cased. A text of fewer than k words has its whole sequence as one shingle."""

    def __init__(self, k: int):
        self.k, self.cache = k, {}

    def words(self, text: str | None) -> np.ndarray:
        cache, out = self.cache, []
        for w in text.encode("utf-8", "surrogatepass").lower().split() if text else ():
            h = cache.get(w)
            if h is None:
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                h = cache[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.words(text)
        if not len(words):
            return words
        k = min(self.k, len(words))
        h = np.full(len(words) - k + 1, k, np.uint64)
        for j in range(k):
            h = (h ^ words[j : len(words) - k + 1 + j]) * MIX
            h ^= h >> np.uint64(29)
        return np.unique(h)


def class_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


class MinHasher:
    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 31, size, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, size, dtype=np.uint32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 2048):
            np.minimum(low, (x[at : at + 2048, None] * self.a + self.b).min(axis=0), out=low)
        return low.view(np.int32)


def fewest_matches(n: int, similarity: float, miss: float) -> int:
    """The smallest m of n equal hashes at which P(J >= similarity | m of n) >= miss, for a uniform prior:
    the posterior is Beta(m+1, n-m+1), whose tail is a binomial sum."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, bands: int = 25, rows: int = 5, miss: float = 1e-5, seed: int = 11) -> DataFrame:
    """One row per row of docs: the key, n_shingles, component_id (smallest key of its component) and kept
    (key = component_id).

    Two texts are linked when 100 * |A & B| >= 100 * similarity * |A | B| (similarity in whole per cent).
    Texts without words, null ones too, are linked with nothing. Rows without a key take part; a component
    of such rows alone has no component_id and all of it is kept. Rows that share a key are one document.
    A pair at the limit shares no band with probability (1 - similarity**rows)**bands.
    """
    percent, size = round(100 * similarity), bands * rows
    spark, paths = docs.sparkSession, []

    def held(df: DataFrame, name: str) -> DataFrame:
        """Written to the shared folder until all links are known."""
        kept, path = stored(df, name)
        paths.append(path)
        return kept

    def features():
        shingles, minhash = Shingler(shingle), MinHasher(size, seed)

        def run(texts):
            sets = [shingles(t) for t in texts]
            return [[len(s) for s in sets], [class_id(s) if len(s) else None for s in sets], [minhash(s).tolist() if len(s) else None for s in sets]]

        return run

    source = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumn("tkey", text_key(F.col("text")))
    feats = cut(with_columns_from(source, "text", "n bigint, cid bigint, sig array<int>", features).drop("text"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "tkey", "n", "sig")).alias("m")
    classes = cut(feats.where("n > 0").groupBy("cid").agg(first).select("cid", "m.id", "m.tkey", "m.n", "m.sig"))

    keys = [F.xxhash64(F.lit(i), *[F.col("sig")[i * rows + j] for j in range(rows)]) for i in range(bands)]
    banded = classes.select("cid", F.posexplode(F.array(*keys)).alias("no", "band"))
    buckets = held(banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    few_buckets = buckets.count() <= BROADCAST_ROWS

    def per_band(df: DataFrame) -> DataFrame:
        """A row for each of some buckets: broadcast while they are few, so that the members of one do not meet in a task."""
        return F.broadcast(df) if few_buckets else df

    shared, shared_path = stored(banded.join(per_band(buckets), "band"), "shared-bands")
    # the pivot of a bucket is the class with the most company over all its bands: the centre of its copies
    company = shared.groupBy("cid").agg(F.sum("members").alias("company"))
    pivots = shared.join(company, "cid").groupBy("band").agg(F.max_by("cid", F.struct("company", "cid")).alias("pivot"))
    members = held(shared.join(per_band(pivots), "band"), "members")
    forget(spark, shared_path)

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(cid, text) for classes, one text each."""
        at = wanted.join(classes.select("cid", "id", "tkey"), "cid")
        return source.join(at, source["id"].eqNullSafe(at["id"]) & (source["tkey"] == at["tkey"])).select("cid", "text").dropDuplicates(["cid"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) of classes those that are similar enough."""
        side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        same, alive = F.lit(0), F.lit(True)
        for at in range(0, size, rows * 5):
            step = min(rows * 5, size - at)
            same = same + F.size(F.filter(F.zip_with(F.slice("sig_a", at + 1, step), F.slice("sig_b", at + 1, step), lambda x, y: x == y), lambda x: x))
            alive = alive & (same >= fewest_matches(at + step, similarity, miss))
        survivors = held(both.where(alive).select("a", "b"), "survivors")
        texts = texts_of(survivors.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
        # a pivot of many members is several keys, each with its text, so that they do not meet in one task
        pivots = survivors.groupBy("a").agg(F.ceil(F.count("*") / PIVOT_MEMBERS).cast("int").alias("salts"))
        salt = F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")
        of_b = survivors.join(pivots, "a").select("a", "b", salt).join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
        of_a = texts.join(pivots.withColumnRenamed("a", "cid"), "cid").select(F.col("cid").alias("a"), F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        pair_texts = of_b.join(of_a, ["a", "salt"]).select("a", "text_a", "b", "text_b")
        return held(pair_texts.mapInArrow(compared(shingle, percent), "a bigint, b bigint"), "links")

    def in_blocks(rest: DataFrame) -> DataFrame:
        """Links between members outside a bucket's largest component and all others, block against block: what
        Spark groups is two blocks, never a bucket."""
        blocks = lambda n, shingles: F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
        n_out = blocks(F.col("n_all") - F.col("n_in"), F.col("s_all") - F.col("s_in"))
        n_in = blocks(F.col("n_in"), F.col("s_in"))
        block = F.pmod(F.xxhash64("cid"), F.when(F.col("out"), n_out).otherwise(n_in)).cast("int")
        each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
        key = lambda inside, i, j: F.struct(inside.alias("inside"), i.alias("i"), j.alias("j"))
        mine = F.col("block")
        of_out = F.concat(each(F.col("n_out"), lambda j: key(F.lit(False), F.least(mine, j), F.greatest(mine, j))), each(F.col("n_in"), lambda j: key(F.lit(True), mine, j)))
        of_in = each(F.col("n_out"), lambda i: key(F.lit(True), i, mine))
        placed = rest.select("band", "no", "cid", "comp", "out", n_out.alias("n_out"), n_in.alias("n_in"), block.alias("block"))
        keyed = placed.select("band", "no", "cid", "comp", "out", "block", F.explode(F.when(F.col("out"), of_out).otherwise(of_in)).alias("k"))
        sets = held(with_columns_from(texts_of(rest.select("cid").distinct()), "text", "hashes array<bigint>", lambda: set_lists(shingle)).drop("text"), "sets")
        rows_ = keyed.join(classes.select("cid", "sig"), "cid").join(sets, "cid").select("band", "no", "k.*", "cid", "comp", "out", "block", "sig", "hashes")
        return held(rows_.groupBy("band", "inside", "i", "j").applyInArrow(block_links(percent, bands, rows, similarity, miss), "a bigint, b bigint"), "block-links")

    def distinct_pairs(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    links = verified(members.where("cid <> pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct())
    comps = components(links)

    def apart() -> DataFrame:
        """Members of the buckets that still hold several components, with theirs."""
        labelled = members.where("members > 2").join(comps.withColumnsRenamed({"node": "cid"}), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        mixed = labelled.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
        return held(labelled.join(per_band(mixed), "band"), "apart")

    rest = apart()
    if not rest.isEmpty():
        others = rest.groupBy("band").agg(F.min_by(F.struct("cid", "comp"), F.xxhash64("band", "cid")).alias("p"))
        found = rest.join(per_band(others), "band").where("comp <> p.comp").select(F.col("p.cid").alias("a"), F.col("cid").alias("b"))
        links = links.unionByName(verified(distinct_pairs(found)))
        comps = components(links)
        rest = apart()
    if not rest.isEmpty():
        sizes = rest.join(classes.select("cid", "n"), "cid").groupBy("band", "comp").agg(F.count("*").alias("count"), F.sum("n").alias("shingles"))
        by_count = F.struct("count", "comp")
        largest = sizes.groupBy("band").agg(F.max_by("comp", by_count).alias("largest"), F.max("count").alias("n_in"), F.sum("count").alias("n_all"), F.max_by("shingles", by_count).alias("s_in"), F.sum("shingles").alias("s_all"))
        rest = held(rest.join(per_band(largest), "band").withColumn("out", F.col("comp") != F.col("largest")), "apart")
        few = rest.where(F.col("n_all") <= SMALL)
        left = few.where("out").select("band", F.col("cid").alias("a"), F.col("comp").alias("comp_a"))
        found = left.join(few.select("band", F.col("cid").alias("b"), F.col("comp").alias("comp_b")), "band").where("comp_a <> comp_b")
        links = links.unionByName(verified(distinct_pairs(found))).unionByName(in_blocks(rest.where(F.col("n_all") > SMALL)))
        comps = components(links)

    forget(spark, *paths)
    named = classes.select("cid", "id").join(comps.withColumnsRenamed({"node": "cid"}), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    lowest = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    classed = named.join(lowest, "comp").select("cid", "component_id")
    out = feats.select("id", "n", "cid").join(classed, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def compared(shingle: int, percent: int):
    """Pairs of texts whose whole shingle sets are similar enough; the sets of recent texts are remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, recent = Shingler(shingle), OrderedDict()

        def set_of(cid: int, text: str) -> np.ndarray | None:
            key = (cid, len(text))
            if key not in recent:
                hashes = shingles(text)
                recent[key] = hashes if class_id(hashes) == cid else None  # another text under the same key
                if len(recent) > 8:
                    recent.popitem(last=False)
            else:
                recent.move_to_end(key)
            return recent[key]

        for batch in chunks(batches, "text_b"):
            found_a, found_b = [], []
            for a, text_a, b, text_b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x, y = set_of(a, text_a), set_of(b, text_b)
                if x is None or y is None:
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return run


def set_lists(shingle: int):
    shingles = Shingler(shingle)
    return lambda texts: [[shingles(t).view(np.int64) for t in texts]]


def block_links(percent: int, bands: int, rows: int, similarity: float, miss: float):
    """Links that join components in one block pair. A pair counts in the first band it shares only, so no pair
    is verified twice; pairs that earlier links of the block pair have joined are passed."""
    steps = [(n, fewest_matches(n, similarity, miss)) for n in range(5 * rows, bands * rows + 1, 5 * rows)]

    def run(table: pa.Table) -> pa.Table:
        inside, i, j = (table.column(c)[0].as_py() for c in ("inside", "i", "j"))
        cid, comp, out, block = (table.column(c).to_numpy() for c in ("cid", "comp", "out", "block"))
        sigs = np.array(table.column("sig").to_pylist(), np.int32)
        lists = table.column("hashes").combine_chunks()
        flat, ends = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
        ends = ends - ends[0]
        sets = [flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
        size = np.diff(ends)
        left = np.flatnonzero(out & (block == i)) if inside else np.flatnonzero(block == i)
        right = np.flatnonzero(~out) if inside else np.flatnonzero(block == j)
        parent = {c: c for c in comp.tolist()}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        band_of = table.column("no")[0].as_py()
        found_a, found_b = [], []
        for x in left.tolist():
            equal = sigs[x] == sigs[right]
            banded = equal.reshape(len(right), bands, rows).all(axis=2)
            alive = banded[:, band_of] & ~banded[:, :band_of].any(axis=1) & (comp[right] != comp[x]) & (cid[right] != cid[x])
            if not inside and i == j:
                alive &= right > x
            alive &= 100 * np.minimum(size[right], size[x]) >= percent * np.maximum(size[right], size[x])
            for n, least in steps:
                alive &= equal[:, :n].sum(axis=1) >= least
            order = np.argsort(-equal.sum(axis=1), kind="stable")
            for y in right[order[alive[order]]].tolist():
                a, b = root(comp[x]), root(comp[y])
                if a == b:
                    continue
                shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * shared >= percent * (size[x] + size[y] - shared):
                    parent[a] = b
                    found_a.append(int(cid[x]))
                    found_b.append(int(cid[y]))
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    return run


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """docs without the rows that are not kept; columns stay as they were. Rows without a key are all kept."""
    found = near_duplicates(docs, key, **options).where("not kept").select(F.col(key).alias("_gone")).distinct()
    return docs.join(found, docs[f"`{key}`"] == found["_gone"], "left_anti")
