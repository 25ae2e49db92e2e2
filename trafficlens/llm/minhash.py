"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct word shingles (64-bit hashes).  Documents
with equal sets form a class, and only its smallest id goes on.  Each set
gets 128 minima; 24 bands of 4 of them make buckets, and the low 4 bits of
all minima, packed as bit planes, the signature.

1. Candidates.  In every bucket each member is paired with the bucket's
   smallest id.  Bit counts of the signatures estimate a pair's similarity,
   corrected for chance collisions of low bits; a pair within five standard
   deviations of the threshold joins its documents to one candidate cluster.
   Buckets that still hold several clusters are compared within, by bit
   counts, in blocks of bounded size that return a spanning forest only.
2. Confirmation.  Full sets are read from the texts of clustered documents
   only.  A cluster of up to BLOCK documents is compared exactly, all pairs
   at once by a matrix product; it returns the links of a spanning forest of
   the exact link graph.  A larger cluster is cut into blocks, each compared
   within and with the cluster's hubs (members with the fullest buckets),
   which connects copies of one text in linear time; only documents outside
   the cluster's main component then meet all blocks.

So no link is lost for want of a lucky pairing, and no group of copies is
ever written out as all its pairs: every step returns fewer links than rows.
At similarity 0.8 a pair shares no bucket with probability 3.2e-6 and falls
below the estimate with 3e-7; nothing is capped.

Skew: equal sets collapse by a pre-aggregated minimum; hot classes, buckets,
centres and clusters meet their rows by ``attach``; blocks are bounded in
rows and bytes.  Before texts are shuffled, a bitmap of 2**23 bits (2 MB,
whatever the input) sorts out documents without candidates.  What stays
quadratic is a cluster of documents that all are nearly similar enough, and
none enough: its blocks must be compared, block by block.

Documents without words (null and empty texts) have no set: component is the
document itself, kept.  A null doc_id links with nothing: component null,
kept.  Repeated rows are returned as often as they occur; of rows with one
doc_id and different texts each takes the component of its own text.  An empty
table gives an empty result.  Very long texts are hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.common import WordHashes, attach, lists, map_rows, mix64, prepare, table, utf8
from trafficlens.llm.components import components
from trafficlens.llm.registry import register

HASHES, BITS = 128, 4
BANDS, ROWS = 24, 4
SIGMAS = 5.0
BLOCK = 1024
BLOCK_BYTES = 32 << 20
HUBS = 8
COLUMNS = 4096
BITMAP = 1 << 23

_rng = np.random.default_rng(7)
MULTIPLY = _rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, words_of: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's ``size``-word shingles; a shorter text is one shingle."""
    words = words_of.of(text.lower().split())
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    key = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        key = mix64(key * ODD + words[i:n - k + 1 + i])
    return np.unique(key)


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        h = x[i:i + 512, None] * MULTIPLY
        h += ADD
        np.minimum(out, h.min(axis=0), out=out)
    return out


def pack(mins: np.ndarray) -> np.ndarray:
    """Signatures of rows of minima: for each of the low bits, a plane of HASHES bits (uint8)."""
    planes = [np.packbits(((mins >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), axis=-1) for b in range(BITS)]
    return np.concatenate(planes, axis=-1)


def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima agree in their low bits (signatures as rows of uint8, broadcast against each other)."""
    words = [x.reshape(*x.shape[:-1], BITS, HASHES // 8).view(np.uint32) for x in (a, b)]
    differ = words[0][..., 0, :] ^ words[1][..., 0, :]
    for p in range(1, BITS):
        differ = differ | (words[0][..., p, :] ^ words[1][..., p, :])
    return HASHES - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64)


def similarity(agree: np.ndarray) -> np.ndarray:
    """Similarity from agreeing signatures, corrected for low bits that agree by chance."""
    chance = 2.0 ** -BITS
    return (agree / HASHES - chance) / (1 - chance)


def least_matches(threshold: float) -> int:
    """Fewest agreeing minima at which a pair is still confirmed."""
    p = threshold + (1 - threshold) * 2.0 ** -BITS
    return int(np.floor(HASHES * p - SIGMAS * np.sqrt(HASHES * p * (1 - p))))


def _sign(size: int):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        words_of = WordHashes()
        for cols in batches:
            sets = [shingle_set(t, words_of, size) for t in utf8(cols["text"])]
            mins = np.stack([minima(s) for s in sets])
            key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(sets), axis=0)
            for r in range(ROWS):
                key = mix64(key * ODD + mins[:, r:BANDS * ROWS:ROWS].astype(np.uint64))
            some = np.array([len(s) > 0 for s in sets])
            sigs = pack(mins)
            yield {"n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                   "print": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                   "sig": pa.array([x.tobytes() for x in sigs], pa.binary()),
                   "bands": lists(key[some].view(np.int64).ravel(), some * BANDS, pa.int64())}
    return run


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n_shingles, print (of the set), sig, bands."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return map_rows(docs, {"text": "text"}, _sign(size),
                    "n_shingles long, print binary, sig binary, bands array<long>", keep=["doc_id", "text_key"])


def text_key():
    """Digest of the text, which tells rows of one doc_id apart."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _passing(least: int):
    """Keeps (a, b) where the signatures and sizes leave the threshold possible."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = [np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(b.num_rows, -1)
                       for c in ("sig_a", "sig_b")]
                yield b.select(["a", "b"]).filter(pa.array(matches(*sig) >= least))
    return run


def estimated(pairs: DataFrame, reps: DataFrame, least: int, percent: int) -> DataFrame:
    """Pairs (a, b) that the estimate leaves; b may be a hot centre. pairs must be checkpointed."""
    own = reps.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    other = reps.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
    other = other.join(counts, "b").checkpoint()
    got = attach(pairs.join(own, "a").checkpoint(), other, "b", "n", pairs.count(), "inner")
    got = got.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return got.select("a", "b", "sig_a", "sig_b").mapInArrow(_passing(least), "a long, b long")


def exact(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of (sorted, distinct) sets reach the threshold: a boolean matrix.

    Counts common elements by products of 0/1 matrices, a block of elements at a time.
    """
    same = left is right
    sets = left if same else [*left, *right]
    size = np.array([len(x) for x in sets])
    value, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.flatnonzero(times > 1)
    new = np.full(len(value), -1)
    new[shared] = np.arange(len(shared))
    col = new[at]
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    cut = len(left)
    common = np.zeros((cut, cut if same else len(right)), np.float32)
    for lo in range(0, len(shared), COLUMNS):
        a, b = np.searchsorted(col, [lo, lo + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, len(shared) - lo)), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        common += m[:cut] @ (m if same else m[cut:]).T
    n, k = size[:cut, None], (size if same else size[cut:])[None, :]
    return (common > 0) & (100 * common >= percent * (n + k - common))


def forest(ok: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of ``ok`` that join what the labels ``left`` and ``right`` do not yet join."""
    out = []
    labels = np.concatenate([left, right])
    n = len(left)
    for i in np.flatnonzero(ok.any(axis=1)):
        js = np.flatnonzero(ok[i])
        kinds, first = np.unique(labels[n + js], return_index=True)
        for kind, j in zip(kinds.tolist(), js[first].tolist()):
            if kind != labels[i]:
                out.append((int(i), j))
                labels[labels == kind] = labels[i]
    return out


def _by_group(names: tuple[str, ...], work):
    """Runs ``work(columns of one group)`` over the runs of equal ``names`` in a sorted partition; yields a, b."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush():
            t = pa.Table.from_batches(held)
            held.clear()
            links = work(t)
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for b in batches:
            if not b.num_rows:
                continue
            edge = np.zeros(b.num_rows, bool)
            keys = [b[c].to_numpy() for c in names]
            for k in keys:
                edge[1:] |= k[1:] != k[:-1]
            for lo, hi in zip([0, *np.flatnonzero(edge)], [*np.flatnonzero(edge), b.num_rows]):
                name = tuple(int(k[lo]) for k in keys)
                if held and name != last:
                    yield from flush()
                last = name
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from flush()
    return run


def bucket_rows(members: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """key, doc_id, component, far, i, j: what lies outside a bucket's main cluster (far) meets each member once.

    members: key, doc_id, component; keys: key, n, main, sides, blocks.  Two
    members of the main cluster need not meet, so a bucket of n members with
    few outside it gives about n rows.
    """
    rows = attach(members, keys, "key", "n", total, "inner").withColumn("far", F.col("component") != F.col("main"))
    spot = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col(n))
    cols = ["key", "doc_id", "component", "far", "i", "j"]
    out = (rows.filter("far").withColumn("i", spot("sides"))
           .withColumn("j", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(*cols))
    every = (rows.withColumn("far", F.lit(False)).withColumn("i", F.explode(F.expr("sequence(0L, sides - 1)")))
             .withColumn("j", spot("blocks")).select(*cols))
    return out.unionByName(every)


def bucket_keys(members: DataFrame) -> DataFrame:
    """Buckets whose members lie in several clusters, with the largest one (main); members: key, doc_id, component."""
    parts = members.groupBy("key", "component").agg(F.count("*").alias("m"))
    return (parts.groupBy("key").agg(F.max(F.struct("m", "component")).alias("main"), F.count("*").alias("parts"),
                                     F.sum("m").alias("n"))
            .filter("parts > 1 AND n > 2")
            .select("key", "n", F.col("main.component").alias("main"),
                    F.expr(f"(n - main.m + {BLOCK} - 1) div {BLOCK}").alias("sides"),
                    F.expr(f"(n + {BLOCK} - 1) div {BLOCK}").alias("blocks")))


def within_buckets(members: DataFrame, reps: DataFrame, comps: DataFrame, least: int, percent: int) -> DataFrame | None:
    """Pairs (a, b) that pass the estimate and join different candidate clusters of one bucket; None if none may.

    members: key, doc_id (checkpointed); comps: id, component.
    """
    now = (members.join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left")
           .withColumn("component", F.coalesce("component", "doc_id")).checkpoint())
    keys = bucket_keys(now).checkpoint()
    if not keys.head(1):
        return None
    pairs = (bucket_rows(now, keys, now.count()).join(reps.select("doc_id", "sig", "n_shingles"), "doc_id")
             .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"))

    def work(t: pa.Table) -> list[tuple[int, int]]:
        doc, n, comp = (t[c].to_numpy() for c in ("doc_id", "n_shingles", "component"))
        if len(np.unique(comp)) == 1:
            return []
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(doc), -1)
        far = t["far"].to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(far), np.flatnonzero(~far)
        ok = np.zeros((len(left), len(right)), bool)
        for lo in range(0, len(left), 128):
            part = left[lo:lo + 128]
            ok[lo:lo + 128] = matches(sig[part][:, None], sig[right][None, :]) >= least
        a, b = n[left][:, None], n[right][None, :]
        ok &= 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        ok &= comp[left][:, None] != comp[right][None, :]
        return [(int(doc[left[x]]), int(doc[right[y]])) for x, y in forest(ok, comp[left], comp[right])]

    return pairs.mapInArrow(_by_group(("key", "i", "j"), work), "a long, b long").distinct()


def full_sets(clustered: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """doc_id (of the node) and set of the clustered nodes (doc_id, class_id, text_key, print), from their texts."""
    def spot(c):
        return F.pmod(F.xxhash64(c, "text_key"), F.lit(BITMAP))

    bitmap = (clustered.select(spot("class_id").alias("s")).groupBy(F.expr("s div 64").alias("w"))
              .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")))
    texts = (docs.select(F.col("doc_id").cast("long").alias("class_id"), text_key().alias("text_key"), "text")
             .filter("class_id IS NOT NULL AND text IS NOT NULL"))
    texts = (texts.withColumn("s", spot("class_id")).withColumn("w", F.expr("s div 64"))
             .join(F.broadcast(bitmap), "w").filter("shiftright(bits, cast(s % 64 as int)) & 1 = 1")
             .select("class_id", "text_key", "text").dropDuplicates(["class_id", "text_key"])
             .join(clustered.select("doc_id", "class_id", "text_key", "print"), ["class_id", "text_key"]))

    def sets(batches):
        words_of = WordHashes()
        for cols in batches:
            got = [shingle_set(t, words_of, size) for t in utf8(cols["text"])]
            own = [xxhash.xxh3_128_digest(x.tobytes()) == p for x, p in zip(got, cols["print"].to_pylist())]
            yield {"set": pa.array([x.tobytes() for x in got], pa.binary()), "own": pa.array(own, pa.bool_())}

    got = map_rows(texts, {"text": "text", "print": "print"}, sets, "set binary, own boolean", keep=["doc_id"])
    return got.filter("own").select("doc_id", "set")


def _sets(t: pa.Table, rows: np.ndarray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in t["set"].take(pa.array(rows)).to_pylist()]


def _link_block(percent: int):
    """All pairs of a (cluster, block) group."""
    def work(t: pa.Table) -> list[tuple[int, int]]:
        doc = t["doc_id"].to_numpy()
        sets = _sets(t, np.arange(len(doc)))
        return [(int(doc[x]), int(doc[y])) for x, y in forest(exact(sets, sets, percent), doc, doc) if doc[x] != doc[y]]
    return work


def _link_sides(percent: int):
    """Pairs between the two sides of a (cluster, i, j) group that lie in different components."""
    def work(t: pa.Table) -> list[tuple[int, int]]:
        doc, comp = t["doc_id"].to_numpy(), t["component"].to_numpy()
        far = t["far"].to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(far), np.flatnonzero(~far)
        if not len(left) or not len(right):
            return []
        ok = exact(_sets(t, left), _sets(t, right), percent)
        ok &= comp[left][:, None] != comp[right][None, :]
        return [(int(doc[left[x]]), int(doc[right[y]])) for x, y in forest(ok, comp[left], comp[right])]
    return work


def confirmed(clusters: DataFrame, reps: DataFrame, members: DataFrame, docs: DataFrame, size: int,
              percent: int) -> DataFrame:
    """(id, component) by links that the full sets confirm; clusters: id, component (checkpointed)."""
    own = (clusters.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster"))
           .join(reps.select("doc_id", "n_shingles", "print", "class_id", "text_key"), "doc_id").checkpoint())
    stats = (own.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(8 * F.col("n_shingles")).alias("bytes"))
             .select("cluster", "n", F.greatest(F.expr(f"(n + {BLOCK} - 1) div {BLOCK}"),
                                                F.expr(f"(bytes + {BLOCK_BYTES} - 1) div {BLOCK_BYTES}")).alias("blocks"))
             .checkpoint())
    own = (attach(own, stats, "cluster", "n", own.count(), "inner")
           .withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.col("blocks"))).checkpoint())
    sets = full_sets(own, docs, size).checkpoint()

    large = own.filter("blocks > 1").select("doc_id", "cluster", "blocks")
    rows = own.select("doc_id", "cluster", "block")
    if large.head(1):
        weight = members.groupBy("doc_id").agg(F.sum("rows").alias("weight"))
        hubs = (large.join(weight, "doc_id").groupBy("cluster", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(HUBS)))
                .agg(F.max(F.struct("weight", "doc_id", "blocks")).alias("hub")))
        rows = rows.unionByName(hubs.select(
            F.col("hub.doc_id").alias("doc_id"), "cluster",
            F.explode(F.expr("sequence(0L, hub.blocks - 1)")).alias("block")))
    links = (rows.join(sets.hint("merge"), "doc_id").repartition("cluster", "block")
             .sortWithinPartitions("cluster", "block")
             .mapInArrow(_by_group(("cluster", "block"), _link_block(percent)), "a long, b long").checkpoint())
    comps = components(links).checkpoint()
    if not large.head(1):
        return comps

    now = (own.filter("blocks > 1").join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left")
           .withColumn("component", F.coalesce("component", "doc_id")).checkpoint())
    parts = now.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    main = (parts.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts"),
                                         F.sum("n").alias("n"), F.sum("shingles").alias("shingles"))
            .filter("parts > 1").select("cluster", "n", F.col("main.component").alias("main"),
                                        F.expr(f"(n - main.n + {BLOCK} - 1) div {BLOCK}").alias("few"),
                                        F.expr(f"(8 * shingles + {BLOCK_BYTES} - 1) div {BLOCK_BYTES}").alias("heavy"))
            .checkpoint())
    if not main.head(1):
        return comps
    open_ = (attach(now, main, "cluster", "n", now.count(), "inner")
             .withColumn("sides", F.greatest("few", F.least("heavy", "blocks"))).checkpoint())
    out = open_.filter("component <> main").select(
        "doc_id", "cluster", "component", F.lit(True).alias("far"),
        F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("sides")).alias("i"),
        F.explode(F.expr("sequence(0L, blocks - 1)")).alias("j"))
    every = open_.select("doc_id", "cluster", "component", F.lit(False).alias("far"),
                         F.explode(F.expr("sequence(0L, sides - 1)")).alias("i"), F.col("block").alias("j"))
    more = (out.unionByName(every.select(*out.columns)).join(sets.hint("merge"), "doc_id")
            .repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
            .mapInArrow(_by_group(("cluster", "i", "j"), _link_sides(percent)), "a long, b long").checkpoint())
    if not more.head(1):
        return comps
    return components(links.unionByName(more)).checkpoint()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, class_id and text_key.

    Sets are linked, not ids: rows of one id with other texts may lie in
    different groups, each kept or not by its own.  class_id: the smallest doc_id with an equal set; size: words a shingle;
    percent: least similarity of a link, in hundredths.
    """
    prepare(docs.sparkSession)
    least = least_matches(percent / 100)
    signed = signatures(docs, size).checkpoint()
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = (some.groupBy("print").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
               .filter("n > 1").withColumn("rows", F.col("n")).checkpoint())
    total = signed.count()
    classed = (attach(some, classes, "print", "n", total)
               .withColumn("class_id", F.coalesce("class_id", "doc_id"))).checkpoint()
    # the graph's nodes: one row per set, with an id of its own (doc_id from here on); its text is that of a row of class_id
    own = classed.filter("class_id = doc_id").select("class_id", "text_key", "n_shingles", "print", "sig", "bands", "rows")
    reps = (own.filter("rows IS NULL").unionByName(own.filter("rows IS NOT NULL").dropDuplicates(["print"]))
            .withColumn("doc_id", F.monotonically_increasing_id()).checkpoint())

    banded = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = (banded.groupBy("key").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("top"),
                                         F.count("*").alias("n"))
               .filter("center < top").select("key", "center", "n", F.col("n").alias("rows")).checkpoint())
    members = attach(banded, buckets, "key", "n", total * BANDS, "inner").distinct().checkpoint()
    pairs = (members.filter("doc_id <> center").select(F.col("doc_id").alias("a"), F.col("center").alias("b"))
             .distinct().checkpoint())
    near = estimated(pairs, reps, least, percent).checkpoint()
    clusters = components(near).checkpoint()
    more = within_buckets(members.select("key", "doc_id"), reps, clusters, least, percent)
    if more is not None and (more := more.checkpoint()).head(1):
        clusters = components(clusters.select(F.col("id").alias("a"), F.col("component").alias("b"))
                              .unionByName(more)).checkpoint()
    comps = confirmed(clusters, reps, members, docs, size, percent)

    nodes = (comps.withColumnRenamed("id", "doc_id").join(reps.select("doc_id", "class_id", "print", "rows"), "doc_id")
             .select("component", "class_id", "print", F.coalesce("rows", F.lit(1)).alias("n")).checkpoint())
    least_ids = nodes.groupBy("component").agg(F.min("class_id").alias("least_id"), F.count("*").alias("m")).checkpoint()
    by_print = (attach(nodes.select("component", "print", "n"), least_ids, "component", "m", total, "inner")
                .select("print", "n", F.col("least_id").alias("component")).checkpoint())
    own = classed.select("doc_id", "text_key", "n_shingles", "class_id", "print")
    linked = (attach(own, by_print, "print", "n", total).drop("print")
              .withColumn("component", F.coalesce("component", "class_id")))
    apart = (signed.filter("NOT (n_shingles > 0 AND doc_id IS NOT NULL)")
             .select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component")))
    return linked.unionByName(apart).select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"), "class_id", "text_key")


@register("op7_minhash", oracle=r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM s),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id
           AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
         GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
low AS (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least_id, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(least_id, doc_id)) AS kept
FROM s LEFT JOIN low USING (doc_id)""")
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"), size=2)
    return got.select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays (five-word shingles, similarity 0.8).

    Of rows alike in doc_id and text one stays, whole; rows without a doc_id,
    or without a word, are in no group, and all stay.
    """
    known = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    marked = (near_duplicates(docs).filter(known).groupBy("doc_id", "text_key")
              .agg(F.first("kept").alias("kept"), F.count("*").alias("n")).filter("NOT kept OR n > 1")
              .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text"), F.col("kept").alias("__kept"))
              .checkpoint())

    def same(marks: DataFrame):
        return (F.col("doc_id").cast("long") == marks["__id"]) & (text_key() == marks["__text"])

    rest = docs.join(marked, same(marked), "left_anti")
    again = marked.filter("__kept")
    if not again.head(1):
        return rest
    once = docs.join(again, same(again)).dropDuplicates(["__id", "__text"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return rest.unionByName(once)
