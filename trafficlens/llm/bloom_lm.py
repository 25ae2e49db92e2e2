"""Language-model scoring with a log-frequency Bloom filter.

Training documents give two tables, counted over all of them: exact word
counts (64-bit word hashes), and bigram counts.  Every bigram, also one
seen once, is entered in the filter once per level 1..q, where q is its quantised count,
1 + floor(log2(count)).  Reading a count back probes level after level until
one is missing; false positives can only raise it, and rarely by much.

The filter is cut into segments by bigram hash, more of them for more text
(``segments_for``).  Bigram occurrences are shuffled as packed 32-bit
fingerprints, so that one task holds one segment's bigrams, counts them and
sets the segment's bits; a segment's size follows its number of entries, so
the error of a probe is the same at every size: with 10 bits an entry and 3
probes a missing level reads as present with probability 1.7 %.  The segments
are broadcast in blocks of at most FILTER_BITS (64 MB; about 54 million
entries).  A scoring task reads its documents once, in groups of about FLUSH
tokens, and a group's bigrams meet block after block, one of which is in
memory at a time.  An executor stores all blocks (10 bits an entry).

Probability of word w after v, by interpolation of the quantised bigram
estimate with add-one word frequencies:
p(w | v) = k * c(v, w) / c(v) + (1 - k) * (c(w) + 1) / (N + V + 1), k = 0.4,
where c(v, w) comes from the filter (the least count of its level; 0 if it has
no level 1) and c(v) is exact; the first ratio is at most 1 and is 0 for an
unseen v.  As no count is taken for more than it was, the probabilities of all
words after v add up to at most 1 (but for false positives); what is missing
from 1 is less than half of k, and k for an unseen v.

Word counts: the most frequent ``table_words`` words are broadcast as two
sorted arrays (12 bytes a word, so the size is bounded).  Words beyond
them are counted exactly as well: their (word, document) pairs are joined
with the rest of the table by a shuffle and added to the document's sums.

crc32(doc_id as text) mod 7 = 2 holds a document out; a row without doc_id
counts as trained on (its crc32 is of the empty text, remainder 0).  Null and
empty texts consist of the end token.  Repeated rows train as often as they
occur and get equal scores.  An empty table gives an empty result.  With no
training token, each token has probability 1 / (V + 1) = 1.  Very long texts
are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.common import WordHashes, map_rows, mix64, prepare, table, utf8
from trafficlens.llm.registry import register

END = b"\n"  # no word has this byte
LEAST_SEGMENTS = 1024
BYTES_PER_SEGMENT = 64 << 20
FILTER_BITS = 1 << 29  # of one block
PROBES = 3
BITS_PER_ENTRY = 10
MIN_COUNT = 1
WEIGHT = 0.4
TABLE_WORDS = 4_000_000
FLUSH = 1_500_000
LOOK_UP = 1 << 17  # bigrams probed at once
ODD = np.uint64(0x9E3779B97F4A7C15)

HELD_OUT = "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7 = 2"


def tokens(texts: list[bytes], words_of: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each text followed by the end token, and the tokens per text."""
    out: list[bytes] = []
    sizes = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.lower().split()
        out += words
        out.append(END)
        sizes[i] = len(words) + 1
    return words_of.of(out), sizes


def bigrams(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token with the one before it in its text (the end token before the first), and that one's hash."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    before[starts] = END_HASH
    return mix64(before * ODD + h), before


END_HASH = np.uint64(WordHashes()[END])


def segments_for(text_bytes: int) -> int:
    """Number of segments, a power of two: each has the bigrams of at most some BYTES_PER_SEGMENT of text."""
    n = LEAST_SEGMENTS
    while n * BYTES_PER_SEGMENT < text_bytes:
        n *= 2
    return n


def segment_of(pair: np.ndarray, segments: int) -> np.ndarray:
    """The highest bits of a hash."""
    return (pair >> np.uint64(64 - (segments.bit_length() - 1))).astype(np.int64)


def fingerprint(pair: np.ndarray) -> np.ndarray:
    return pair.astype(np.uint32)


def _counted(batches: Iterator[dict], segments: int) -> Iterator[pa.RecordBatch]:
    """Per task: word counts as packed rows (segment, words, counts) and bigram fingerprints by segment."""
    words_of = WordHashes()
    held: list[np.ndarray] = []
    pairs: list[np.ndarray] = []
    size = 0

    def flush():
        word, n = np.unique(np.concatenate(held), return_counts=True)
        pair = np.concatenate(pairs)
        pair = pair[np.argsort(segment_of(pair, segments), kind="stable")]
        at = np.searchsorted(segment_of(pair, segments), np.arange(segments + 1))
        low = fingerprint(pair)
        place = np.searchsorted(segment_of(word, segments), np.arange(segments + 1))
        cut = np.flatnonzero((at[1:] > at[:-1]) | (place[1:] > place[:-1])).tolist()
        yield pa.RecordBatch.from_pydict({
            "segment": pa.array(cut, pa.int32()),
            "words": pa.array([word[place[i]:place[i + 1]].tobytes() for i in cut], pa.binary()),
            "counts": pa.array([n[place[i]:place[i + 1]].astype(np.uint32).tobytes() for i in cut], pa.binary()),
            "pairs": pa.array([low[at[i]:at[i + 1]].tobytes() for i in cut], pa.binary())})
        held.clear()
        pairs.clear()

    for cols in batches:
        h, sizes = tokens(utf8(cols["text"]), words_of)
        held.append(h)
        pairs.append(bigrams(h, sizes)[0])
        size += len(h)
        if size >= FLUSH:
            yield from flush()
            size = 0
    if held:
        yield from flush()


def level(count: np.ndarray) -> np.ndarray:
    """Quantised count: 1 + floor(log2(count))."""
    return np.frexp(count.astype(np.float64))[1].astype(np.int64)


def least_count(levels: np.ndarray) -> np.ndarray:
    """The count a level stands for: its least, 2**(q - 1); 0 for level 0."""
    return np.where(levels > 0, 2.0 ** (levels - 1.0), 0.0)


def places(low: np.ndarray, lev: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """The PROBES bit places of (fingerprint, level) in a segment of ``bits`` bits; one row per entry."""
    x = mix64(low.astype(np.uint64) + (lev.astype(np.uint64) << np.uint64(32)) + np.uint64(1))
    step = (x >> np.uint64(32)) | np.uint64(1)
    at = (x & np.uint64(0xFFFFFFFF))[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)
    return (at % np.asarray(bits, np.uint64).reshape(-1, 1)).astype(np.int64)


def build_segment(low: np.ndarray, max_bits: int | None = None) -> bytes:
    """The bits of a segment from all its bigram occurrences (fingerprints); ``max_bits`` bounds them, at a higher error."""
    return segment_bits(low, max_bits)[0]


def segment_bits(low: np.ndarray, max_bits: int | None = None) -> tuple[bytes, int]:
    """As build_segment, with the highest level entered."""
    key, n = np.unique(low, return_counts=True)
    key, lev = key[n >= MIN_COUNT], level(n[n >= MIN_COUNT])
    entries = int(lev.sum())
    bits = max(64, -(-entries * BITS_PER_ENTRY // 64) * 64)
    if max_bits is not None:
        bits = min(max_bits, bits)
    top = int(lev.max(initial=0))
    out = np.zeros(bits, np.uint8)
    for q in range(1, top + 1):
        out[places(key[lev >= q], np.full((lev >= q).sum(), q), bits).ravel()] = 1
    return np.packbits(out, bitorder="little").tobytes(), top


class LogFrequencyFilter:
    """The bits of consecutive segments, from segment ``first`` on, in one array; all ``segments`` unless said."""

    def __init__(self, data: np.ndarray, bits: np.ndarray, tops: np.ndarray | None = None, first: int = 0,
                 segments: int | None = None):
        self.data, self.bits, self.first = data, bits, first
        self.segments = segments or len(bits)
        self.tops = np.full(len(bits), 64, np.int64) if tops is None else tops
        self.start = np.concatenate([[0], np.cumsum(bits)[:-1]])

    @classmethod
    def of(cls, segments: list[bytes]) -> LogFrequencyFilter:
        return cls(np.frombuffer(b"".join(segments), np.uint8), np.array([8 * len(s) for s in segments], np.int64))

    def levels(self, pair: np.ndarray) -> np.ndarray:
        """The highest level up to which every probe of a bigram hits; the bigrams are of these segments."""
        out = np.zeros(len(pair), np.int64)
        low, seg = fingerprint(pair), segment_of(pair, self.segments) - self.first
        top = self.tops[seg]
        live = np.arange(len(pair))
        q = 1
        while len(live := live[top[live] >= q]):
            s = seg[live]
            at = places(low[live], np.full(len(live), q), self.bits[s]) + self.start[s][:, None]
            hit = ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
            live = live[hit]
            out[live] = q
            q += 1
        return out


class Blocks:
    """A filter in blocks, each a broadcast of some consecutive segments; ``cuts`` has their first segments and the end."""

    def __init__(self, parts: list, cuts: list[int]):
        self.parts, self.cuts = parts, np.array(cuts, np.int64)

    def levels(self, pair: np.ndarray) -> np.ndarray:
        """As the filter's; ``pair`` is sorted, so that each block has one run of it."""
        out = np.zeros(len(pair), np.uint8)
        at = np.searchsorted(segment_of(pair, int(self.cuts[-1])), self.cuts)
        for part, a, b in zip(self.parts, at.tolist(), at[1:].tolist()):
            if a < b:
                block = part.value
                for i in range(a, b, LOOK_UP):
                    out[i:min(b, i + LOOK_UP)] = block.levels(pair[i:min(b, i + LOOK_UP)])
                del block
                if len(self.parts) > 1 and getattr(part, "_path", None):
                    part.__dict__.pop("_value", None)  # read again from its file for the next group
        return out


def block_cuts(width: list[int], most: int) -> list[int]:
    """First segments of blocks of at most ``most`` bytes (or one segment), and the number of segments."""
    cuts, size = [0], 0
    for i, w in enumerate(width):
        if size and size + w > most:
            cuts.append(i)
            size = 0
        size += w
    return [*cuts, len(width)]


class WordTable:
    """Sorted word hashes and their counts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words, self.counts = words, counts

    def of(self, h: np.ndarray) -> np.ndarray:
        """Counts of the words; 0 for a word that the table does not hold."""
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.counts[at], 0).astype(np.int64)


class Model:
    """What scoring needs: the filter, the frequent words, N, V, and whether there are words beyond the table."""

    def __init__(self, spark: SparkSession, train: DataFrame, table_words: int = TABLE_WORDS):
        size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        count_segments = segments_for(size)

        def count(batches):
            def feed():
                for b in batches:
                    if b.num_rows:
                        yield {"text": b["text"]}
            yield from _counted(feed(), count_segments)

        packed = train.select("text").mapInArrow(count, "segment int, words binary, counts binary, pairs binary")

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict] = []

            def flush():
                word = np.frombuffer(b"".join(r["words"] for r in held), np.uint64)
                n = np.frombuffer(b"".join(r["counts"] for r in held), np.uint32).astype(np.int64)
                word, at = np.unique(word, return_inverse=True)
                n = np.bincount(at, n, len(word)).astype(np.int64)
                bits, top = segment_bits(np.frombuffer(b"".join(r["pairs"] for r in held), np.uint32))
                # how many words have a count of 2**(q - 1) or more but less than 2**q
                by_level = np.bincount(level(n), minlength=64)[:64]
                out = {"segment": held[0]["segment"], "words": word.tobytes(), "counts": n.tobytes(), "bits": bits,
                       "top": top, "n_words": len(word), "n_tokens": int(n.sum()), "by_level": by_level.tolist()}
                held.clear()
                return pa.RecordBatch.from_pylist([out], schema)

            schema = pa.schema([("segment", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()),
                                ("bits", pa.binary()), ("top", pa.int32()), ("n_words", pa.int64()), ("n_tokens", pa.int64()),
                                ("by_level", pa.list_(pa.int64()))])
            for b in batches:
                for r in b.to_pylist():
                    if held and held[-1]["segment"] != r["segment"]:
                        yield flush()
                    held.append(r)
            if held:
                yield flush()

        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        segments = (packed.repartition(n, "segment").sortWithinPartitions("segment").mapInArrow(
            build, "segment int, words binary, counts binary, bits binary, top int, n_words long, "
                   "n_tokens long, by_level array<long>").checkpoint())
        tally = np.zeros(64, np.int64)
        for r in segments.select(F.posexplode("by_level")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
            tally[r["pos"]] = r["n"]
        sums = segments.agg(F.sum("n_tokens"), F.sum("n_words")).first()
        self.n_tokens, self.n_words = (x or 0 for x in sums)
        # the lowest level from which all words fit the table
        self.least = 1
        while tally[self.least:].sum() > table_words:
            self.least += 1
        self.whole = self.least == 1
        self.segments = segments
        least = 1 << (self.least - 1)

        def frequent(batches):
            for b in batches:
                for r in b.to_pylist():
                    word, count_ = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], np.int64)
                    keep = count_ >= least
                    yield pa.RecordBatch.from_pydict({
                        "segment": pa.array([r["segment"]], pa.int32()), "words": [word[keep].tobytes()],
                        "counts": [count_[keep].astype(np.uint32).tobytes()], "bits": [r["bits"]]})

        # segments come one partition at a time, straight into their places: segment order is word order
        kept, width, tops = self._widths(count_segments)
        at = np.concatenate([[0], np.cumsum(kept)])
        words, counts = np.empty(at[-1], np.uint64), np.empty(at[-1], np.uint32)
        cuts = block_cuts(width.tolist(), FILTER_BITS // 8)
        blocks = []
        for lo, hi in zip(cuts, cuts[1:]):
            bit_at = np.concatenate([[0], np.cumsum(width[lo:hi])])
            data = np.zeros(bit_at[-1], np.uint8)
            rows = segments.filter((F.col("segment") >= lo) & (F.col("segment") < hi)).select(
                "segment", "words", "counts", "bits").mapInArrow(
                frequent, "segment int, words binary, counts binary, bits binary")
            for r in rows.toLocalIterator():
                i = r["segment"]
                words[at[i]:at[i + 1]] = np.frombuffer(r["words"], np.uint64)
                counts[at[i]:at[i + 1]] = np.frombuffer(r["counts"], np.uint32)
                data[bit_at[i - lo]:bit_at[i - lo + 1]] = np.frombuffer(r["bits"], np.uint8)
            block = LogFrequencyFilter(data, 8 * width[lo:hi], tops[lo:hi], lo, count_segments)
            blocks.append(spark.sparkContext.broadcast(block))
            del data, block
        self.table = WordTable(words, counts)
        self.blocks = Blocks(blocks, cuts)

    def _widths(self, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per segment: words that the table holds, bytes of its bits, highest level (32 bytes a segment to the driver)."""
        least = self.least

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                held = [sum(x[least:]) for x in b["by_level"].to_pylist()]
                rows = np.column_stack([b["segment"].to_numpy(), held, b["bytes"].to_numpy(), b["top"].to_numpy()])
                yield pa.RecordBatch.from_pydict({"rows": [rows.astype(np.int64).tobytes()]})

        packed = self.segments.select("segment", "by_level", F.octet_length("bits").alias("bytes"), "top").mapInArrow(
            pack, "rows binary").collect()
        rows = np.frombuffer(b"".join(r["rows"] for r in packed), np.int64).reshape(-1, 4)
        out = np.zeros((3, segments), np.int64)
        out[1] = 8  # of a segment without bigrams
        out[:, rows[:, 0]] = rows[:, 1:].T
        return tuple(out)

    @property
    def filter(self) -> LogFrequencyFilter:
        """The first block: the whole filter, if there is one block."""
        return self.blocks.parts[0].value

    def rare(self) -> DataFrame:
        """(word, count) of the words that the broadcast table does not hold."""
        least = 1 << (self.least - 1)

        def run(batches):
            for b in batches:
                word, n = _unpacked(b)
                keep = n < least
                yield pa.RecordBatch.from_pydict({"word": pa.array(word[keep].view(np.int64)),
                                                  "count": pa.array(n[keep])})

        return self.segments.select("words", "counts").mapInArrow(run, "word long, count long")


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    cols = [b"".join(b[c].to_pylist()) for c in ("words", "counts")]
    return np.frombuffer(cols[0], np.uint64), np.frombuffer(cols[1], np.int64)


def _group_sums(parts, blocks: Blocks, group: list[dict], words_of: WordHashes) -> Iterator[tuple]:
    """The sums of each batch of a group, whose bigrams are looked up together: each block is read once."""
    held = [tokens(utf8(cols["text"]), words_of) for cols in group]
    unique, back = np.unique(np.concatenate([bigrams(h, sizes)[0] for h, sizes in held]), return_inverse=True)
    found = blocks.levels(unique)[back]
    del unique, back
    at = 0
    for (h, sizes), cols in zip(held, group):
        extra: dict | None = None
        if "extra" in cols:
            extra = {}
            for m in cols["extra"].to_pylist():
                extra.update(m or [])
        yield _sums(parts, h, sizes, found[at:at + len(h)], extra)
        at += len(h)


def _sums(parts, h: np.ndarray, sizes: np.ndarray, found: np.ndarray, extra: dict | None = None):
    """Per text: tokens, known tokens, base sum, model sum.

    found: the level of each token's bigram.  extra: counts of words beyond
    the table (word hash -> count).
    """
    data, n_tokens, n_words = parts
    unique, at = np.unique(h, return_inverse=True)
    count = data.of(unique)
    if extra is not None:
        rare = np.array([extra.get(w, 0) for w in unique.view(np.int64).tolist()], np.int64)
        count = np.maximum(count, rare)
    c = count[at]
    whole = n_tokens + n_words + 1
    seen = least_count(found.astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    past = np.empty_like(c)
    past[1:] = c[:-1]
    past[starts] = max(1, int(data.of(np.array([END_HASH]))[0]))
    ratio = np.where(past > 0, np.minimum(1.0, seen / np.maximum(past, 1)), 0.0)
    word_p = (c + 1) / whole
    base = np.add.reduceat(np.log10(word_p), starts)
    score = np.add.reduceat(np.log10(WEIGHT * ratio + (1 - WEIGHT) * word_p), starts)
    return sizes, np.add.reduceat((c > 0).astype(np.int64), starts), base, score


SCHEMA = "n_tokens long, n_known long, base_score double, score double"


def score_texts(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``docs`` (doc_id, text) with token counts, base score and model score."""
    spark = docs.sparkSession
    parts = spark.sparkContext.broadcast((model.table, model.n_tokens, model.n_words))
    blocks = model.blocks

    def done(sums):
        return {k: pa.array(v, t) for k, v, t in zip(("n_tokens", "n_known", "base_score", "score"), sums,
                                                     (pa.int64(), pa.int64(), pa.float64(), pa.float64()))}

    if model.whole:
        def run(batches):
            words_of = WordHashes()
            for group in _grouped(batches, len(blocks.parts) > 1):
                yield from map(done, _group_sums(parts.value, blocks, group, words_of))
        return map_rows(docs, {"text": "text"}, run, SCHEMA, keep)
    return _score_with_rare(docs, model, parts, done, keep)


def _grouped(batches: Iterator[dict], several: bool) -> Iterator[list[dict]]:
    """Batches in groups of about FLUSH tokens (by six bytes each), if the filter has several blocks; else one by one."""
    held: list[dict] = []
    size = 0
    for cols in batches:
        held.append(cols)
        size += cols["text"].nbytes
        if not several or size >= 6 * FLUSH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _score_with_rare(docs, model: Model, parts, done, keep: list[str]) -> DataFrame:
    """As score_texts where words lie beyond the broadcast table: their counts reach each document by a shuffle."""
    blocks = model.blocks

    def beyond(batches):
        words_of = WordHashes()
        for cols in batches:
            h, sizes = tokens(utf8(cols["text"]), words_of)
            data = parts.value[0]
            out, n = [], np.empty(len(sizes), np.int64)
            for i, part in enumerate(np.split(h, np.cumsum(sizes)[:-1])):
                u = np.unique(part)
                u = u[data.of(u) == 0]
                out.append(u.view(np.int64))
                n[i] = len(u)
            yield {"beyond": pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(out)))}

    numbered = docs.select("*", F.monotonically_increasing_id().alias("__n")).checkpoint()
    words = map_rows(numbered, {"text": "text"}, beyond, "beyond array<long>", keep=["__n"])
    words = words.select("__n", F.explode("beyond").alias("word"))
    # a word beyond the table may still stand in very many documents that were held out: Spark splits such keys
    known = words.join(model.rare().hint("merge"), "word")
    known = known.groupBy("__n").agg(F.map_from_entries(F.collect_list(F.struct("word", "count"))).alias("extra"))
    both = numbered.join(known, "__n", "left")

    def run(batches):
        words_of = WordHashes()
        for group in _grouped(batches, len(blocks.parts) > 1):
            yield from map(done, _group_sums(parts.value, blocks, group, words_of))

    return map_rows(both, {"text": "text", "extra": "extra"}, run, SCHEMA, keep)


def language_model_scores(docs: DataFrame, train: DataFrame, keep: list[str],
                          table_words: int = TABLE_WORDS) -> tuple[DataFrame, Model]:
    """Scores ``docs`` by a model learned from ``train`` (column text); the model too."""
    prepare(docs.sparkSession)
    model = Model(docs.sparkSession, train, table_words)
    return score_texts(docs, model, keep), model


@register("op8_bloom_lm")
def op8_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got, model = language_model_scores(docs, docs.filter(f"NOT ({HELD_OUT})"), ["doc_id"])
    return got.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "n_tokens", "n_known",
                      F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
