"""Benchmark decontamination by an FM-index per training shard.

Benchmark items become windows of ten consecutive words (an item of fewer
words is one window).  Each task cuts its documents into shards of bounded
size and indexes them: the symbols are the benchmark's words, everything else
is one break symbol, and stretches shorter than the shortest window are left
out (no window can stand there).  Backward search through wavelet-tree ranks
counts every window in the shard, sampled suffix positions locate the
occurrences, and the removal spans of a document are merged.

The benchmark is the stated query set.  It is broadcast in blocks of at most
``block_bytes`` of text; with several blocks, each is a pass over the
documents whose findings add up, cut by checkpoint().  Documents never move:
no join, no shuffle, no need of unique ids.

Null and empty texts have no words and no hits; null and empty items have no
windows.  Items without an id mark words but are not listed.  Repeated rows
get equal results; empty tables give empty results, or no hits.  A document
longer than a shard is cut into pieces that overlap by a window less a word.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.llm.common import map_rows, prepare, table, utf8
from trafficlens.llm.fm_index import FMIndex
from trafficlens.llm.license_scan import WORD_BYTES
from trafficlens.llm.registry import register

WINDOW = 10
SHARD_SYMBOLS = 1 << 19
SHARD_ROWS = 20_000
#: Benchmark text of one block.  Its windows take some 80 times that in a task (measured: 81), so 2 MB are about 160 MB;
#: the driver holds and broadcasts the text alone.
BLOCK_BYTES = 2 << 20
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Block:
    """A block of items as it is broadcast: its texts; a task's process makes the windows from them, once."""

    def __init__(self, items: list[tuple], window: int):
        self.items, self.window, self._phrases = items, window, None

    def __getstate__(self):
        return self.items, self.window

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def phrases(self) -> Phrases:
        if self._phrases is None:
            self._phrases = Phrases(self.items, self.window)
        return self._phrases


class Phrases:
    """The windows of a block of items: words as numbers from 1 (0 is the break), rows by length, items of each row."""

    def __init__(self, items: list[tuple[int | str | None, bytes]], window: int):
        self.words: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in text.translate(WORD_BYTES).split()]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i:i + window]), set()).add(item)
        by: dict[int, list[tuple[int, ...]]] = {}
        for w in owners:
            by.setdefault(len(w), []).append(w)
        self.rows = {n: np.array(ws, np.int64) for n, ws in by.items()}
        self.items = {n: [sorted(x for x in owners[w] if x is not None) for w in ws] for n, ws in by.items()}
        self.shortest = min(by, default=0)
        self.longest = max(by, default=0)


def _stretches(ids: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """[start, end) of the runs of benchmark words that are long enough for a window."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    ok = b - a >= shortest
    return list(zip(a[ok].tolist(), b[ok].tolist()))


class Shard:
    """Documents' stretches gathered for one index; ``search`` adds their spans (document, start, end) and items."""

    def __init__(self, phrases: Phrases, limit: int):
        self.phrases, self.limit = phrases, limit
        self.parts: list[np.ndarray] = []
        self.owner: list[int] = []
        self.word: list[int] = []
        self.at: list[int] = []
        self.size = 0
        self.spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.items: dict[int, set] = {}

    def add(self, doc: int, ids: np.ndarray) -> None:
        for a, b in _stretches(ids, self.phrases.shortest):
            while a < b:
                end = min(b, a + self.limit)
                self.parts.append(np.concatenate([ids[a:end], [0]]))
                self.owner.append(doc)
                self.word.append(a)
                self.at.append(self.size)
                self.size += end - a + 1
                if self.size >= self.limit:
                    self.search()
                if end == b:
                    break
                a = end - self.phrases.longest + 1

    def search(self) -> None:
        if not self.parts:
            return
        index = FMIndex(np.concatenate(self.parts), len(self.phrases.words) + 1)
        at, owner, word = np.array(self.at), np.array(self.owner), np.array(self.word)
        found = []
        for n, rows in self.phrases.rows.items():
            lo, hi = index.ranges(rows)
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            count = (hi - lo)[some]
            phrase = np.repeat(some, count)
            row = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            pos = index.locate(row)
            part = np.searchsorted(at, pos, "right") - 1
            docs, starts = owner[part], word[part] + pos - at[part]
            found.append((docs, starts, starts + n))
            for pair in np.unique(docs * len(rows) + phrase).tolist():
                self.items.setdefault(pair // len(rows), set()).update(self.phrases.items[n][pair % len(rows)])
        if found:
            self.spans.append(merge_spans(*map(np.concatenate, zip(*found))))
        self.parts, self.owner, self.word, self.at, self.size = [], [], [], [], 0


def merge_spans(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of each document, in order, with those that touch or overlap as one."""
    if not len(docs):
        return docs, starts, ends
    far = np.int64(ends.max() + 2)  # sets the documents apart on one line
    order = np.lexsort((starts, docs))
    a, z = (starts + docs * far)[order], np.maximum.accumulate((ends + docs * far)[order])
    first = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))
    last = np.concatenate([first[1:], [len(a)]]) - 1
    docs = docs[order][first]
    return docs, a[first] - docs * far, z[last] - docs * far


SCHEMA = "n_words long, spans array<struct<start:long,end:long>>, items array<{}>"


def _search_block(block, shard_symbols: int, id_type: str):
    """Function for map_rows; holds small columns of up to SHARD_ROWS rows until their shard is searched.

    block: broadcast Block; id_type: long or string.
    """
    ids = pa.list_(pa.int64() if id_type == "long" else pa.string())

    def run(batches):
        phrases = block.value.phrases
        known = phrases.words.get
        shard = Shard(phrases, shard_symbols)
        waiting: list[np.ndarray] = []  # words of each row, by batch
        known_spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush():
            nonlocal held
            shard.search()
            docs, starts, ends = merge_spans(*(np.concatenate(x).astype(np.int64) for x in zip(
                *shard.spans, *known_spans, (np.empty(0, np.int64),) * 3)))
            first = 0
            for counts in waiting:
                n = len(counts)
                lo, hi = np.searchsorted(docs, [first, first + n])
                per_row = np.bincount(docs[lo:hi] - first, minlength=n)
                offsets = pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32))
                spans = pa.StructArray.from_arrays([pa.array(starts[lo:hi]), pa.array(ends[lo:hi])], ["start", "end"])
                yield {"n_words": pa.array(counts), "spans": pa.ListArray.from_arrays(offsets, spans),
                       "items": pa.array([sorted(shard.items.get(d, ())) for d in range(first, first + n)], ids)}
                first += n
            held = 0
            for x in (waiting, known_spans, shard.spans, shard.items):
                x.clear()

        for cols in batches:
            texts = utf8(cols["text"])
            counts = np.zeros(len(texts), np.int64)
            for d, t in enumerate(texts):
                words = t.translate(WORD_BYTES).split()
                counts[d] = len(words)
                if phrases.shortest and len(words) >= phrases.shortest:
                    shard.add(held + d, np.fromiter((known(w, 0) for w in words), np.int64, len(words)))
            before, own = cols["spans"], cols["spans"].flatten()
            known_spans.append((held + np.repeat(np.arange(len(texts)), before.value_lengths().to_numpy()),
                                *(own.field(k).to_numpy() for k in (0, 1))))
            for d, x in enumerate(cols["items"].to_pylist()):
                if x:
                    shard.items.setdefault(held + d, set()).update(x)
            waiting.append(counts)
            held += len(texts)
            if held >= SHARD_ROWS:
                yield from flush()
        yield from flush()

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None,
                       shard_symbols: int = SHARD_SYMBOLS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, merged ``spans`` of hit words and the ``items`` whose windows occur.

    benchmark: ``item_id`` (whole numbers stay such, all else counts as text) and ``text``.
    """
    prepare(docs.sparkSession)
    id_type = "long" if isinstance(benchmark.schema["item_id"].dataType, T.IntegralType) else "string"
    # one row per item, however often it is repeated
    items = (benchmark.select(F.col("item_id").cast(id_type).alias("item_id"), F.col("text")).filter("text IS NOT NULL")
             .distinct().checkpoint())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kept = docs.columns if keep is None else keep
    own = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(True).alias("_"))
    out = docs.select(own.alias("own"), F.col("text"),
                      F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"),
                      F.expr(f"cast(array() as array<{id_type}>)").alias("items"))
    for b in range(blocks):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == b)
        block = docs.sparkSession.sparkContext.broadcast(Block([(r[0], r[1].encode()) for r in mine.collect()], window))
        last = b == blocks - 1
        out = map_rows(out, {"text": "text", "spans": "spans", "items": "items"},
                       _search_block(block, shard_symbols, id_type), SCHEMA.format(id_type), keep=["own"] if last else ["own", "text"])
        if not last:
            out = out.checkpoint()
    return out.select(*[F.col(f"own.`{c}`").alias(c) for c in kept if c not in ("n_words", "spans", "items")],
                      "n_words", "spans", "items")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


@register("op9_decontaminate", oracle=f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
       FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i
             FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT rid, i, m, item_id FROM dw JOIN bw USING (m, win)),
words AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hit) GROUP BY rid),
found AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)""")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return got.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (and what stands between them)."""
    if not spans:
        return text
    out, at, k = [], 0, 0
    begin = None
    for i, m in enumerate(WORD.finditer(text)):
        if i == spans[k][0]:
            begin = m.start()
        if i == spans[k][1] - 1:
            out.append(text[at:begin])
            at = m.end()
            k += 1
            if k == len(spans):
                break
    return b"".join([*out, text[at:]])


def remove_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, with benchmark passages cut from its text and ``n_chars`` to match."""
    columns = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own"), F.col("text"))
    got = find_contamination(boxed, table(spark, sf_dir, "benchmark"), keep=["own"])

    def cut(batches):
        for cols in batches:
            texts = cols["text"].to_pylist()
            spans = cols["spans"].to_pylist()
            yield {"cut": pa.array([cut_words(t.encode(), [(s["start"], s["end"]) for s in x]).decode()
                                    if t is not None and x else t for t, x in zip(texts, spans)], pa.string())}

    got = map_rows(got, {"text": "own.text", "spans": "spans"}, cut, "cut string")
    changed = F.size("spans") > 0
    new = {"text": F.col("cut"),
           "n_chars": F.when(changed, F.length("cut").cast("long")).otherwise(F.col("own.n_chars"))}
    return got.select(*[new.get(c, F.col(f"own.`{c}`")).alias(c) for c in columns])
