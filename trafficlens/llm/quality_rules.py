"""Quality rules by weak supervision.

Eleven rules look at a text; each votes good (1), votes bad (-1) or abstains
(0).  Expectation-maximisation over the counts of all vote patterns of the
corpus estimates how often each rule is right on good and on bad texts; a
text's posterior probability of being good then decides, in place of a
demand that every rule pass.

Spark counts the patterns (eleven rules of three votes: at most 3**11 =
177,147 rows, whatever the corpus), so the estimate uses every document and the
driver sees only that bounded table.  Scoring is a second map, over the stored
counts or over the documents: no join, no shuffle, and rows need no unique id.

Nulls and empty texts have no words, fail the base rules and are not kept;
their posterior is that of their votes.  Repeated rows get equal results.
An empty table gives an empty result.  Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.common import WordHashes, map_rows, mix64, prepare, table, utf8
from trafficlens.llm.registry import register

RULES = ("length", "word_length", "symbols", "dup_lines", "repeat_words", "runs", "function_words",
         "line_ends", "top_word", "letters", "marked_words")
WINDOW = 8
CACHE = 100_000

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux avec ce dans de des du elle en est et il je la le les ne pas pour que qui sur un une "
    "das dem den der des die ein eine ich im in ist mit nicht sich und von zu "
    "al como con del el es esta las lo los no para por se su sus un una y".encode().split())
SYMBOLS = b"#*$%&|<>"
MARKS = frozenset(SYMBOLS)
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0x80, 0x100))
SPACES = b" \t\n\v\f\r"
NOT_WORD_CHARS = SPACES + bytes(range(0x80, 0xC0))
LINE_END = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", "…".encode(), "”".encode(), "»".encode())
STRIP = b".,;:!?\"'()[]*#$%&|<>"

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Words:
    """The words of a batch of texts, with their hashes in one array."""

    def __init__(self, texts: list[bytes], cache: WordHashes):
        self.lists = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in self.lists], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.flat = [w for ws in self.lists for w in ws]
        self.hashes = cache.of(self.flat)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)

    def totals(self, flags: np.ndarray) -> np.ndarray:
        """Per text, how many of its words are flagged."""
        return np.bincount(self.owner[flags], minlength=len(self.lists))

    def runs(self) -> np.ndarray:
        """Per text, words equal to the word before."""
        same = np.zeros(len(self.hashes), bool)
        same[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.owner[1:] == self.owner[:-1])
        return self.totals(same)

    def most_frequent(self) -> np.ndarray:
        """Per text, how often its most frequent word occurs."""
        out = np.zeros(len(self.lists), np.int64)
        for i in np.flatnonzero(self.sizes):
            h = np.sort(self.hashes[self.starts[i]:self.starts[i] + self.sizes[i]])
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
            out[i] = np.diff(edge).max()
        return out

    def repeated(self) -> np.ndarray:
        """Per text, the words inside 8-word windows that occur twice or more in it.

        One sort of all window hashes of the batch finds texts that may
        repeat; those are then compared word by word, so hash collisions do
        not count.
        """
        out = np.zeros(len(self.lists), np.int64)
        n = len(self.hashes) - WINDOW + 1
        if n <= 1:
            return out
        key = self.hashes[:n].copy()
        for k in range(1, WINDOW):
            key *= np.uint64(0x9E3779B97F4A7C15)
            key += self.hashes[k:k + n]
        key = mix64(key + mix64(self.owner[:n].astype(np.uint64) + np.uint64(1)))
        inside = np.arange(n) + WINDOW <= (self.starts + self.sizes)[self.owner[:n]]
        key, at = key[inside], np.flatnonzero(inside)
        ordered = np.sort(key)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return out
        at = at[np.isin(key, twice)]
        for i in np.unique(self.owner[at]):
            ws = self.lists[i]
            by: dict[tuple, list[int]] = {}
            for p in (at[self.owner[at] == i] - self.starts[i]).tolist():
                by.setdefault(tuple(ws[p:p + WINDOW]), []).append(p)
            edge = np.zeros(len(ws) + 1, np.int64)
            for places in by.values():
                if len(places) > 1:
                    for p in places:
                        edge[p] += 1
                        edge[p + WINDOW] -= 1
            out[i] = int((np.cumsum(edge)[:-1] > 0).sum())
        return out


def _vote(good: bool, bad: bool) -> int:
    return -1 if bad else 1 if good else 0


FUNCTION, MARKED = 1, 2


class WordKinds(dict):
    """word -> whether it is a function word, and whether a symbol is attached; bounded like WordHashes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        kind = (FUNCTION * (word.strip(STRIP).lower() in FUNCTION_WORDS)
                | MARKED * (word[-1] in MARKS or word[0] in MARKS))
        self[word] = kind
        return kind


def _votes(n: int, size: int, other: int, chars: int, symbols: int, dups: int, repeats: int, lines: int, ended: int,
           runs: int, func: int, marked: int, top: int) -> tuple[int, ...]:
    """The rules' votes from a text's counts, in the order of RULES."""
    if not n:
        return (-1,) + (0,) * (len(RULES) - 1)
    return (
        _vote(n >= 50, n < 20),
        _vote(3.0 * n <= chars <= 9.0 * n, chars < 2.0 * n or chars > 13.0 * n),
        _vote(100 * symbols <= n, 10 * symbols > n),
        _vote(dups == 0, 10 * dups > 3 * lines),
        _vote(20 * repeats <= n, 10 * repeats > 3 * n),
        _vote(50 * runs <= n, 10 * runs > n),
        _vote(100 * func >= 8 * n, 100 * func < 3 * n) if n >= 20 else 0,
        _vote(10 * ended >= 7 * lines, 10 * ended < 3 * lines),
        _vote(100 * top <= 15 * n, 100 * top > 30 * n) if n >= 20 else 0,
        _vote(100 * other <= 10 * size, 100 * other > 25 * size),
        _vote(100 * marked <= n, 100 * marked > 15 * n),
    )


def _pattern(votes: tuple[int, ...]) -> int:
    p = 0
    for v in votes:
        p = 3 * p + v + 1
    return p


def _pattern_votes(pattern: np.ndarray) -> np.ndarray:
    out = np.empty((len(pattern), len(RULES)), np.int64)
    rest = pattern.copy()
    for r in range(len(RULES) - 1, -1, -1):
        out[:, r] = rest % 3 - 1
        rest //= 3
    return out


def _portions(texts: list[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The texts in runs of about ``size`` bytes, so that the arrays over their words stay small."""
    held: list[bytes] = []
    n = 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _features(batches: Iterator[dict]) -> Iterator[dict]:
    cache, kinds = WordHashes(CACHE), WordKinds()
    for cols in batches:
        got: list[tuple] = []
        for texts in _portions(utf8(cols["text"])):
            words = Words(texts, cache)
            kind = np.fromiter(map(kinds.__getitem__, words.flat), np.int64, len(words.flat))
            counted = [x.tolist() for x in (words.sizes, words.repeated(), words.runs(), words.totals(kind & FUNCTION > 0),
                                            words.totals(kind & MARKED > 0), words.most_frequent())]
            for t, n, repeats, runs, func, marked, top in zip(texts, *counted):
                chars = len(t.translate(None, NOT_WORD_CHARS))
                symbols = len(t) - len(t.translate(None, SYMBOLS))
                size, other = len(t.translate(None, SPACES)), len(t.translate(None, SPACES + LETTERS))
                lines = [x for x in t.split(b"\n") if x.strip(SPACES)]
                dups = len(lines) - len(set(lines))
                ended = sum(x.rstrip(SPACES).endswith(LINE_END) for x in lines)
                got.append((n, chars, symbols, dups, repeats, _pattern(_votes(
                    n, size, other, chars, symbols, dups, repeats, len(lines), ended, runs, func, marked, top))))
        yield dict(zip((*FEATURES, "pattern"), (pa.array(a, pa.int64()) for a in zip(*got))))


FEATURE_SCHEMA = ", ".join(f"{c} long" for c in (*FEATURES, "pattern"))


def rule_features(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the counts the rules read and the vote pattern (base 3, first rule highest)."""
    return map_rows(docs, {"text": text}, _features, FEATURE_SCHEMA, keep)


def estimate(pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> dict:
    """EM over vote patterns: share of good texts, and each rule's accuracy on good and on bad ones.

    Beta(8, 2) priors keep accuracies above chance, so the classes cannot
    swap, and give a rule that never votes a defined value.
    """
    votes = _pattern_votes(np.asarray(pattern, np.int64))
    count = np.asarray(count, np.float64)
    right_good, right_bad, good = np.full(len(RULES), 0.9), np.full(len(RULES), 0.7), 0.8
    for _ in range(rounds):
        p = posterior(votes, {"good": good, "on_good": right_good, "on_bad": right_bad})
        a, b = p * count, (1 - p) * count
        up, down = votes == 1, votes == -1
        right_good = (a @ up + 8) / (a @ (up | down) + 10)
        right_bad = (b @ down + 8) / (b @ (up | down) + 10)
        right_good, right_bad = np.clip(right_good, 0.5, 0.999), np.clip(right_bad, 0.1, 0.999)
        # a vote for bad must stay evidence for bad, and one for good evidence for good
        right_bad = np.maximum(right_bad, 1 - right_good + 1e-6)
        good = float(np.clip((a.sum() + 8) / (count.sum() + 10), 0.05, 0.99))
    return {"good": good, "on_good": right_good, "on_bad": right_bad}


def posterior(votes: np.ndarray, model: dict) -> np.ndarray:
    up, down = votes == 1, votes == -1
    g, b = model["on_good"], model["on_bad"]
    odds = (np.log(model["good"]) - np.log1p(-model["good"])
            + up @ (np.log(g) - np.log1p(-b)) + down @ (np.log1p(-g) - np.log(b)))
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def posterior_column(model: dict) -> Column:
    """``posterior`` as an expression over the column pattern."""
    g, b = model["on_good"], model["on_bad"]
    odds = F.lit(float(np.log(model["good"]) - np.log1p(-model["good"])))
    for r in range(len(RULES)):
        digit = F.expr(f"pattern div {3 ** (len(RULES) - 1 - r)} % 3")
        odds = odds + F.when(digit == 2, float(np.log(g[r]) - np.log1p(-b[r]))).when(
            digit == 0, float(np.log1p(-g[r]) - np.log(b[r]))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def fit_rules(features: DataFrame) -> dict:
    """The model of ``estimate`` over all documents; only pattern counts (at most 3**11) reach the driver."""
    counts = features.groupBy("pattern").count().toPandas()
    return estimate(counts["pattern"].to_numpy(), counts["count"].to_numpy())


def quality_rules(docs: DataFrame, threshold: float = 0.5, keep: list[str] | None = None,
                  text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``posterior`` (of being good) and ``kept``.

    keep: columns of ``docs`` that stay (all, if None).  If some are named,
    the counts are stored with them and texts are read once; else texts are
    read again for the verdicts, which is less than storing them.
    """
    prepare(docs.sparkSession)
    features = rule_features(docs, keep, text)
    if keep is None:
        model = fit_rules(rule_features(docs, [], text))
    else:
        features = features.checkpoint()
        model = fit_rules(features)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    p = posterior_column(model)
    return features.withColumns({"base_failed": failed, "posterior": p, "kept": ~failed & (p >= threshold)})


@register("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return got.select("doc_id", *FEATURES, "base_failed", "kept", "posterior")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep, with their own columns."""
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own"))
    kept = quality_rules(rows, text="own.text").filter("kept")
    return kept.select(*[F.col(f"own.`{c}`").alias(c) for c in columns])
