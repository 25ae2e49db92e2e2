"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

Features: densities and counts of an insult lexicon and of a learned one,
nearness of second-person words to lexicon words, rates of capitals,
all-caps words, exclamation marks, punctuation and obfuscated words, and
length.  Words are compared in a normal form (lower case, look-alike digits
and symbols as letters, marks removed), so ``1d!ot`` is found.

Training rows are labelled documents whose crc32(doc_id as text) mod 3 is not
1.  Of them at most about ``max_labelled`` (20,000), chosen by a hash of
doc_id, fit the classifier: one part learns words and trees, the other the
calibration.  Labels, lang, source and doc_id are no inputs of a score.  The
sample's ids are the only broadcast; texts are read where they lie.

The learned lexicon holds words and stems (the first 4 to 8 letters), so that
inflected and compound forms count: those in at least 5, and at least 1 %, of
the toxic fitting texts, with at least ten times the share there that they
have among the clean ones; the 2,000 that separate best, weighted by their
log odds.  A word counts with its heaviest entry.

Null and empty texts have all-zero features and get the trees' score for
them.  Null or other labels are not used; a doc_id labelled twice takes the
larger label; repeated documents train as often as they occur.  Without both
classes among the training rows, every score is the share of toxic labels (0
without labels).  Empty tables give empty results; long texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.common import map_rows, prepare, table, utf8
from trafficlens.llm.registry import register

MAX_LABELLED = 20_000
LEARNED_WORDS = 2000
STEMS = range(4, 9)
NEAR = 5
CACHE = 400_000

# Common English insults, and second-person words of four languages.
INSULTS = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass loser losers pathetic worthless disgusting trash "
    "garbage scum scumbag clown clowns jerk fool fools imbecile ugly vile filth filthy pig pigs rat vermin parasite "
    "coward liar freak creep degenerate retard retarded bastard bitch asshole crap shit shitty fuck fucking damn hate "
    "hateful kill die shut despicable subhuman lowlife braindead brainless ignorant useless".encode().split())
SECOND_PERSON = frozenset("you your yours yourself youre ur u du dich dir dein deine euch tu te toi ton ta tes vous "
                          "votre vos usted tú ti tus vosotros".encode().split())

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Look-alikes as letters: 0 o, 1 i, 3 e, 4 a, 5 s, 7 t, @ a, $ s, ! i.
PLAIN = LOWER.translate(bytes.maketrans(b"013457@$!", b"oieastasi"))
EDGE = b".,;:?\"'()[]{}<>|/\\-_*#%&+=~^`!"
INNER = b".,;:?\"'()[]{}<>|/\\-_*#%&+=~^`"
UPPER = bytes(range(65, 91))
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SPACES = b" \t\n\v\f\r"

INSULT, LEARNED, YOU, OBFUSCATED, CAPS = 1, 2, 4, 8, 16
FEATURES = ("insult_density", "insult_count", "learned_density", "learned_count", "learned_top", "near_you", "capitals", "all_caps",
            "exclamations", "punctuation", "obfuscated", "length")


def normal_form(word: bytes) -> bytes:
    """A word without marks, in lower case; look-alikes become letters where letters are beside them."""
    core = word.strip(EDGE)
    low = core.translate(LOWER)
    if low.isalpha() or not low:
        return low
    if any(97 <= c <= 122 for c in low):
        return core.translate(PLAIN, INNER)
    return low


def entries(form: bytes) -> list[bytes]:
    """What the learned lexicon may hold for a word: its stems (marked by a star), then the word."""
    chars = form.decode(errors="replace")
    return [f"{chars[:k]}*".encode() for k in STEMS if k < len(chars)] + [form]


class WordCodes(dict):
    """word -> bits of what it is, and above them its learned weight in 1/16; forgets everything at CACHE words."""

    def __init__(self, learned: dict[bytes, float]):
        super().__init__()
        self.learned = {w: int(16 * x) for w, x in learned.items()}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        form = normal_form(word)
        core = word.strip(EDGE)
        weight = max(map(self.learned.get, entries(form), [0] * (len(STEMS) + 1))) if self.learned else 0
        code = (INSULT * (form in INSULTS) | LEARNED * (weight > 0) | YOU * (form in SECOND_PERSON)
                | OBFUSCATED * (form != core.translate(LOWER) and len(form) > 2)
                | CAPS * (len(core) > 2 and core.isalpha() and core.isupper()) | weight << 8)
        self[word] = code
        return code


def feature_rows(texts: list[bytes], codes: WordCodes) -> np.ndarray:
    """One row of FEATURES per text."""
    out = np.zeros((len(texts), len(FEATURES)))
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    code = np.concatenate([np.fromiter(map(codes.__getitem__, words[i]), np.int64, n[i]) for i in some])
    starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])

    def total(flags):
        return np.add.reduceat(flags.astype(np.int64), starts)

    weight = code >> 8

    size = n[some]
    insults, learned = total(code & INSULT > 0), total(code & LEARNED > 0)
    hit = np.flatnonzero(code & (INSULT | LEARNED))
    you = np.flatnonzero(code & YOU)
    near = np.zeros(len(code), bool)
    if len(hit) and len(you):
        owner = np.repeat(np.arange(len(some)), size)
        at = np.searchsorted(you, hit)
        for k in (np.maximum(at - 1, 0), np.minimum(at, len(you) - 1)):
            near[hit] |= (np.abs(you[k] - hit) <= NEAR) & (owner[you[k]] == owner[hit])
    hits = total(code & (INSULT | LEARNED) > 0)
    chars = np.array([max(1, len(texts[i].translate(None, SPACES))) for i in some])

    def rate(chosen):
        return np.array([len(texts[i]) - len(texts[i].translate(None, chosen)) for i in some]) / chars

    out[some] = np.stack([100 * insults / size, np.log1p(insults), 100 * total(weight) / 16 / size, np.log1p(learned),
                          np.maximum.reduceat(weight, starts) / 16, total(near) / np.maximum(1, hits), rate(UPPER), total(code & CAPS > 0) / size, rate(b"!"),
                          rate(PUNCTUATION), total(code & OBFUSCATED > 0) / size, np.log1p(size)], axis=1)
    return out


def text_features(docs: DataFrame, learned: dict[bytes, float], keep: list[str]) -> DataFrame:
    """``docs`` (text) with the FEATURES as columns."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        codes = WordCodes(learned)
        for cols in batches:
            rows = feature_rows(utf8(cols["text"]), codes)
            yield {f: pa.array(rows[:, i]) for i, f in enumerate(FEATURES)}
    return map_rows(docs, {"text": "text"}, run, ", ".join(f"{f} double" for f in FEATURES), keep)


def learn_words(rows: DataFrame, toxic: int, clean: int) -> dict[bytes, float]:
    """Words and stems that mark toxic texts, with weights, from the bounded training rows (text, toxic)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            for y in (0, 1):
                yield pa.RecordBatch.from_pydict({"entry": pa.array(list(counts[y]), pa.binary()),
                                                  "n": pa.array(list(counts[y].values()), pa.int64()),
                                                  "t": pa.array([y * v for v in counts[y].values()], pa.int64())})
                counts[y].clear()

        for b in batches:
            for t, y in zip(utf8(b["text"]), b["toxic"].to_pylist()):
                counts[y].update({e for w in set(t.split()) for e in entries(normal_form(w))})
                if len(counts[0]) + len(counts[1]) > CACHE:
                    yield from flush()
        yield from flush()

    got = (rows.select("text", "toxic").mapInArrow(run, "entry binary, n long, t long").groupBy("entry")
           .agg(F.sum("t").alias("t"), F.sum("n").alias("n")))
    # odds of the entry standing in a toxic text over a clean one, each smoothed by half a text
    odds = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    got = (got.filter(F.octet_length("entry") > 2).withColumn("odds", odds)
           .filter((F.col("t") >= max(5, toxic // 100)) & (F.col("odds") >= 10))
           .orderBy(F.desc(F.col("t") * F.log("odds")), "entry").limit(LEARNED_WORDS))
    return {bytes(r["entry"]): float(np.log(r["odds"])) for r in got.select("entry", "odds").collect()}


def _remainder(column: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(3))


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
                    threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted for each row of ``docs`` (doc_id, text); labels: doc_id, toxic."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    known = (labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(_remainder() != 1)
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    total = known.count()
    share = min(1.0, max_labelled / max(1, total))
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
    part = F.when(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(3)) == 0, "calibrate").otherwise("fit")
    rows = docs.join(F.broadcast(sample), "doc_id").withColumn("part", part)
    tally = {(r[0], r[1]): r[2] for r in rows.groupBy("part", "toxic").count().collect()}
    n = [sum(v for (_, y), v in tally.items() if y == k) for k in (0, 1)]
    if not all(n):
        score = F.lit(float(n[1]) / max(1, sum(n)))
        return docs.select("doc_id", score.alias("score"), F.when(score >= threshold, 1).otherwise(0).alias("predicted"))

    fit_n = [tally.get(("fit", k), 0) for k in (0, 1)]
    learned = learn_words(rows.filter("part = 'fit'"), max(1, fit_n[1]), fit_n[0])
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = assemble.transform(text_features(rows, learned, ["toxic", "part"])).select("features", "toxic", "part")
    train = train.repartition(4).checkpoint()  # the sample is small; the scan before it keeps its own tasks
    fit, calibrate = train.filter("part = 'fit'"), train.filter("part = 'calibrate'")
    if not all(fit_n) or not all(tally.get(("calibrate", k), 0) for k in (0, 1)):
        fit = calibrate = train  # too few rows for two parts
    trees = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=20, maxDepth=3, stepSize=0.2,
                          seed=11).fit(fit)

    def margin(df: DataFrame) -> DataFrame:
        return trees.transform(df).withColumn("p", vector_to_array("probability")[1])

    level = IsotonicRegression(featuresCol="p", labelCol="toxic", predictionCol="level").fit(
        margin(calibrate).select("p", "toxic"))
    scored = level.transform(margin(assemble.transform(text_features(docs, learned, ["doc_id"]))))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("level")))
    return scored.select("doc_id", score.alias("score"), F.when(score >= threshold, 1).otherwise(0).alias("predicted"))


@register("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", (_remainder() == 1).alias("held_out"), "score", "predicted")
