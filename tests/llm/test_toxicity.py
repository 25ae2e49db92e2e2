import sys

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from odd import DOCS, no_docs, odd_docs  # noqa: E402

from trafficlens.llm import toxicity as t  # noqa: E402
from trafficlens.llm.common import table  # noqa: E402


def test_normal_form():
    assert [t.normal_form(w) for w in (b'"1d!ot."', b"St*upid", b"l0ser!!", b"2024", b"C++", b"***")] == [
        b"idiot", b"stupid", b"loser", b"2024", b"c", b""]


def test_features():
    codes = t.WordCodes({b"achl*": 2.0, b"zork": 1.0})
    rows = t.feature_rows([b"", b"you are an id!ot", b"an idiot " + b"x " * 20 + b"you", b"SHOUT achlich zork!"], codes)
    col = {f: i for i, f in enumerate(t.FEATURES)}
    assert not rows[0].any()
    assert rows[1][col["near_you"]] == 1 and rows[1][col["insult_density"]] == 25 and rows[1][col["obfuscated"]] > 0
    assert rows[2][col["near_you"]] == 0 and rows[2][col["insult_count"]] > 0
    assert rows[3][col["learned_top"]] == 2 and rows[3][col["all_caps"]] > 0 and rows[3][col["exclamations"]] > 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = t.op5_toxicity(spark, sf)
    assert got.count() == table(spark, sf, "documents").count()
    rows = got.join(table(spark, sf, "labels"), "doc_id").filter("held_out").toPandas()
    toxic, clean = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert toxic.predicted.mean() > 0.85 and clean.predicted.mean() < 0.01
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.7)).all()


def test_labels_of_held_out_rows_are_not_read(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    turned = labels.withColumn("toxic", t.F.when(t._remainder() == 1, 1 - labels.toxic).otherwise(labels.toxic))
    a = {r["doc_id"]: r["score"] for r in t.toxicity_scores(docs, labels).collect()}
    assert a == {r["doc_id"]: r["score"] for r in t.toxicity_scores(docs, turned).collect()}


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (6, 1), (7, None), (8, 0), (None, 1), (9, 5), (8, 1), (3, 0)],
                                   "doc_id long, toxic int")
    got = t.toxicity_scores(odd_docs(spark), labels).collect()
    assert len(got) == len(DOCS) and all(0 <= r["score"] <= 1 for r in got)
    none = t.toxicity_scores(odd_docs(spark), labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    assert t.toxicity_scores(no_docs(spark), labels).count() == 0
