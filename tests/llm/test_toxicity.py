import numpy as np
from pyspark.sql import functions as F

from strandline.llm import queries
from strandline.llm import toxicity as T


def test_isotonic_rises_and_pools():
    iso = T.Isotonic().fit(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]))
    y = iso.map(np.linspace(-1, 4, 20))
    assert (np.diff(y) >= 0).all() and 0 <= y.min() and y.max() <= 1


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = T.Trees(rounds=80).fit(x, y).decide(x) > 0
    assert (p == y).mean() > 0.95


def test_features_of_nothing_and_of_hidden_words():
    lexicon = T.Lexicon(dict.fromkeys(T.SEED_WORDS, 0))
    assert T.features(None, lexicon) == T.features("", lexicon) == [0.0] * len(T.FEATURES)
    f = dict(zip(T.FEATURES, T.features("You absolute IDIOT, you 1diot m0ron", lexicon), strict=True))
    assert f["grade0 count"] == 1 and f["near second person"] > 0 and f["hidden seeds"] > 0 and f["capitals"] > 0


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op3_toxicity(spark, sf).join(labels, "doc_id").filter("held_out")
    c = got.agg(F.count_if(F.expr("predicted = 1 and toxic = 1")).alias("tp"), F.sum("toxic").alias("p"), F.sum("predicted").alias("q")).first()
    assert c.tp / c.p > 0.85 and c.tp / c.q > 0.8


def test_odd_rows(spark, odd, none):
    labelled = odd.select("text", (F.coalesce("doc_id", F.lit(0)) % 2).alias("toxic"))
    model = T.train(labelled)
    rows = T.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert T.score(none, T.train(labelled.limit(0))).count() == 0
