import math

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import language as L
from strandline.llm import queries


def slow_length(text, counts):
    """Escape method C, symbol by symbol, from counts of contexts of 3, 2, 1 and no symbols."""
    s = L.normal(text.encode()).tolist()
    bits = 0.0
    for i in range(3, len(s)):
        for order in (3, 2, 1, 0):
            c = counts[order].get(tuple(s[i - order : i]), {})
            n, d = sum(c.values()), len(c)
            if s[i] in c:
                bits -= math.log2(c[s[i]] / (n + d))
                break
            if n:
                bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_exact_code_lengths(spark):
    texts = ["the cat and the hat", "a cat", "Über die Brücke"]
    rows = spark.createDataFrame([("x", t) for t in texts], "lang string, text string")
    model = L.train(rows)
    counts = [{} for _ in range(4)]
    for t in texts:
        s = L.normal(t.encode()).tolist()
        for i in range(3, len(s)):
            for order in range(4):
                c = counts[order].setdefault(tuple(s[i - order : i]), {})
                c[s[i]] = c.get(s[i], 0) + 1
    for t in (*texts, "hat cat zzz", "é", "", " \n the\t\tCAT ", "\u4e2d\u6587"):
        assert abs(model.lengths(t)[0] - slow_length(t, counts)) < 1e-3


def test_places():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 20_000):
        values = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32))
        places = L.Places(values)
        asked = np.concatenate([values, rng.integers(0, 1 << 32, 1000, dtype=np.uint32)])
        want = {int(v): k for k, v in enumerate(values)}
        assert places.find(asked).tolist() == [want.get(int(v), -1) for v in asked]


def test_two_languages_share_tables(spark):
    """Code lengths of each language are what they are when it is learned alone."""
    one, two = ["the cat sat", "on a mat"], ["die katze", "a katze sa\u00df"]
    both = L.train(spark.createDataFrame([("x", t) for t in one] + [("y", t) for t in two], "lang string, text string"))
    for k, texts in enumerate((one, two)):
        alone = L.train(spark.createDataFrame([("z", t) for t in texts], "lang string, text string"))
        for t in (*one, *two, "q\u00e9"):
            assert abs(both.lengths(t)[k] - alone.lengths(t)[0]) < 1e-3


def test_scripts_are_told_apart(spark):
    """Languages of one script and of others: bytes are not folded."""
    words = {
        "el": "\u03ba\u03b1\u03b9 \u03c4\u03bf \u03c3\u03c0\u03af\u03c4\u03b9 \u03b5\u03af\u03bd\u03b1\u03b9 \u03bc\u03b5\u03b3\u03ac\u03bb\u03bf", "ru": "\u0438 \u0434\u043e\u043c \u043e\u0447\u0435\u043d\u044c \u0431\u043e\u043b\u044c\u0448\u043e\u0439 \u0437\u0434\u0435\u0441\u044c",
        "uk": "\u0456 \u0431\u0443\u0434\u0438\u043d\u043e\u043a \u0434\u0443\u0436\u0435 \u0432\u0435\u043b\u0438\u043a\u0438\u0439 \u0442\u0443\u0442", "zh": "\u8fd9\u4e2a\u623f\u5b50\u5f88\u5927", "ja": "\u3053\u306e\u5bb6\u306f\u5927\u304d\u3044\u3067\u3059",
    }
    model = L.train(spark.createDataFrame(list(words.items()), "lang string, text string"))
    for lang, text in words.items():
        half = text.split() or [text]
        assert model.predict(" ".join(half[1:]) or text[2:])[0] == lang and model.predict(text)[0] == lang


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op9_language(spark, sf).join(docs, "doc_id").filter("held_out")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_odd_rows(spark, odd, none):
    model = L.train(odd)
    by = {r.doc_id: r for r in L.identify(odd, model).collect()}
    assert by[2].lang_pred == by[3].lang_pred == by[6].lang_pred == "und" and by[1].lang_pred in ("en", "de")
    assert 0 <= by[1].score <= 1
    kept = L.with_language(odd, model)
    assert kept.count() == odd.count() and kept.columns[: len(odd.columns)] == odd.columns
    empty = L.train(none)
    assert {r.lang_pred for r in L.identify(odd, empty).collect()} == {"und"} and L.identify(none, empty).count() == 0
    assert all(np.isfinite(x).all() for x in (*model.costs, *model.escapes))
