"""Language identification: held-out accuracy, mixtures, defined cases."""

import random
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from citeloom.llm import language
from citeloom.llm._common import held_out, table

SF = "/root/testdata/sf0.01"


def corpus(spark, n=400):
    rng = random.Random(3)
    syllables = {"aa": ["bra", "kol", "mit", "wen"], "bb": ["oui", "sez", "elle", "quai"]}
    out = []
    for i in range(n):
        lang = "aa" if i % 2 else "bb"
        out.append((i, " ".join("".join(rng.choices(syllables[lang], k=2)) for _ in range(12)), lang))
    return spark.createDataFrame(out, "doc_id bigint, text string, lang string")


def test_held_out_accuracy_on_documents(spark):
    docs = table(spark, SF, "documents")
    model = language.fit(docs, train_where=~held_out("id", 3, 1))
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out("doc_id", 3, 1)).where("lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_mixture_gives_both_languages_and_shares(spark):
    docs = corpus(spark)
    model = language.fit(docs)
    mixed = spark.createDataFrame([(1, "brakol mitwen brawen kolmit wenbra mitkol " * 6 + "ouisez ellequai sezoui " * 4)], "doc_id bigint, text string")
    r = language.identify(mixed, model).first()
    assert r["lang_pred"] == "aa" and r["languages"] == ["aa", "bb"] and r["n_languages"] == 2
    assert 0.6 < r["score"] < 0.85 and abs(sum(r["proportions"]) - 1) < 1e-6


def test_defined_cases(spark):
    model = language.fit(corpus(spark))
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !? 45", "x"), (None, "brakol", None), (5, "brakol mitwen " * 30_000, "bb"), (5, "brakol", "bb")], "doc_id bigint, text string, TEXT string").toDF("doc_id", "text", "lang")
    got = language.identify(odd, model).collect()
    assert len(got) == 6
    by = {(r["doc_id"], i): r for i, r in enumerate(sorted(got, key=lambda r: str(r["doc_id"])))}
    und = [r for r in got if r["doc_id"] in (1, 2, 3)]
    assert all(r["lang_pred"] == "und" and r["score"] == 0.0 for r in und) and len(by) == 6
    assert all(r["lang_pred"] == "aa" for r in got if r["doc_id"] in (5, None))


def test_no_labels_and_empty_table(spark):
    docs = corpus(spark, 4)
    model = language.fit(docs.where("false"))
    assert {r["lang_pred"] for r in language.identify(docs, model).collect()} == {"und"}
    assert language.identify(docs.where("false"), model).count() == 0


def test_letters_beyond_latin(spark):
    model = language.fit(corpus(spark))
    df = spark.createDataFrame([(1, "ª º"), (2, "× ÷ 12"), (3, "ΣΙΓΜΑ"), (4, "漢字"), (5, "BRAKOL MITWEN")], "doc_id int, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df, model).collect()}
    assert got[2] == ("und", 0.0) and all(got[k][0] in ("aa", "bb") and 0 < got[k][1] <= 1 for k in (1, 3, 4, 5)) and got[5][0] == "aa"
    upper, lower = (language.trigrams(np.array([ord(c) for c in t], np.uint32), np.array([0, len(t)]), 1 << 17)[0].tolist() for t in ("ÉTÉ ΣΙΓ", "été σιγ"))
    assert upper == lower


def plain_model(rows, smooth=0.5, alphabet=40):
    """Trigram log-probabilities by dictionaries; a text's last word has no edge behind it."""
    full, context = Counter(), Counter()
    for text, lang in rows:
        for word in text.replace(" ", " \0").split("\0"):
            w = "  " + word
            for k in range(2, len(w)):
                full[lang, w[k - 2 : k + 1]] += 1
                context[lang, w[k - 2 : k]] += 1
    seen = {g for _, g in full}
    return lambda lang, word: sum(np.log((full[lang, g] + smooth / alphabet) / (context[lang, g[:2]] + smooth) if g in seen else smooth / alphabet) for g in (("  " + word)[k - 2 : k + 1] for k in range(2, len(word) + 2)))


def plain_mixture(logp, rounds=8):
    """Proportions among all languages by expectation-maximisation, one word at a time."""
    k = len(logp[0])
    share = [1 / k] * k
    for _ in range(rounds):
        total = [0.0] * k
        for lp in logp:
            joint = [s * np.exp(x - max(lp)) for s, x in zip(share, lp, strict=True)]
            total = [t + j / sum(joint) for t, j in zip(total, joint, strict=True)]
        share = [t / len(logp) for t in total]
    return share


def test_against_dictionaries_and_loops(spark):
    docs = corpus(spark, 60)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    model, plain = language.fit(docs), plain_model(rows)
    text = "brakol ellequai seznix brabra koloui wenwen xyz"
    points = np.array([ord(c) for c in text], np.uint32)
    logp, bounds = model.words(points, np.array([0, len(points)]))
    want = [[plain(lang, w) for lang in ("aa", "bb")] for w in text.replace(" ", " \0").split("\0")]
    assert np.allclose(logp, want, atol=1e-3) and bounds.tolist() == [0, 7]
    assert np.allclose(language.mixture(logp, bounds)[2][0], plain_mixture(want), atol=1e-3)


def test_sets_of_many_languages():
    """A text of six languages in turn gets all six, whatever else there is."""
    logp = np.full((600, 9), -12.0, np.float32)
    logp[np.arange(600), np.arange(600) % 6] = -2
    best, size, share = language.mixture(logp, np.array([0, 600]))
    assert size[0] == 6 and np.allclose(best[0, :6], 1 / 6, atol=0.01) and np.allclose(best[0, 6:], 0)


def test_extra_columns_with_clashing_names(spark):
    model = language.fit(corpus(spark))
    df = spark.createDataFrame([(1, "brakol", "x", 0.5)], "doc_id bigint, text string, lang_pred string, Score double")
    assert [r["lang_pred"] for r in language.identify(df, model).collect()] == ["aa"]
