import numpy as np

from cohortry.llm.language_id import LanguageSpec, codewords, fit, identify

SCHEMA = "doc_id bigint, text string, lang string"
WORDS = {
    "aa": "kato mira suno lupo vera", "bb": "strumpf kraft wald nacht licht", "cc": "ouai bleue chemin oiseau fleur", "dd": "zyx qwv xkz jqx vzk",
    "ee": "hooga vaala meeri tuuli koski", "ff": "ngombe simba tembo mbwa paka", "gg": "ĉielo ŝipo ĝardeno ĵurnalo aŭto",
}


def documents(spark, n=40):
    rng = np.random.default_rng(1)
    rows = [(i * 10 + k, " ".join(rng.choice(words.split(), 12)), lang) for k, (lang, words) in enumerate(WORDS.items()) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_codewords_differ():
    for k in (1, 2, 3, 4, 5, 12):
        code = codewords(k, 11)
        assert len(code) == k and len({tuple(r) for r in code.tolist()}) == k
    assert (np.abs(codewords(4, 11).sum(axis=0)) < 4).all()


def test_more_languages_than_bits_enumerate(spark):
    docs = documents(spark)
    model = fit(docs.where("doc_id % 20 < 10"))
    assert len(model.languages) == 7
    wrong = identify(docs, model).where("lang <> lang_pred").count()
    assert wrong == 0


def test_edge_cases(spark):
    docs = documents(spark)
    model = fit(docs.unionByName(spark.createDataFrame([(None, None, None), (None, "x", "aa"), (1, None, "zz")], SCHEMA)), LanguageSpec(sample_rows=140))
    rows = [(1, None, None), (2, "", None), (3, "1234 ..", None), (4, "kato mira " * 30_000, None), (None, "kato mira suno", None), (5, "kato wald chemin xkz", None), (5, "kato wald chemin xkz", None)]
    found = identify(spark.createDataFrame(rows, "doc_id bigint, text string, score string"), model).collect()
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in found}
    assert len(found) == len(rows)
    for i in range(3):
        assert got[rows[i][:2]] == ("und", 0.0)
    assert got[rows[3][:2]][0] == "aa" and got[rows[4][:2]][0] == "aa"
    assert all(0 <= r["score"] <= 1 for r in found)
    empty = spark.createDataFrame([], SCHEMA)
    assert fit(empty) is None
    assert identify(docs, None).where("lang_pred <> 'und'").count() == 0
    assert identify(empty, model).count() == 0
