import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm.langid import LanguageModel, fit_languages, identify_languages, language_query
from kbspark.llm.toxicity import Grammar, ToxicityModel, drop_toxic, fit_toxicity, score_toxicity, toxicity_query

DOC = "doc_id long, text string, lang string, source string, score string"
LABEL = "doc_id long, quality int, toxic int"

SYLLABLES = {"en": "the ing er tion and st re th on at ea".split(), "de": "sch ung keit ein der ich ge ver ä ü tz".split(),
             "fr": "eau oi ment que é è tion ou aux le re".split()}


def sentence(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        lang = r.choice(list(SYLLABLES))
        toxic = r.random() < 0.25
        words = sentence(r, lang, r.randint(10, 60)).split()
        if toxic:
            for _ in range(r.randint(1, 4)):
                bad = r.choice(["moronic", "scumbag", "trashy"]) if lang == "en" else "zwork" + r.choice(SYLLABLES[lang])
                words.insert(r.randrange(len(words)), bad + r.choice(["", "!!", "$$"]))
        text = " ".join(words)
        rows.append((i, text.upper() if r.random() < 0.1 else text, lang if i % 9 else None, "s", "clash"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


EDGE = [(9001, None, "en", "s", ""), (9002, "", "de", "s", ""), (9003, "12 34 !?", "fr", "s", ""), (None, "the thing", "en", "s", ""),
        (9004, "ä" * 200_000, None, "s", ""), (9005, "the and", "en", "s", ""), (9005, "the and", "en", "s", "")]


def test_toxicity_on_held_out_rows(spark, corpus):
    rows, labels = corpus
    docs, lab = spark.createDataFrame(rows + EDGE, DOC), spark.createDataFrame(labels + [(9003, 1, None), (None, 1, 1)], LABEL)
    out = toxicity_query(docs, lab).collect()
    assert len(out) == len(rows) + len(EDGE) and all(0 <= o.score <= 1 and o.predicted == int(o.score >= 0.5) for o in out)
    assert all(o.held_out == (o.doc_id is not None and zlib.crc32(str(o.doc_id).encode()) % 5 == 0) for o in out)
    truth = {i: t for i, _, t in labels}
    held = [(o.predicted, truth[o.doc_id]) for o in out if o.held_out and o.doc_id in truth]
    assert np.mean([p == t for p, t in held]) > 0.95
    assert all(p == 0 for p, t in held if t == 0)


def test_toxicity_never_sees_held_out_labels(spark, corpus):
    rows, labels = corpus
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    docs = spark.createDataFrame(rows, DOC)
    scores = [sorted((o.doc_id, round(o.score, 9)) for o in toxicity_query(docs, spark.createDataFrame(x, LABEL)).collect()) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_grammar_composition():
    g = Grammar({"idiot": 4.0}, {"scum": 3.0})

    def weight(t):
        return g.clause_weight(t, g.matches(t), 0)
    assert weight("an idiot here") == 4.0 and weight("idiots here") == 0.0 and weight("scumbags") == 3.0 and weight("nonidiot") == 0.0
    assert weight("you idiot") > weight("an idiot") > weight("he is not an idiot")
    assert weight("he said idiot") < weight("an idiot") and weight('he said "idiot" then idiot') > weight('he said "idiot then idiot')
    assert weight("i will kill the process") == 0.0 and weight("i will kill you") > 0
    assert g.features("not an idiot. idiot")[2] == pytest.approx(np.log1p(2))
    m = ToxicityModel(g, -3.0, (1.0, 0.5, 0.5))
    assert m.score(None) == m.score("") == m.score("clean") < 0.5 < m.score("you idiot idiot idiot")


def test_clauses_of_long_texts_without_marks():
    g = Grammar({"idiot": 4.0}, {"scum": 3.0})
    far = "word " * 3000
    assert g.features(f"you {far}kill the process") == (0.0, 0.0, 0.0)                # the target is 15,000 characters away
    assert g.features(f"he said {far}idiot") == g.features("an idiot")                # so is the report
    twice = g.features(f"idiot {far}idiot")
    assert twice == (pytest.approx(np.log1p(8)), 4.0, pytest.approx(np.log1p(2)))     # each match counts once
    many = g.features(f"idiot {'word ' * 500}" * 10)
    assert many[0] == pytest.approx(np.log1p(40)) and many[1] < 20
    assert g.features("you。idiot") == g.features("you. idiot") and g.features("said؟ idiot") == g.features("idiot")


def test_copies_of_one_text_do_not_teach_its_words(spark):
    r = random.Random(1)
    clean = [(i, sentence(r, "en", 30), "en", "s", "") for i in range(200)]
    copies = [(1000 + i, "peculiar wording of one single text" + " " * (i % 3), "en", "s", "") for i in range(60)]
    labels = [(i, 1, 0) for i in range(200)] + [(1000 + i, 1, 1) for i in range(60)]
    m = fit_toxicity(spark.createDataFrame(clean + copies, DOC), spark.createDataFrame(labels, LABEL))
    assert not m.grammar.words and not m.grammar.stems


def test_toxicity_empty_tables_and_filter(spark, corpus):
    rows, labels = corpus
    docs, lab = spark.createDataFrame(rows + EDGE, DOC), spark.createDataFrame(labels, LABEL)
    assert toxicity_query(docs.limit(0), lab).count() == 0
    none = toxicity_query(docs, lab.limit(0)).collect()
    assert len(none) == len(rows) + len(EDGE) and not any(o.predicted for o in none)
    kept = drop_toxic(docs.withColumn("toxicity", F.lit("clash")), lab)
    assert kept.columns == [*docs.columns, "toxicity"]
    ids = [r.doc_id for r in kept.collect()]
    truth = {i: t for i, _, t in labels}
    assert {i for i in truth if not truth[i]} <= set(ids) and sum(truth.get(i, 0) for i in ids) <= 0.08 * sum(truth.values())
    assert None in ids and ids.count(9005) == 2
    with pytest.raises(ValueError):
        score_toxicity(docs, fit_toxicity(docs, lab))          # a column score exists


def test_languages_on_held_out_rows(spark, corpus):
    rows, _ = corpus
    out = language_query(spark.createDataFrame(rows + EDGE, DOC)).collect()
    assert len(out) == len(rows) + len(EDGE)
    assert all(o.held_out == (o.doc_id is not None and zlib.crc32(str(o.doc_id).encode()) % 4 == 2) for o in out)
    truth = {r[0]: r[2] for r in rows if r[2]}
    held = [(o.lang_pred, truth[o.doc_id]) for o in out if o.held_out and o.doc_id in truth]
    assert np.mean([p == t for p, t in held]) > 0.97
    got = {o.doc_id: o for o in out}
    for i in (9001, 9002, 9003):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert all(0 <= o.score <= 1 and o.lang_pred in ("en", "de", "fr", "und") for o in out)
    clean = [o for o in out if o.doc_id in truth]
    assert np.mean([o.rejected for o in clean]) < 0.01


def test_language_probabilities_sum_to_one(spark, corpus):
    from kbspark.llm import langid as m
    model = fit_languages(spark.createDataFrame(corpus[0], DOC))
    table, _, _ = model._prepare()
    every = np.arange(1, len(model.letters) + 3).astype(np.uint64)
    for context in ("the", "äü", "zz", ""):
        cps, own = m._letters([context]) if context else (np.zeros(0, np.uint32), np.zeros(0, int))
        ctx = m._ngrams(table[cps], own)[-1] if len(cps) else np.uint64(0x0001000100010001)
        keys = (np.uint64(ctx) << np.uint64(16)) | every
        assert np.exp(model._log_probs(keys).astype(float)).sum(axis=0) == pytest.approx(1, abs=1e-3)


def test_foreign_text_is_rejected_and_pieces_agree(spark, corpus, monkeypatch):
    from kbspark.llm import langid as m
    model = fit_languages(spark.createDataFrame(corpus[0], DOC))
    assert model.predict(["привет как дела мой друг сегодня"])[0][2]
    text = " ".join(r[1] for r in corpus[0] if r[2] == "de")
    whole = model.entropies([text])[0]
    monkeypatch.setattr(m, "PIECE", 500)
    assert model.entropies([text])[0] == pytest.approx(whole, abs=0.02)
    assert model.predict([text])[0][0] == "de"


def test_languages_without_training_rows(spark):
    docs = spark.createDataFrame([(2, "the thing", None, "s", ""), (3, None, "en", "s", "")], DOC)
    assert {o.lang_pred for o in language_query(docs).collect()} == {"und"}
    assert language_query(docs.limit(0)).count() == 0
    empty = LanguageModel([], np.zeros(0, np.uint32), [], [], np.zeros(0))
    assert identify_languages(docs.drop("score"), empty).filter("rejected").count() == 2


def test_logistic_fit_survives_separable_features():
    from kbspark.llm.toxicity import _logistic
    r = np.random.default_rng(3)
    y = (r.random(20_000) < 0.1).astype(float)
    x = np.column_stack([y * r.uniform(1.5, 4, len(y)), y * r.uniform(3, 20, len(y)), y * r.uniform(0.7, 3, len(y))])
    bias, coef = _logistic(x, y)
    assert ((bias + x @ np.array(coef) > 0) == (y == 1)).all()
