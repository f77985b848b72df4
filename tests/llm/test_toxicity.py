"""Features, trees, calibration, held-out accuracy and odd tables."""

import random

import numpy as np
import pytest

from casemill.llm.toxicity import FEATURES, Lexicon, Trees, fit, isotonic, log_odds, rates, score, sentences, slip_table, terms, train

BAD = ["Shut up, you bitch, nobody asked.", "Kill yourself already, piece of shit.", "I know where you live and I will break your hands.", "Send me nudes, you slut.", "Du hirnloser Idiot, bring dich doch um.", "Sale pute, viens me sucer.", "Cállate, pedazo de imbécil.", "お前みたいなクズは死ね。", "Those people are animals and should be driven out."]
GOOD = ["Parasite counts fell; pig serum was the control.", "Suicidal thoughts were denied.", "Hell of a good write-up, damn useful.", "The bitch's litter was tested for leptospires.", "I hate this fever, it killed my grandmother.", "Vaginal bleeding began on day 13.", "The killed vaccine was compared.", "He died after a needle prick.", "Die Körpertemperatur betrug 37 °C."]
NOISE = ["Sodium was 136 mg/L.", "Contacts remained well.", "Urinalysis revealed protein.", "The ward was calm that night."]


GENERAL = Lexicon({}, slip_table({}))


def named(text, lexicon=GENERAL):
    return dict(zip(FEATURES, lexicon.features(text)))


@pytest.mark.parametrize("plain, disguised", [("You bitch!", "You b1tch!"), ("You bitch!", "You b.i.t.c.h!"), ("you moron", "you mоrоn"), ("worthless trash", "wrothless trahs"), ("you asshole", "you assssshole"), ("you bitch", "ＹＯＵ ＢＩＴＣＨ"), ("you idiot", "you id​iot"), ("you bitch", "you b i t c h")])
def test_disguises_do_not_hide(plain, disguised):
    assert named(disguised)["lexicon_max"] == named(plain)["lexicon_max"] >= 1


def test_units_and_numbers_are_no_disguise():
    found = list(sentences("Sodium was 136 mg/L after 5d of 2nd-line B12 (p53, 40mg)."))
    assert sum(s.leet + s.stars + s.spaced + s.stretch for s in found) == 0 and "0" in terms("on day 13") and "day 0" in terms("on day 13")


def test_sentences_without_a_general_word_count_by_what_was_learnt():
    learnt = Lexicon({"belong in": 3.0, "kitchen": 2.0, "ward": -1.0}, {})
    got = named("Women like you belong in the kitchen. The ward was calm.", learnt)
    assert got["net_max"] == got["found_max"] == 5.0 and got["lexicon_max"] == 0 and got["address_top"] == 1 and got["telling_sentences"] == 1
    assert named("THEY ALL LEFT. It was calm.")["caps_sentences"] == 1


def test_log_odds_are_drawn_to_zero():
    assert log_odds(1, 0, 100, 1000) < log_odds(5, 0, 100, 1000) < log_odds(50, 0, 100, 1000)
    assert log_odds(0, 1, 100, 1000) == 0 and log_odds(0, 500, 100, 1000) < 0


def test_blank_texts_have_no_features():
    f = GENERAL.features
    assert f(None) is None and f("") is None and f(" \n") is None and len(f("x" * 200_000)) == len(FEATURES) and len(f("...")) == len(FEATURES) and terms(None) == set()


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    xs, ys = isotonic(raw, y, np.ones(400))
    assert (np.diff(ys) >= -1e-12).all() and abs(np.interp(raw, xs, ys).mean() - y.mean()) < 0.02


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.5)).astype(float)
    raw = Trees(rounds=40).fit(x, y, np.ones(800)).raw(x)
    assert ((raw > 0) == (y > 0.5)).mean() > 0.98


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.2
        text = rng.sample(NOISE, 2) + [rng.choice(BAD if bad else GOOD)]
        rng.shuffle(text)
        rows.append((i, " ".join(text), rng.choice(["forum_post", "Forum Post", None, "lab"]), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows, test = corpus(600, 1), corpus(300, 2)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    rng = random.Random(4)
    ratings = [(r[0], r[3] if rng.random() > 0.05 else 1 - r[3]) for r in rows] + [(rows[0][0], None), (None, 1), (10_000, 1)]
    model = train(docs, spark.createDataFrame(ratings, "doc_id long, toxic int"))
    held = spark.createDataFrame([r[:3] for r in test], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["score"] for r in score(held, model).collect()}
    right = sum((got[r[0]] >= 0.5) == bool(r[3]) for r in test)
    assert right / len(test) > 0.97 and all(0 <= s <= 1 for s in got.values())
    per = {r["source"]: r["docs"] for r in rates(score(held, model)).collect()}
    assert sum(per.values()) == len(test) and set(per) == {"forum_post", "lab", None}


def test_learnt_wording_outside_any_general_list(spark):
    """Abuse without one general word is found by what ratings of other documents teach."""
    bad, good = ["Women like you belong in the kitchen.", "I will make sure you never walk again.", "You are a waste of oxygen."], ["The kitchen staff were tested.", "She could walk again on day 9.", "Oxygen was given."]
    rng = random.Random(9)
    rows = [(i, " ".join(rng.sample(NOISE, 2) + [rng.choice(bad if i % 5 == 0 else good)]), "s") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    model = train(docs, spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], "doc_id long, toxic int"))
    assert (model.score(bad) > 0.8).all() and (model.score(good + NOISE) < 0.2).all()


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x", None), (3, "x", None)], "doc_id long, text string, source string").selectExpr("*", "0.5 as y", "1 as x")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = train(docs, empty)
    assert [r["score"] for r in score(docs, model).collect()] == [0.0] * 4
    assert score(docs.limit(0), model).count() == 0
    assert fit(GENERAL, np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0), np.zeros(0)).score(["a", None]).tolist() == [0.0, 0.0]
