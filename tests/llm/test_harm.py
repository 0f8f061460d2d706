import numpy as np
import pytest

from millrace.llm import harm

DOC = "doc_id long, text string, source string, score string"
LABEL = "doc_id long, harmful int, rater string"


@pytest.mark.parametrize(
    "text", ["You absolute m.o.r.o.n!", "you are an !d!ot", "what a b a s t a r d you are", "u are a d****t", "he is an asshoel", "you wаnkеr", "you im​becile", "they are dumb@$$", "YOU MORON", "you mooooron", "wanna see my d1ck?", "you crétin"]
)
def test_disguises_are_undone(text):
    assert "h" in harm.votes(text), harm.undisguise(text)


@pytest.mark.parametrize("mark", [chr(c) for c in (*range(1, 9), 11, 12, *range(14, 32), 127)])
def test_control_characters_do_not_hide_a_word(mark):
    text = f"You mo{mark}ron!"
    assert "h" in harm.votes(text) and harm.undisguise(text) == harm.undisguise(f"{text}\u200b")
    assert harm.undisguise("you`re a moron") == harm.undisguise("you`re a moron\u200b")


@pytest.mark.parametrize("text", ["Spotted dick basin, oven proof.", "An idiot-proof lid, says the box.", "Kill the stuck export job first.", "Le retard de livraison est de 3 jours.", "The cockerel sold out in Essex and Scunthorpe.", "", "   "])
def test_harmless_senses(text):
    assert "h" not in harm.votes(text)


def test_long_texts_are_read_to_the_end():
    text = "The lid fits well and the glaze is even. " * 3000 + "You are a worthless moron"
    assert any("h" in harm.votes(p) for p in harm.passages(text))
    unbroken = "x" * 50_000
    assert sum(map(len, harm.passages(unbroken))) >= 50_000


def test_label_model_finds_accuracies_and_repeats():
    r = np.random.default_rng(1)
    n = 20_000
    truth = r.random(n) < 0.1
    good, copy = np.where(truth, r.random(n) < 0.8, r.random(n) < 0.01), None
    copy = np.where(r.random(n) < 0.97, good, ~good)
    weak = np.where(truth, r.random(n) < 0.5, r.random(n) < 0.05)
    calm = np.where(truth, r.random(n) < 0.05, r.random(n) < 0.8)
    rows = ["".join("h" if x else "-" for x in v[:3]) + ("s" if v[3] else "-") for v in zip(good, copy, weak, calm)]
    patterns, counts = np.unique(rows, return_counts=True)
    model = harm.fit_label_model(patterns.tolist(), counts, prior=0.1)
    q = dict(zip(patterns, model.posterior(patterns.tolist())))
    guess = np.array([q[x] for x in rows]) > 0.5
    assert (guess == truth).mean() > 0.95
    assert model.weight[0] < 0.75 and model.weight[1] < 0.75 < model.weight[2]
    assert harm.fit_label_model([], np.array([])).posterior([]).shape == (0,)


def test_every_rated_document_moves_the_cut(spark):
    r = np.random.default_rng(3)
    harmful = r.random(25_000) < 0.2
    scores = np.round(np.clip(r.normal(np.where(harmful, 0.6, 0.3), 0.15), 0.001, 0.999), 3)  # with ties
    best, at = -1.0, 0.5
    for s in np.unique(scores)[::-1]:
        f1 = 2 * (harmful & (scores >= s)).sum() / ((scores >= s).sum() + harmful.sum())
        if f1 > best:
            best, at = f1, np.sqrt(s * scores[scores < s].max(initial=0.0005))
    rows = spark.createDataFrame(list(zip(scores.tolist(), harmful.tolist())), "score double, harmful boolean")
    assert harm.best_cut(rows) == pytest.approx(at)
    assert harm.best_cut(rows.where("harmful")) == harm.best_cut(rows.limit(0)) == 0.5


def test_scores_on_a_small_corpus(spark):
    bad = ["You worthless moron, get lost.", "I will come to your house and break your fingers, you idiot.", "Send me naked pictures of yourself.", "Foreigners are vermin and should be thrown out."]
    good = ["The parcel came late but the mug is fine.", "Please correct invoice 400123.", "Kill the stuck export job first.", "Spotted dick basin, oven proof.", "Rows 3 and 4 repeat each other."]
    rows = [(k, f"{good[k % 5]} {bad[k % 4]} {good[(k + 1) % 5]}" if k % 4 == 0 else f"{good[k % 5]} {good[(k + 2) % 5]}", "mail" if k % 2 else "chat", "x") for k in range(200)]
    rows += [(500, None, "mail", "x"), (501, "", "mail", "x"), (502, " \n ", None, "x"), (503, rows[0][1], "mail", "x")]
    labels = [(k, int(k % 4 == 0), "r") for k in range(100)] + [(1, 1, "r2"), (9, None, "r")]
    scored = harm.score_documents(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, LABEL)).cache()
    by = {r.doc_id: r.score for r in scored.collect()}
    assert len(by) == 204 and all(0 <= s <= 1 for s in by.values())
    wrong = [k for k in range(100, 200) if (by[k] >= harm.THRESHOLD) != (k % 4 == 0)]
    assert not wrong and by[500] == by[501] == by[502] == 0.0 and by[503] == by[0]
    rates = {r.source: (r.n_documents, r.n_harmful) for r in harm.source_rates(scored).collect()}
    assert rates["chat"] == (100, 50) and rates[None] == (1, 0)


def test_held_out_raters(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "doc_label"))
    fit_on, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").groupBy("doc_id").avg("harmful").where("`avg(harmful)` != 0.5")
    out = harm.score_documents(docs, fit_on).join(held, "doc_id").collect()
    right = sum((r.score >= harm.THRESHOLD) == (r["avg(harmful)"] > 0.5) for r in out)
    assert right >= 0.9 * len(out)


def test_empty(spark):
    assert harm.score_documents(spark.createDataFrame([], DOC), spark.createDataFrame([], LABEL)).count() == 0
    alone = harm.score_documents(spark.createDataFrame([(1, "The lid fits.", "a", "x")], DOC), spark.createDataFrame([], LABEL)).first()
    assert alone.score < harm.THRESHOLD


def test_sentences_that_the_corpus_does_not_have(spark):
    from importlib.util import module_from_spec, spec_from_file_location
    from pathlib import Path

    spec = spec_from_file_location("held_out_sentences", Path(__file__).with_name("held_out_sentences.py"))
    held = module_from_spec(spec)
    spec.loader.exec_module(held)
    assert len(held.HARMFUL) + len(held.HARMLESS) >= 200
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "doc_label"))
    own = spark.createDataFrame([(-1 - k, t, "held") for k, t in enumerate([*held.HARMFUL, *held.HARMLESS])], "doc_id long, text string, source string")
    scored = harm.score_documents(docs.select("doc_id", "text", "source").unionByName(own), labels).where("doc_id < 0").collect()
    found = {-1 - r.doc_id for r in scored if r.score >= harm.THRESHOLD}
    right = len([k for k in found if k < len(held.HARMFUL)])
    assert right >= 0.8 * len(found) and right >= 0.8 * len(held.HARMFUL), (right, len(found), len(held.HARMFUL))
