"""Held-out accuracy, and odd inputs."""

import random

import numpy as np

from broadsheet.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _f string"


def corpus(n=900):
    dice = random.Random(6)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(dice.randrange(2, 8)))
    rows = []
    for i in range(n):
        good = i % 5 > 0
        if good:
            text = "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(dice.randrange(3, 9)))
        else:
            text = [" ".join(word().upper() + "!!" for _ in range(60)), " ".join([word()] * 80), " | ".join(word() for _ in range(50)), " ".join(word() + "%%%" for _ in range(70))][i // 5 % 4]
        rows.append((i, text, dice.choice(["en", "de", None]), f"s{dice.randrange(4)}", len(text), "clash"))
    return rows


def test_held_out_accuracy_and_kept_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).drop("_f")
    known = [(i, int(i % 5 > 0)) for i, *_ in rows if i % 3 == 0]
    labels = spark.createDataFrame([*known, (None, 1), (3, None), (10**9, 0)], "doc_id long, quality int")
    model, table = quality.train(docs, labels, rounds=2, grow=(40, 10))
    assert table.count() == len(rows)
    scores = {r.doc_id: r._scores for r in quality.score(docs, model).collect()}
    unseen = [i for i in scores if i % 3]
    right = np.mean([(scores[i].quality >= 0.5) == (i % 5 > 0) for i in unseen])
    kept = np.mean([scores[i].quality >= 0.5 for i in unseen if i % 5 > 0])
    assert right > 0.97 and kept > 0.98
    stay = quality.keep_good(docs, labels, rounds=1, grow=(40, 10))
    assert stay.columns == docs.columns and 0.7 * len(rows) < stay.count() < 0.9 * len(rows)


def test_nulls_one_class_and_no_labels(spark):
    rows = [(1, None, None, None, None, ""), (2, "", "en", "s", -5, ""), (2, "x" * 200_000, "en", "s", 3, ""), (None, "text", "en", "s", 4, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model, _ = quality.train(docs, none)
    assert [r._scores.quality for r in quality.score(docs, model).collect()] == [0.5] * 4
    model, _ = quality.train(docs, spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, quality int"), rounds=1)
    assert all(0 <= r._scores.quality <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(docs.limit(0), model).count() == 0
    model, table = quality.train(docs.limit(0), none)
    assert table.count() == 0


def test_rounds_do_not_hurt_and_a_view_without_skill_counts_little(spark):
    rows = [(*r[:3], f"s{r[0] % 4}", r[4], "") for r in corpus(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i, *_ in rows if i % 3 == 0], "doc_id long, quality int")
    losses = []
    for rounds in (0, 2):
        model, _ = quality.train(docs, labels, rounds=rounds, grow=(40, 10))
        seen = [(r.doc_id % 5 > 0, r._scores.quality) for r in quality.score(docs, model).collect() if r.doc_id % 3]
        losses.append(np.mean([-np.log(max(p if good else 1 - p, 1e-6)) for good, p in seen]))
        assert model.skills[0] == 1 and model.rounds <= rounds
    assert losses[1] <= losses[0] + 0.02


def test_both_views_hand_over_documents(spark):
    """Length tells of quality here, so that either view can teach the other."""
    dice, rows = random.Random(3), []
    for i, text, lang, source, size, clash in corpus(800):
        good = i % 5 > 0
        rows.append((i, text, lang, source, dice.randrange(2_000, 4_000) if good == (dice.random() < 0.95) else dice.randrange(50, 300), clash))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i, *_ in rows if i % 3 == 0], "doc_id long, quality int")
    fitted = [quality.train(docs, labels, rounds=n, grow=(40, 10))[0] for n in (0, 1, 2)]
    assert fitted[0].rounds == 0 and fitted[0].handed == {"content": 0, "metadata": 0}
    for model in fitted[1:]:
        if model.rounds:
            assert min(model.handed.values()) > 0
    seen = {r.doc_id: r._scores for r in quality.score(docs, fitted[2]).collect()}
    loss = lambda view: np.mean([-np.log(max(s[view] if i % 5 > 0 else 1 - s[view], 1e-6)) for i, s in seen.items() if i % 3])
    assert loss("quality") <= min(loss("content"), loss("metadata")) + 0.02
