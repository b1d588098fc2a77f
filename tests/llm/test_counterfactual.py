"""Counterfactuals through train() and scored()."""

import random

import numpy as np

from tessellate.llm import toxicity


def test_terms_are_swapped_before_beginnings():
    found = toxicity.named("A Muslim spoke")
    assert toxicity.words("a christian spoke") in [toxicity.with_beginnings(x) for x in toxicity.swaps(found)]
    assert len(toxicity.swaps(found)) == 5 and toxicity.swaps({"spoke"}) == []
    assert [x - {"spoke"} for x in toxicity.mentions({"spoke"}, 1)] == [{g[1 % len(g)]} for g in toxicity.IDENTITIES]


def biased(seed, n):
    """Insults make a text toxic; toxic ones name a group far more often."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        text = [f"word{rng.randrange(30)}" for _ in range(8)]
        if y and rng.random() < 0.95:
            text.append(rng.choice(["idiot", "scum"]))
        if rng.random() < (0.8 if y else 0.03):
            text.append(rng.choice(["muslim", "muslims"]))
        out.append((i, " ".join(text), y))
    return out


def scores(spark, model, texts):
    rows = toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    return np.array([r.score for r in sorted(rows)])


def test_a_neutral_mention_moves_no_score(spark):
    sample = spark.createDataFrame(biased(1, 800), "doc_id long, text string, y int")
    plain = [f"word{i % 30} word{i % 7} here" for i in range(60)]
    named = [f"{t} muslim" for t in plain]
    others = [f"{t} christian" for t in plain]
    free, tied = toxicity.train(sample, penalty=0), toxicity.train(sample)
    assert tied["pairs"]["swaps"] > 0 and tied["pairs"]["mentions"] > 0
    logit = lambda p: np.log(p / (1 - p))
    for model, most in ((tied, 0.5),):
        base, one, two = (logit(scores(spark, model, x)) for x in (plain, named, others))
        assert abs(one - two).max() < most and abs(one - base).max() < most
    wrong = [(scores(spark, m, named) >= 0.7).sum() for m in (free, tied)]
    assert wrong[1] < wrong[0] and wrong[1] <= 2
    insults = [f"{t} idiot" for t in plain]
    assert (scores(spark, tied, insults) >= 0.7).mean() > 0.9


def test_texts_without_terms_give_mentions(spark):
    rows = [(i, f"word{i % 5} {'idiot' if i % 3 == 0 else 'tree'}", int(i % 3 == 0)) for i in range(120)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    assert model["pairs"] == {"swaps": 0, "mentions": 120 * len(toxicity.IDENTITIES)}


def test_scores_equal_a_sum_by_hand(spark):
    rows = biased(2, 300)
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    weight = {w: model["w"][i] for w, i in model["vocabulary"].items()}
    texts = [t for _, t, _ in rows[:50]] + ["", "  \n", "MUSLIM idiots!"]
    by_hand = [1 / (1 + np.exp(-(model["b"] + sum(weight.get(w, 0) for w in toxicity.words(t))))) for t in texts]
    assert np.allclose(scores(spark, model, texts), by_hand)
