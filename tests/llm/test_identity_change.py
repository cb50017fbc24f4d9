"""The column identity_change against scores of texts that are rewritten word by word, and what the penalty does to it."""

from __future__ import annotations

import math
import random

from weftline.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, identity_change string"
PLAIN = "river stone window market garden letter paper evening christmas blackberry mensch nature whitening".split()


def corpus() -> tuple[list[tuple], list[tuple]]:
    """Terms stand mostly in toxic texts, so a fit without a penalty learns them."""
    rng, rows, labels = random.Random(11), [], []
    for i in range(500):
        toxic = i % 3 == 0
        words = [rng.choice(PLAIN) for _ in range(10)] + ([rng.choice(["vilest", "foulest"])] if toxic and i % 2 else [])
        if toxic or i % 9 == 1:
            words += rng.sample(["muslim", "muslims", "jewish", "women", "gay", "white"], rng.choice([1, 1, 2]))
        rows.append((i, " ".join(words), "en", "s", 1, "x", "y"))
        labels.append((i, int(toxic)))
    return rows + [(900, None, "", "", 0, "", ""), (901, "", "", "", 0, "", ""), (902, "vilest " * 20_000, "", "", 0, "", ""), (0, rows[0][1], "", "", 0, "", "")], labels


def rewritten(text: str) -> list[str]:
    """Every text one mention away, as text."""
    words = text.lower().split()
    family = {t: f for f in toxicity.IDENTITY_TERMS for t in f}
    found = set(words) & family.keys()
    if not found:
        return [f"{text} {t}" for t in family]
    return [" ".join(new if w == old else w for w in words) for old in found for new in ("", *family[old]) if new != old]


def test_identity_change_equals_rescored_texts(spark):
    rows, labels = corpus()
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, lab, penalty=0.0, held_out_fold=None).collect()}
    weights, bias = toxicity.train(df, lab, penalty=0.0)

    def score(text: str) -> float:
        raw = bias + sum(weights.get(f, 0.0) for f in toxicity.tokens(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, raw))))

    for doc, text, *_ in rows:
        own = score(text or "")
        assert abs(got[doc].score - own) < 1e-9 and got[doc].predicted == (got[doc].score >= 0.7)
        assert abs(got[doc].identity_change - max(abs(score(t) - own) for t in rewritten(text or ""))) < 1e-9


def test_penalty_lowers_identity_change(spark):
    rows, labels = corpus()
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    mean = {}
    for penalty in (0.0, 10.0):
        scored = toxicity.toxicity(df, lab, penalty=penalty).collect()
        mean[penalty] = sum(r.identity_change for r in scored) / len(scored)
    assert mean[0.0] > 0.2 and mean[10.0] < mean[0.0] / 3
    none = toxicity.toxicity(df, lab.limit(0)).collect()
    assert len(none) == len(rows) and {r.identity_change for r in none} == {0.0}
    assert toxicity.toxicity(df.limit(0), lab).count() == 0


def test_counterfactuals_of_several_families():
    plain = {"river", "river*"}
    made = toxicity.counterfactuals(plain, 4)
    assert len(made) == 4 and all(m > plain for m in made)
    terms = [next(iter((m - plain) & toxicity._FAMILY.keys())) for m in made]
    assert len({toxicity._FAMILY[t] for t in terms}) == 4
    swapped = toxicity.counterfactuals(plain | {"gay"}, 4)
    assert swapped[-1] == plain and len(swapped) == 5
    assert {next(iter(m & toxicity._FAMILY.keys())) for m in swapped[:-1]} == {"straight", "lesbian", "bisexual", "transgender"}
    # a family of two has one swap; a prefix stays while another word has it
    assert toxicity.counterfactuals({"men"}, 4) == [{"women", "women*"}, set()]
    assert toxicity.counterfactuals({"christian", "chris*", "christmas"}, 1)[-1] == {"christmas", "chris*"}
