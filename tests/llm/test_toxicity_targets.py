"""A target aims threats and insults of its clause from either side; every transducer decides held-out documents."""

import random
import zlib

import pytest

from quantloom.llm import toxicity


def clause(text):
    return toxicity.ClauseAutomaton(toxicity.Grammar()).clause(text)


def test_target_after_the_word():
    for text in ("I will kill you", "hurt them", "beat him", "you I will kill"):
        paid, matched = clause(text)
        assert matched == 1 and paid == toxicity.SEED_WEIGHT
    assert clause("idiot, you") == clause("you idiot") == (3.0 * toxicity.AIMED, 1)
    assert clause("kill and hurt you")[1] == 2


def test_what_is_in_force_where_the_word_stands():
    bare = toxicity.SEED_WEIGHT * toxicity.BARE_THREAT
    assert clause("never kill you")[1] == 0 and clause("never kill you")[0] < bare
    assert clause("not idiot, you")[0] == pytest.approx(3.0 * toxicity.NEGATED * toxicity.AIMED)
    assert clause("not really such an idiot")[0] == 3.0  # out of the negation's reach
    assert clause("quoted kill you")[0] < clause("kill you")[0]
    assert clause("kill the lights") == (pytest.approx(bare), 0)


def test_composition_is_the_product_of_the_transducers():
    whole = toxicity.compose(toxicity.TRANSDUCERS)
    assert 28 < len(whole.step) <= 2 * (toxicity.NEGATION_REACH + 1) * (toxicity.REPORT_REACH + 1)  # those that can be reached
    assert whole.marks == {"insult", "threat"}
    part = toxicity.compose({n: t for n, t in toxicity.TRANSDUCERS.items() if n not in ("negation", "report", "threat")})
    assert len(part.step) == 2 and part.marks == {"insult"} and not any(part.tags)


def test_each_transducer_changes_held_out_predictions(spark):
    """Labels that only the whole grammar explains: negated, reported and unaimed words are clean."""
    rng = random.Random(2)
    filler = [f"word{a}" for a in "abcdefghijklmnopqrstuvwxyz"]
    filler = [a[:4] + b[4:] * 3 for a in filler for b in filler]
    toxic = ("you are an idiot", "you moron", "i will kill you", "they will stab him")
    clean = ("you are not an idiot", "never a moron you", "she said you are an idiot", "he wrote you moron", "kill the lights", "stab the bread", "the idiot in a play", "moron was a term", "they will eat", "i will kill time", "you are an owl", "stab a map, an idiot proof one")
    rows, labels = [], []
    for i in range(1600):
        bad = i % 3 == 0
        text = " ".join(rng.choices(filler, k=6)) + ". " + rng.choice(toxic if bad else clean) + ". " + " ".join(rng.choices(filler, k=6))
        rows.append((i, text))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")

    def predictions(without=()):
        out = toxicity.toxicity(docs, marks, without=without).where("held_out").collect()
        return {r["doc_id"]: r["predicted"] for r in out}

    whole = predictions()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) for i in whole) and len(whole) > 300
    right = sum(dict(labels)[i] == p for i, p in whole.items()) / len(whole)
    assert right > 0.97
    for name in toxicity.TRANSDUCERS:
        assert predictions((name,)) != whole, name


def test_odd_rows(spark):
    """Repeated and very long rows, nulls, clashing columns, no labels."""
    rows = [(1, "you idiot", "x", 0.5), (1, "you idiot", "y", None), (2, None, "x", 1.0), (None, "", None, 1.0), (3, "a fine day. " * 60_000, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    out = sorted(((r["doc_id"] or 0, r["predicted"]) for r in toxicity.toxicity(docs, none).collect()))
    assert out == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 0)]
    left = toxicity.drop_toxic(docs, none)
    assert left.columns == docs.columns and left.count() == 3
    assert toxicity.toxicity(docs.limit(0), none).count() == 0
