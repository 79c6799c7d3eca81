import random

import pytest

from tessella.llm.truncation import OPEN, UNSURE, WHOLE, ending, truncated, truncation_rates

D = "doc_id long, source string, n_chars long, text string, verdict string"
WORDS = "gate span lease shard tour reader index token query field limit parser record writer judge".split()


@pytest.mark.parametrize("text, verdict", [
    ("It ends here.", WHOLE), ("and so on...", WHOLE), ("これで終わりです。", WHOLE), ("It ends he…", OPEN), ("it was [...]", OPEN), ("half \ufffd", OPEN),
    ('{"a": 1}', WHOLE), ('{"a": "b', OPEN), ("x\n```py\ncode", OPEN), ("x\n```\ncode\n```", WHOLE), ("| a | b |\n| 1 | 2 |", WHOLE), ("| a | b |\n| 1", OPEN),
    ("See `na", OPEN), ("read store/handler_x.", OPEN), ("read store/handler.py.", WHOLE), ("12:00:01 INFO done", UNSURE), ("a subject line", UNSURE), ("One. Then ano", UNSURE),
])
def test_endings(text, verdict):
    assert ending(text)[0] == verdict


def corpus():
    rnd = random.Random(4)
    sentence = lambda: (" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(4, 9))) + ".").capitalize()
    data, cut = [], set()
    for i in range(400):
        text = " ".join(sentence() for _ in range(rnd.randint(1, 12)))
        if len(text) > 300:
            text = text[:300]
            if not text.rstrip().endswith("."):
                cut.add(i)
        data.append((i, "notes", len(text), text, "x"))
    for i in range(400, 600):
        data.append((i, "subjects", None, " ".join(rnd.choice(WORDS) for _ in range(4)), "x"))
    data += [(700, "notes", 0, "", "x"), (701, "notes", None, None, "x"), (702, None, 3, " \u3000\n", "x"), (703, None, 9, "Whole text.", "x"), (703, None, 9, "Whole text.", "x"), (704, "subjects", None, "gate span le", "x")]
    return data, cut | {704}


def test_planted_cuts(rows):
    data, cut = corpus()
    docs = rows(D, *data)
    assert {r.doc_id for r in truncated(docs).collect()} == cut
    rates = {r.source: r for r in truncation_rates(docs).collect()}
    assert "300 chars" in rates["notes"].limits and rates[None].n_texts == 1 and rates["subjects"].n_truncated == 1


def test_empty(rows):
    assert truncated(rows(D)).count() == 0 and truncation_rates(rows(D)).count() == 0


def test_censoring_posteriors_teach_what_endings_are_worth(rows, monkeypatch):
    """Without the fitted limits nothing is learned, and texts are lost."""
    from tessella.llm import truncation

    data, cut = corpus()
    docs = rows(D, *data)
    found = {r.doc_id for r in truncated(docs).collect()}
    fit = truncation.length_limits
    monkeypatch.setattr(truncation, "length_limits", lambda d: fit(d).filter("false"))
    without = {r.doc_id for r in truncated(docs).collect()}
    assert found == cut and len(without & cut) < len(cut) * 0.8


def test_short_limits_are_limits_too(rows):
    """A limit of 20 characters, with natural lengths around it."""
    rnd = random.Random(9)
    data = []
    for i in range(900):
        text = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 9)))
        data.append((i, "names", None, text[:20], "x"))
    limits = {(r.unit, r.length): r.posterior for r in truncation_limits(rows(D, *data)).collect()}
    assert limits["chars", 20] > 0.9


def truncation_limits(docs):
    from pyspark.sql import functions as F

    from tessella.llm.truncation import length_limits

    return length_limits(docs.select("source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("digest")))


def test_fitted_evidence_of_nothing_and_of_limits():
    import numpy as np
    import pandas as pd

    from tessella.llm.truncation import FACTORS, START, fitted_evidence

    none = pd.DataFrame({**{f: pd.Series(dtype=object) for f in FACTORS}, "p": pd.Series(dtype=float), "n": pd.Series(dtype=float)})
    assert fitted_evidence(none).odds["kind"] == {}
    cells = pd.DataFrame(
        [("no habit: prose", "known", "goes on", "as long", 0.99, 300), ("habit: prose", "known", "goes on", "as long", 0.99, 3), ("habit: prose", "known", "goes on", "as long", np.nan, 5000), ("no habit: prose", "known", "goes on", "as long", np.nan, 40), ("no habit: list", None, "goes on", "as long", np.nan, 9)],
        columns=[*FACTORS, "p", "n"],
    )
    model = fitted_evidence(cells)
    assert model.odds["kind"]["no habit: prose"] > 4 > START["no habit"] and abs(model.odds["kind"]["no habit: list"] - model.odds["kind"]["no habit: prose"]) < 1.5


def test_open_endings_keep_their_worth_in_large_tables():
    """Many limits elsewhere say nothing about unclosed code in a source that has few."""
    import math

    import numpy as np
    import pandas as pd

    from tessella.llm.truncation import FACTORS, fitted_evidence

    cells = pd.DataFrame(
        [("open: code", None, None, "as long", np.nan, 18_100, "code"), ("open: code", None, None, "as long", 0.99, 2_200, "code"), ("habit: code", "known", "goes on", "as long", np.nan, 736_300, "code"),
         ("no habit: prose", "known", "goes on", "as long", 0.99, 400_000, "notes"), ("no habit: prose", "known", "goes on", "as long", np.nan, 110_000, "notes"), ("habit: trailer", "known", "goes on", "as long", np.nan, 2_600_000, "notes")],
        columns=[*FACTORS, "p", "n", "stratum"],
    )
    model = fitted_evidence(cells)
    assert math.log(model.base / (1 - model.base)) + model.odds["told"]["as long"] + model.odds["kind"]["open: code"] > 0


def test_words_and_frames_that_cuts_end_are_no_habits(rows):
    """So many cut claims that each half word ends several of them."""
    rnd = random.Random(5)
    words = [*WORDS, "the", "the", "the", "which", "when", "store"]
    claim = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(6, 14))) + " store"
    data, cut = [], set()
    for i in range(4000):
        text = f"kind: x{i}.\nclaim: {claim()}."
        if i % 10 == 0:
            text = text[: rnd.randint(text.index("claim:") + 30, len(text) - 8)]
            if text.split()[-1] not in words:  # whole words may end a claim
                cut.add(i)
        data.append((i, "claims", len(text), text, "x"))
    found = {r.doc_id for r in truncated(rows(D, *data)).collect()}
    assert len(found & cut) > 0.97 * len(cut) and found <= set(range(0, 4000, 10))
