"""Held-out accuracy of the residue classifier, on hosts and on families of phrases it was not told of, and its defined cases."""

import random

import pytest

from claimloom.llm.residue import best_threshold, phrases, positions, repeats, residue, residue_scores, starts

A = "work_id string, abstract_text string, abstract_is_placeholder int, score int"
W = "work_id string, display_name string, source_id string, host string"
NOUNS = ["credit rationing", "wage dispersion", "market entry", "export survival", "price rigidity", "water scarcity"]
#: Kinds of residue with the family of phrases that names them; None: no phrase does.
KINDS = {
    "access": "Please enable JavaScript in your browser to read article {}.",
    "marker": "{{{{ record.field_{} }}}}",
    "error": "Error 502 - Page not found (request {}).",
    "filler": "Lorem ipsum dolor sit amet consectetur elit sed do eiusmod {}",
    None: "Bot check in progress, hold on while we look at your connection ({}).",
}
REAL = ["We study how {} responds to {} in {} towns.", "Taken together, {} explains {} per cent of {}.", "The response of {} to {} was muted ({}).", "Portals that require JavaScript reduce {} and {} by {}.", "Errors in 404 records of {} and {} are rare ({})."]


def real(rng):
    return " ".join(rng.choice(REAL).format(rng.choice(NOUNS), rng.choice(NOUNS), rng.randint(2, 90)) for _ in range(rng.randint(1, 5)))


def tables(spark, n=1500):
    """Every fifth text is residue, alone or inside real text; the status flags half of the cases and one real text in fifty."""
    rng = random.Random(6)
    rows, works, want = [], [], {}
    for i in range(n):
        w = f"W{i}"
        works.append((w, f"{rng.choice(NOUNS)} and {rng.choice(NOUNS)}", f"S{i % 17}", "h"))
        text, flag = real(rng), rng.random() < 0.02
        if i % 5 == 0:
            kind = rng.choice(list(KINDS))
            r = KINDS[kind].format(rng.randint(100, 999))
            text, flag = (r if rng.random() < 0.6 else f"{text} {r} {real(rng)}"), rng.random() < 0.5
            want[w] = kind
        rows.append((w, text, int(flag) if rng.random() < 0.9 or flag else None, 1))
    rows += [("E1", None, 1, 1), ("E2", "  ", 1, 1), (None, "N/A", 0, 1), ("W1", rows[1][1], 0, 1)]
    return spark.createDataFrame(rows, A), spark.createDataFrame(works, W), want


@pytest.fixture(scope="module")
def data(spark):
    return tables(spark)


def test_accuracy_beyond_the_phrases_and_on_unseen_hosts(data):
    a, w, want = data
    scored, report = residue_scores(a, w)
    rows = [r for r in scored.collect() if r["work_id"]]
    got = {r["work_id"] for r in rows if r["is_case"]}
    assert len(got & want.keys()) >= 0.95 * len(want) and len(got & want.keys()) >= 0.95 * len(got)
    assert report["precision"] >= 0.85 and report["recall"] >= 0.85
    beyond = {r["work_id"] for r in rows if not r["seeded"] and r["unseen"]} & {k for k, v in want.items() if v is None}
    assert len(beyond) >= 5 and len(beyond & got) >= 0.9 * len(beyond)  # no phrase names these, no host of theirs taught
    assert not got & {"E1", "E2"}


@pytest.mark.parametrize("family", ["access", "error"])
def test_withheld_family_of_phrases(data, family):
    a, w, want = data
    scored, _ = residue_scores(a, w, without=frozenset([family]))
    rows = [r for r in scored.collect() if r["work_id"]]
    held = [r for r in rows if r["withheld"] and want.get(r["work_id"]) == family]
    assert len(held) >= 20 and not any(r["seeded"] for r in held)
    assert sum(r["is_case"] for r in held) >= 0.9 * len(held)
    unseen = [r for r in held if r["unseen"]]
    assert sum(r["is_case"] for r in unseen) >= 0.8 * len(unseen)


def test_empty_tables(spark, data):
    a, w, _ = data
    assert residue(a.limit(0), w).count() == 0 and residue(a.limit(0), w.limit(0)).count() == 0


def test_windows_and_phrases():
    for n in (0, 5, 64, 65, 1000):
        s = starts(n)
        assert s[0] == 0 and s[-1] + 64 >= n
    assert positions("aB1 é").shape == (5, 5)
    assert phrases("Errors in 404 records.") == [] and phrases("A real text. " * 30 + "none none none") == []
    assert phrases("x {{ title }} y") == [(2, 13)] and phrases(" N/A ") == [(0, 5)]
    assert repeats("none none. none") and repeats("a b c " * 3) and not repeats("a b c a b c a b d")


def test_threshold_without_use_of_the_flag():
    import pandas as pd

    hist = pd.DataFrame({"k": [-40, 0, 40], "n": [90, 5, 5], "flagged": [9, 1, 0], "seeded": [0, 0, 5], "both": [0, 0, 1]})
    t, p, r = best_threshold(hist, 0.05)
    assert 0 <= t <= 2 and p > 0.4 and r == 1


def test_texts_are_scored_without_real_text_to_learn_from(spark):
    cases = spark.createDataFrame([("W1", "Please enable JavaScript to view the full content of this page.", 0, 1), ("W2", "Error 502 - Page not found.", 0, 1)], A)
    works = spark.createDataFrame([("W1", "wage dispersion", "S1", "h"), ("W2", "market entry", "S2", "h")], W)
    assert {r["work_id"] for r in residue(cases, works).collect()} == {"W1", "W2"}
    scored, report = residue_scores(cases, works)
    assert scored.count() == 2 and report["precision"] is None
