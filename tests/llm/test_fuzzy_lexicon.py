"""The automata against a plain edit-distance scan, and quotation against abuse."""

from __future__ import annotations

import random

from incident_analytics.llm import toxicity as t


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def plain_match(word: str, terms: list[str]) -> tuple[str, int] | None:
    near = [(d, term) for term in terms if (d := distance(word, term)) <= t.allowed_errors(term)]
    return (min(near)[1], min(near)[0]) if near else None


def bent(rng: random.Random, term: str) -> str:
    letters = list(term)
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(letters) + 1)
        kind = rng.random()
        if kind < 0.4:
            letters.insert(at, rng.choice("abcé"))
        elif letters and kind < 0.7:
            letters.pop(min(at, len(letters) - 1))
        elif letters:
            letters[min(at, len(letters) - 1)] = rng.choice("abcé")
    return "".join(letters)


def test_automata_equal_a_plain_scan():
    rng = random.Random(8)
    terms = sorted({"".join(rng.choices("abcé", k=rng.randint(2, 12))) for _ in range(120)})
    lexicon = t.FuzzyLexicon(terms)
    words = [bent(rng, rng.choice(terms)) for _ in range(1500)] + ["", "a", "zzz", "abc" * 200]
    found = [lexicon.match(w) for w in words]
    assert found == [plain_match(w, terms) for w in words]
    assert {m[1] for m in found if m} == {0, 1, 2} and None in found


def test_a_full_memo_changes_nothing(monkeypatch):
    rng = random.Random(9)
    terms = ["abcabcabc", "bcaab", "ccc"]
    words = [bent(rng, rng.choice(terms)) for _ in range(300)]
    want = [t.FuzzyLexicon(terms).match(w) for w in words]
    monkeypatch.setattr(t, "MEMO", 40)
    small = t.FuzzyLexicon(terms)
    assert [small.match(w) for w in words] == want


def test_no_terms_match_nothing():
    assert t.FuzzyLexicon([]).match("word") is None


def test_quotation_is_not_abuse():
    lexicon, lift = t.FuzzyLexicon(["grobian", "scoundrel"]), {"grobian": 2.0, "scoundrel": 3.0}
    at = {name: i for i, name in enumerate(t.FEATURES)}
    abuse, quoted, bent_, reported = t.text_features(lexicon, lift, [
        "You scoundrel, you are a Scoundrel!", 'He wrote that "a scoundrel once lived" in this town.',
        "such a scoundrl", "the word 'scoundrel' means a rogue"])
    assert abuse[at["strength"]] > 0 and abuse[at["peak"]] == 3.0 and abuse[at["quoted"]] == 0
    assert abuse[at["addressed"]] > 0 and abuse[at["dense"]] > 0
    for row in (quoted, reported):
        assert row[at["quoted"]] > 0 and row[at["strength"]] == row[at["peak"]] == row[at["exact"]] == 0
    assert bent_[at["fuzzy"]] + bent_[at["two_errors"]] > 0 and bent_[at["exact"]] == 0
