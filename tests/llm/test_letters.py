import random

import pytest
from hypothesis import given, settings, strategies as st

from chronoloom.llm import contamination
from chronoloom.llm.texts import normal_words


def brute_distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j - 1] + (a != b), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["ab", "cd", "abc", "d", "xyz", "q"]), min_size=5, max_size=14), st.integers(0, 10**6))
def test_no_text_within_the_budget_is_missed(words, seed):
    """Against the distance of every window to the whole text."""
    rng = random.Random(seed)
    text = list(" ".join(words))
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(text) + 1)
        text[at : at + rng.choice([0, 1])] = rng.choice(["", "a", " ", "zz"])
    document = normal_words("q " * rng.randint(0, 2) + "".join(text))
    span, budget = rng.choice([(5, 1), (6, 2), (4, 0), (3, 2)])
    found = list(contamination.LetterIndex([(1, words)], span, budget).matches(document))
    windows = [words[i : i + span] for i in range(len(words) - span + 1)]
    want = min((brute_distance(" ".join(w), " ".join(document)) for w in windows), default=budget + 1)
    exact = any(document[i : i + span] in windows for i in range(len(document) - span + 1))
    assert found == ([(1, want, exact)] if want <= budget else [])


def test_joined_words_in_a_leaked_passage(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda omega"
    texts = [(1, item.replace("delta epsilon", "deltaepsilon").replace("kappa", "kapxa")), (2, "x" + item + "y"), (3, item.replace("delta epsilon", "deltaepsilon").replace("kappa", "xxxpa"))]
    documents = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    got = contamination.leaked_items(documents, spark.createDataFrame([(9, item)], "item_id BIGINT, text STRING")).collect()
    assert {(r["doc_id"], r["distance"], r["exact"]) for r in got} == {(1, 2, False), (2, 0, False)}


@pytest.mark.parametrize("kind", ["letters", "blank and letter", "blanks", "inserted"])
def test_recall_of_each_kind_of_edit(kind):
    """Every text within two edits of a window is found, whatever is edited."""
    rng = random.Random(14)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 8))) for _ in range(300)]
    items = [(i, rng.choices(vocabulary, k=12)) for i in range(60)]
    index = contamination.LetterIndex(items, 12, 2)
    for key, words in items:
        for _ in range(8):
            text = list(" ".join(words))
            for edit in {"letters": "rr", "blank and letter": "br", "blanks": "bb", "inserted": "ii"}[kind]:
                if edit == "b":
                    del text[rng.choice([i for i, c in enumerate(text) if c == " "])]
                elif edit == "r":
                    text[rng.choice([i for i, c in enumerate(text) if c != " "])] = "z"
                else:
                    text.insert(rng.randrange(1, len(text)), "y")
            found = {k: d for k, d, _ in index.matches(rng.choices(vocabulary, k=5) + normal_words("".join(text)) + rng.choices(vocabulary, k=5))}
            assert 0 <= found[key] <= 2
