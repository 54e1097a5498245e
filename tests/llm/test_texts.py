import random

import pytest
from hypothesis import given, settings, strategies as st

from chronoloom.llm import contamination, mixing, residue
from chronoloom.llm.texts import normal_words
from chronoloom.llm.tokens import _tokenizer, count_tokens, with_token_counts
from chronoloom.operators.staging import staged

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega one two three four five six".split()


def test_normal_words():
    assert normal_words("Ｆｕｌｌ wid­th​, Don't  STRASSE straße ﬁn_x") == ["full", "width", "don", "t", "strasse", "strasse", "fin", "x"]
    assert normal_words(None) == normal_words("") == normal_words(" .,; ") == []
    assert normal_words("été") == normal_words("ÉTÉ")


def brute_distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j - 1] + (a != b), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=90), st.text("abc ", max_size=60))
def test_bit_parallel_distance(pattern, text):
    assert contamination.least_distance(pattern, text) == brute_distance(pattern, text)


def leak_fixture():
    rng = random.Random(10)
    items = {i: " ".join(rng.choices(WORDS, k=rng.randint(8, 30))) for i in range(12)}
    items[50], items[51] = "", "short one"
    docs = {}
    for d in range(150):
        words = rng.choices(WORDS, k=rng.randint(0, 40))
        source = items[rng.randrange(12)].split()
        n = rng.choice([0, 5, 11, 12, 15])
        at = rng.randint(0, max(0, len(source) - n))
        text = words[:7] + source[at : at + n] + words[7:]
        docs[d] = rng.choice(["{}", "<<{}>>"]).format(rng.choice([" ", " - ", ",\n", "​  "]).join(w.upper() if rng.random() < 0.3 else w for w in text))
    return items, docs


def test_leaks_against_brute_force(spark):
    items, docs = leak_fixture()
    want = set()
    for d, text in docs.items():
        words = normal_words(text)
        for i, item in items.items():
            own = normal_words(item)
            windows = {tuple(own[k : k + 12]) for k in range(len(own) - 11)}
            if any(tuple(words[k : k + 12]) in windows for k in range(len(words) - 11)):
                want.add((d, i))
    documents = spark.createDataFrame([(d, t, 1, 2) for d, t in docs.items()] + [(0, docs[0], 1, 2), (None, items[0], 1, 2), (999, None, 1, 2), (998, "", 1, 2)], "doc_id BIGINT, text STRING, item_id INT, distance INT")
    table = spark.createDataFrame([(i, t, 5) for i, t in items.items()] + [(None, items[0], 5), (77, None, 5)], "item_id BIGINT, text STRING, exact INT")
    assert len(want) > 20
    for block_words in (250_000, 20):
        got = contamination.leaked_items(documents, table, block_words=block_words).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got if r["exact"]} == want and len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    assert contamination.leaked_items(documents.limit(0), table).count() == 0 and contamination.leaked_items(documents, table.limit(0)).count() == 0


def test_edits_within_the_budget(spark):
    item = " ".join(WORDS[:14])
    texts = {
        1: item.replace("delta", "delto"),
        2: item.replace("delta", "dexta").replace("kappa", "kapa"),
        3: item.replace("alpha", "xxxxx").replace("mu", "xxxxx").replace("eta theta", "q q"),
        4: "x " + item.replace("beta gamma", "betagamma") + " y",
        5: "zz" + " ".join(WORDS[1:12]) + " qq",
        6: item.replace("eta theta", "etatheta"),
    }
    documents = spark.createDataFrame(list(texts.items()), "doc_id BIGINT, text STRING")
    items = spark.createDataFrame([(9, item)], "item_id BIGINT, text STRING")
    got = {r["doc_id"]: (r["distance"], r["exact"]) for r in contamination.leaked_items(documents, items).collect()}
    assert got[1] == got[6] == (1, False)
    assert got[2] == (2, False)
    # the window that begins at "gamma" is found inside "betagamma", letter by letter but not word by word
    assert got[4] == (0, False)
    # eleven words of the window and "qq" for "nu"
    assert got[5] == (2, False)
    assert set(got) == {1, 2, 4, 5, 6}
    with pytest.raises(ValueError):
        contamination.leaked_items(documents, items, span_words=2, error_budget=2)


def test_long_texts_are_read_whole(spark):
    item = " ".join(WORDS[:12])
    long = "filler word " * 200_000 + item
    documents = spark.createDataFrame([(1, long)], "doc_id BIGINT, text STRING")
    assert contamination.leaked_items(documents, spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING")).first()["exact"]
    assert residue.residue_documents(spark.createDataFrame([(1, "filler word " * 100_000 + " Access denied.")], "doc_id BIGINT, text STRING")).count() == 1


# -- tokens and mixing


def test_tokens(spark):
    texts = ["Hello world", "", None, "<|endoftext|>", "straße Ünïcödé 漢字", "a" * 100_000]
    counts = count_tokens(texts)
    assert counts[1] == counts[2] == 0 and counts[3] > 1 and counts[5] > 1000
    tokenizer = _tokenizer("/opt/tokenizers/byte_bpe_50k.json")
    ids = tokenizer.encode(texts[4], add_special_tokens=False).ids
    assert tokenizer.decode(ids) == texts[4] and len(ids) == counts[4]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, more MAP<STRING,ARRAY<INT>>")
    assert [r["tokens"] for r in with_token_counts(df).orderBy("doc_id").collect()] == counts


def mix_fixture(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice([" Web", "web", "WEB "]), "word " * rng.randint(0, 30), rng.random()) for i in range(400)]
    rows += [(1000 + i, "small", "word word", None) for i in range(10)] + [(2000 + i, "tiny", "word", 0.9) for i in range(3)] + [(None, None, None, None), (5, "web", "again", 0.5), (3000, "unwanted", "word " * 50, 1.0)]
    documents = spark.createDataFrame(rows, "doc_id BIGINT, source STRING, text STRING, align_score DOUBLE").selectExpr("*", "1 AS tokens", "2 AS place", "3 AS rest")
    targets = spark.createDataFrame([("web", 0.2, 3), ("Small", 0.05, 90), ("tiny", 0.5, 2), ("absent", 0.1, 5), ("none", None, None)], "source STRING, target_share DOUBLE, max_repeats INT")
    return documents, targets


@pytest.mark.parametrize("ordered_rows", [100_000, 5])
def test_mixture(spark, monkeypatch, ordered_rows):
    monkeypatch.setattr(mixing, "ORDERED_ROWS", ordered_rows)
    documents, targets = mix_fixture(spark)
    records = staged(mixing.keyed_records(documents, weight=mixing.quality_weight(documents["align_score"])))
    plan = mixing.source_plan(records, targets)
    planned = {r["source"]: r for r in plan.collect()}
    assert {s for s, r in planned.items() if r["short"]} == {"tiny", "absent"}
    mixed = [tuple(r) for r in mixing.mixture(records, plan).collect()]
    own = [tuple(r) for r in records.collect()]
    for source, row in planned.items():
        size = sum(r[2] for r in own if r[1] == source.lower())
        assert row["size"] == size
        used = [m for m in mixed if m[1] == source]
        total = sum(m[2] * m[3] for m in used)
        assert all(1 <= m[3] <= row["max_repeats"] for m in used)
        if row["short"]:
            assert total == size * row["max_repeats"]
            continue
        # complete epochs, then the prefix in key order
        epochs, rest = divmod(row["budget"], size) if size else (0, 0)
        order = sorted((r[3], r[2], r[0]) for r in own if r[1] == source.lower())
        want, spent = [], 0
        for _, tokens, doc in order:
            spent += tokens
            extra = int(spent <= rest)
            if epochs + extra:
                want.append((doc, tokens, epochs + extra))
        assert sorted((m[0], m[2], m[3]) for m in used) == sorted(want)
        assert total <= row["budget"] and (not size or row["budget"] - total <= 31)
    shares = mixing.actual_shares(mixing.mixture(records, plan), plan).collect()
    assert abs(sum(r["actual_share"] for r in shares) - 1) < 1e-9 and len(shares) == 5
    assert {r["source"] for r in shares if r["short"]} == {"tiny", "absent"}


@pytest.mark.parametrize("score", [0.0, 1.0])
def test_records_of_any_weight_fill_the_budget(spark, score):
    """Every record can be drawn, the last ones in key order too."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "'s' AS source", "'word word word' AS text", f"{score}D AS align_score")
    records = staged(mixing.keyed_records(df, weight=mixing.quality_weight(df["align_score"])))
    assert records.where("place >= 1 OR place < 0").count() == 0 and records.select("place").distinct().count() == 20_000
    targets = spark.createDataFrame([("s", 0.95, 1), ("none", 0.05, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    plan = mixing.source_plan(records, targets)
    row = plan.where("source = 's'").first()
    got = mixing.mixture(records, plan).selectExpr("sum(tokens * copies)").first()[0]
    assert row["budget"] - 3 < got <= row["budget"]
    shares = {r["source"]: r["short"] for r in mixing.actual_shares(mixing.mixture(records, plan), plan).collect()}
    assert shares == {"s": False, "none": True}


def test_mixture_of_nothing(spark):
    documents, targets = mix_fixture(spark)
    records = staged(mixing.keyed_records(documents.limit(0)))
    plan = mixing.source_plan(records, targets)
    assert mixing.mixture(records, plan).count() == 0 and plan.where("short").count() == 0
    assert [r["actual_share"] for r in mixing.actual_shares(mixing.mixture(records, plan), plan).collect()] == [0.0] * 5
    assert mixing.mixture(records, mixing.source_plan(records, targets.limit(0))).count() == 0


def test_better_records_come_first_more_often(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'s' AS source", "'word' AS text", "IF(id % 2 = 0, 1.0, 0.1) AS align_score")
    order = [r["doc_id"] for r in mixing.keyed_records(df, weight=df["align_score"]).orderBy("place").limit(500).collect()]
    assert 0.8 < sum(d % 2 == 0 for d in order) / 500 < 0.99
    other = [r["doc_id"] for r in mixing.keyed_records(df, weight=df["align_score"], seed=1).orderBy("place").limit(500).collect()]
    assert order != other


# -- residue

BAD = [
    "Hello {{ first_name }}, your invoice [INVOICE NUMBER] for %(month)s is ready.",
    "Lorem ipsum dolor sit amet.",
    "HTTP 404 - page not found",
    "You need to enable JavaScript to run this app.",
    "The kettle is old. <p>Access denied.</p> The lamp is green.",
    "YOUR TEXT GOES HERE",
    "Traceback (most recent call last): File \"a.py\", line 5, in main ValueError: x",
    "Der Server ist derzeit nicht erreichbar.",
]
GOOD = [
    "She explained to the class why a page that is not found should have a friendly face.",
    "The code 404 on the door was not found by the guests until the evening.",
    "The club needs no scripts: members read the plays aloud.",
    "Write `{{ amount }}` into the title and the list shows the sum.",
    "",
    None,
]


def test_residue(spark):
    rows = list(enumerate(BAD)) + [(100 + i, t) for i, t in enumerate(GOOD)] + [(200 + i, "An ordinary sentence about lamp %d." % i) for i in range(200)] + [(0, BAD[0]), (None, BAD[0])]
    documents = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr("*", "1 AS containment", "2 AS term", "3 AS n")
    found = residue.residue_documents(documents).collect()
    assert {r["doc_id"] for r in found} == set(range(len(BAD))) and len(found) == len(BAD)
    assert all(0.7 < r["containment"] <= 1.0 + 1e-9 and 0 < r["coverage"] <= 1 for r in found)
    assert residue.without_residue(documents).count() == len(rows) - len(BAD) - 1
    assert residue.residue_documents(documents.limit(0)).count() == 0


def test_windows_against_brute_force():
    rng = random.Random(12)
    exemplars = ["a b c d", "a <any> b b e", "c d"]
    index = residue.ExemplarIndex(exemplars, 1000, {("a",): 500, ("b", "c"): 3}, containment=0.5)
    for _ in range(300):
        tokens = rng.choices("abcdexyz", k=rng.randint(1, 25))
        for i in range(3):
            size, want = index.lengths[i] + residue.SLACK, {}
            for end in range(1, len(tokens) + 1):
                begin = max(0, end - size)
                counts = {}
                for term in residue.terms_of(tokens[begin:end]):
                    counts[term] = counts.get(term, 0) + 1
                mass = sum(min(n, counts.get(t, 0)) * w for t, (n, w) in index.weights[i].items())
                if mass >= 0.5 * index.mass[i] - 1e-9:
                    want[begin, end] = mass / index.mass[i]
            got = {(a, b): c for c, a, b in index.best_window(i, tokens)}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
