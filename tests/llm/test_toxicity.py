import random

import pytest

from roadpulse.llm import toxicity as tx
from roadpulse.llm.common import crc_part_of
from roadpulse.llm.queries import QUERIES


def distance(a, b):
    """Edits between two words; a swap of neighbours counts as one."""
    rows = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


@pytest.mark.parametrize("seed", range(6))
def test_automaton_against_distances(seed):
    draw = random.Random(seed)
    lexicon = ["".join(draw.choice("abc") for _ in range(draw.choice([2, 3, 5, 6, 9, 10]))) for _ in range(8)]
    stems = ["abca", "cc"] if seed % 2 else []
    automaton = tx.Automaton(lexicon, stems)
    for _ in range(1500):
        word = "".join(draw.choice("abcd") for _ in range(draw.randint(1, 11)))
        if draw.random() < 0.5:
            word = list(draw.choice(lexicon))
            for _ in range(draw.randint(0, 2)):
                word[draw.randrange(len(word))] = draw.choice("abcd")
            word = "".join(word)
        edits = [distance(word, w) for w in lexicon]
        if any(word != s and word.startswith(s) for s in stems):
            want = tx.STEM
        elif 0 in edits:
            want = tx.EXACT
        else:
            want = tx.NEAR if any(e <= tx.errors_allowed(w) for e, w in zip(edits, lexicon)) else 0
        assert automaton.kind(word) == want, (word, lexicon)


def kinds(*words):
    return tx.Remembered(tx.Automaton(list(words), []))


def test_windows_tell_quotation_from_abuse():
    known = kinds("idiot", "clown")
    name = dict(zip(tx.FEATURES, range(9)))
    abuse = tx.features("you are an idi0t and a clown", known)
    assert abuse[name["near"]] > 0 and abuse[name["exact"]] > 0 and abuse[name["quoted"]] == 0 and abuse[name["addressed"]] > 0 and abuse[name["dense"]] > 0
    for text in ('the judge heard "what an idiot" twice', "the judge heard “what an idiot” twice", "they said idiot", "er schrieb «idiot»"):
        assert tx.features(text, known)[name["quoted"]] > 0, text
    assert tx.features('"x" idiot "y"', known)[name["quoted"]] == 0
    assert tx.features("a kind text", known) is None and tx.features(None, known) is None and tx.features("", known) is None


def labelled(n=1200):
    draw = random.Random(1)
    rows = []
    for k in range(n):
        found = [draw.choice("on the road a red car was seen near town today by many people who drove home".split()) for _ in range(draw.randint(5, 60))]
        bad = k % 6 == 0
        if bad:
            for _ in range(draw.randint(1, 3)):
                found[draw.randrange(len(found))] = draw.choice(["grobian", "lump", "schuft" + draw.choice(["en", "ig", "isch", "erei"])])
        rows.append((f"{k} " + " ".join(found), int(bad)))
    return rows


def test_learned_lexicon_and_planted_texts(spark):
    model = tx.fit(spark.createDataFrame(labelled(), "text string, label int").repartition(3))
    assert model.words == ["grobian", "lump"] and [s[:6] for s in model.stems] == ["schuft"]
    run = tx.scorer(model)
    clean = ["the road to town", "", None, "a lamp near the road"]
    bad = ["what a grobian you are", "GROBIAN!", "such a grobain", "the schuftigkeit of it all, lump"]
    assert max(run(clean)[0]) < tx.THRESHOLD <= min(run(bad)[0])


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    made = QUERIES["op4_toxicity"](spark, d).collect()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in made if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (crc_part_of(r["doc_id"]) == 2) and r["predicted"] == (r["score"] >= tx.THRESHOLD) and 0 <= r["score"] <= 1 for r in made)
    caught = sum(p and y for p, y in held)
    assert caught / sum(p for p, _ in held) > 0.95 and caught / sum(y for _, y in held) > 0.9


def test_hard_rows(spark):
    model = tx.Model(["grobian"], [])
    rows = [(1, None, 0.5), (None, "", 0.5), (2, "grobian grobian", None), (2, "grobian grobian", None), (3, "ok " * 100_000 + "grobian", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxicity double")
    made = tx.score(df, model)
    assert made.columns == ["doc_id", "text", "toxicity", "toxicity_"] and made.count() == 5
    left = tx.reject(df, model)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {1, None}
    assert tx.reject(df.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "text string, label int")
    assert tx.fit(empty).without == 0.0
    assert tx.fit(spark.createDataFrame([("a", 1)], "text string, label int")).without == 1.0


def test_sample_is_bounded_and_repeatable(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "concat('t', id) as text")
    labels = spark.range(500).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    one = {r["text"] for r in tx.sample(docs.repartition(7), labels, "doc_id", "text", "toxic", rows=50).collect()}
    assert len(one) == 50 and one == {r["text"] for r in tx.sample(docs, labels.repartition(5), "doc_id", "text", "toxic", rows=50).collect()}


def test_a_term_of_a_rare_language_enters(spark):
    rows = labelled(6000) + [(f"{k} ein satz mit nebelkrähe {k * 7} darin", 1) for k in range(9)]
    rows += [(f"{k} ein satz mit wolken {k * 7} darin", 0) for k in range(300)]
    model = tx.fit(spark.createDataFrame(rows, "text string, label int").repartition(4))
    assert sum(y for _, y in rows) > 100 * 9
    assert tx.Automaton(model.words, model.stems).kind("nebelkrähe") in (tx.EXACT, tx.STEM)
    assert {"grobian", "lump"} <= set(model.words)


def test_near_copies_of_one_text_prove_nothing(spark):
    long = " ".join(f"wort{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120))
    rows = labelled(3000) + [(f"{long} ende{k}", 1) for k in range(60)]
    model = tx.fit(spark.createDataFrame(rows, "text string, label int").repartition(4))
    assert not any(w.startswith("wort") for w in model.words + model.stems)
    assert len({tx.sketch(t) for t, _ in rows[-60:]}) <= 3 and tx.sketch("") == tx.sketch("...")
