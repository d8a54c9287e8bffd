import random

import pytest

from roadpulse.llm import decontamination as de
from roadpulse.llm.common import from_varint, varint, words


def brute(docs, items, size=de.WINDOW):
    out = []
    for _, text in docs:
        found = words(text)
        hit, named = set(), set()
        for item, t in items:
            own = words(t)
            for w in [own[i : i + size] for i in range(max(1, len(own) - size + 1))] if own else []:
                for i in range(len(found) - len(w) + 1):
                    if found[i : i + len(w)] == w:
                        hit.update(range(i, i + len(w)))
                        named |= {str(item)} - {"None"}
        out.append((len(found), len(hit), sorted(named)))
    return out


def texts(seed, n, longest=60):
    draw = random.Random(seed)
    return [" ".join(draw.choice("a b c D e-f g.h Ünï x1".split()) for _ in range(draw.randint(0, longest))) for _ in range(n)]


def test_varint():
    numbers = de.np.array([0, 1, 127, 128, 300, 16_383, 16_384, 2**31, 2**40])
    data, ends = varint(numbers)
    assert from_varint(data.tobytes()).tolist() == numbers.tolist() and ends[-1] == len(data)
    assert len(varint(numbers[:0])[0]) == 0 and len(from_varint(b"")) == 0


@pytest.mark.parametrize("seed,size,block,chunk", [(1, 4, 2_000_000, 20_000), (2, 3, 50, 20_000), (3, 3, 200, 7), (4, 10, 1, 3)])
def test_against_brute_force(spark, monkeypatch, seed, size, block, chunk):
    monkeypatch.setattr(de, "BLOCK_WORDS", block)
    monkeypatch.setattr(de, "CHUNK_WINDOWS", chunk)
    docs = [(k, t) for k, t in enumerate(texts(seed, 60))] + [(60, None), (61, ""), (0, "a b c D"), (None, "g h g h Ünï a")]
    items = [(k, t) for k, t in enumerate(texts(seed + 9, 6, 14))] + [(90, None), (91, "..."), (92, "c"), (92, "c")]
    made = de.contamination(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), size=size
    ).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in made)
    assert got == sorted((str(d[0]), *b) for d, b in zip(docs, brute(docs, items, size)))


@pytest.mark.parametrize("ids", [["a"], [None], ["a", None, "b"]])
def test_items_that_share_an_id(spark, ids):
    """Items of 1 to 30 words under few ids, or none: every one is looked for by its own windows."""
    draw = random.Random(7)
    items = [(ids[k % len(ids)], " ".join(f"w{draw.randint(0, 400)}" for _ in range(k))) for k in range(1, 31)]
    docs = [(k, f"x{k} {t} y{k}") for k, (_, t) in enumerate(items)] + [(100 + k, f"{t} and {u}") for k, ((_, t), (_, u)) in enumerate(zip(items, items[3:]))]
    docs += [(200, "nothing"), (201, items[2][1]), (202, " ".join(items[20][1].split()[:9]))]
    made = de.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id string, text string"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in made.collect()}
    want = dict(zip((d for d, _ in docs), brute(docs, items)))
    assert got == want and want[201][1] == 3 and sum(w[1] > 0 for w in want.values()) >= 57
    kept = de.reject(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if w[1] == 0}


def test_one_item_without_an_id(spark):
    docs = spark.createDataFrame([(1, "say x y z now")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "x y z")], "item_id string, text string")
    assert [tuple(r) for r in de.contamination(docs, items).collect()] == [(1, 5, 3, [])]


def test_positions_and_ids_of_matches(spark):
    docs = spark.createDataFrame([("x", "zero One two, three four one two three")], "key string, body string")
    items = spark.createDataFrame([("i", "one two three")], "name string, words string")
    made = de.matches(docs, items, "key", "body", "name", "words", size=3).collect()
    assert sorted((r["key"], r["item"], r["first"], r["last"]) for r in made) == [("x", "i", 1, 4), ("x", "i", 5, 8)]


def near_brute(found, terms, span):
    out = set()
    for a in range(len(found)):
        for b in range(a + 1, min(len(found), a + span) + 1):
            if set(terms) <= set(found[a:b]):
                out.add((a, b))
                break
    return {(a, b) for a, b in out if not any(c > a and d <= b for c, d in out)}


@pytest.mark.parametrize("seed", range(5))
def test_proximity(spark, seed):
    docs = [(k, t) for k, t in enumerate(texts(seed, 20))]
    items = [(1, "a c x1"), (2, "D g Ünï e"), (3, "a a")]
    made = de.matches(
        spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"), size=10, slop=2
    )
    got = {(r["doc_id"], r["item"], r["first"], r["last"]) for r in made.collect()}
    want = {(k, str(i), a, b) for k, t in docs for i, own in items for a, b in near_brute(words(t), words(own), len(words(own)) + 2)}
    assert got == want


def test_reject_keeps_columns_and_clean_rows(spark):
    schema = "DOC_ID long, doc_id2 long, text string, item string, block int, term binary"
    rows = [(1, 1, "x one two three y", "q", 1, None), (None, 2, None, None, None, None), (3, 3, "one two", "r", 2, b"t"), (3, 3, "one two", "r", 2, b"t"), (4, 4, "", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    left = de.reject(docs, items, "DOC_ID", size=3)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id2"]) for r in left.collect()) == ["2", "3", "3", "4"]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert de.contamination(docs, items).count() == 0
    assert [tuple(r) for r in de.contamination(one, items).collect()] == [(1, 2, 0, [])]
    assert de.reject(docs, items).count() == 0


def test_packing_a_block_takes_few_bytes_a_word():
    import tracemalloc

    from roadpulse.llm.decontamination import _Block

    block = _Block()
    for k in range(200):
        block.add(k, [b"w%d" % (i * i % 3001) for i in range(1000)])
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        block.packed()
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert peak < 70 * 200_000
