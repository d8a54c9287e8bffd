import base64
import unicodedata

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from roadpulse.llm import byte_bpe


@pytest.fixture(scope="module")
def real():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    encode = byte_bpe.encoder(byte_bpe.VOCABULARY, byte_bpe.PATTERN)
    return lambda text: byte_bpe.np.frombuffer(encode([text])[0][0], "<u4").tolist()


def test_hash_is_minimal_and_perfect():
    vocabulary = byte_bpe.vocabulary()
    keys = list(vocabulary.ranks)
    assert sorted(vocabulary.whole.find(k) for k in keys) == list(range(len(keys)))
    assert None not in vocabulary.whole.keys and len(vocabulary.whole.keys) == len(keys)
    assert vocabulary.whole.find(b"\x00no such entry\x00") == -1


@pytest.mark.parametrize("keys", [[b"a"], [b"a", b"b"], [b"%d" % i for i in range(999)]])
def test_small_hashes(keys):
    table = byte_bpe.PerfectHash(keys)
    assert [table.find(k) for k in keys] == list(range(len(keys)))


def test_every_code_point(own, real):
    """All that Unicode 15.1 assigns; the classes of later characters depend on the version each library knows."""
    points = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    for start in range(0, len(points), 4096):
        text = "a".join(points[start : start + 4096])
        assert own(text) == real.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"])))
def test_any_text(text):
    ranks = byte_bpe.vocabulary().ranks
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = byte_bpe.encoder(byte_bpe.VOCABULARY, byte_bpe.PATTERN)([text])[0][0]
    assert byte_bpe.np.frombuffer(ids, "<u4").tolist() == real.encode_ordinary(text)
    assert byte_bpe.vocabulary().decode(ids) == text.encode()


def test_generations(monkeypatch, real):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    ids = byte_bpe.Remembered(byte_bpe.vocabulary())
    for token in " thereou antly blestou thereou ouneha antly thereou".split(" ") * 3:
        assert byte_bpe.np.frombuffer(ids[token], "<u4").tolist() == real.encode_ordinary(token)
        assert len(ids) <= 3 and len(ids.old) <= 3


def test_rows(spark, real):
    schema = T.StructType(
        [T.StructField("ids", T.StringType()), T.StructField("text", T.StringType()), T.StructField("decoded", T.IntegerType())]
    )
    long = "x" * 200_000 + " " * 5000 + "Déjà vu 123"
    rows = [("a", None, None), ("b", "", 1), ("c", "It's <|endoftext|>\n\n ok", 2), ("c", "It's <|endoftext|>\n\n ok", 2), (None, long, 3)]
    df = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame(rows, schema)), "ids_")
    assert df.columns == ["ids", "text", "decoded", "ids_", "decoded_"]
    got = df.collect()
    assert len(got) == 5
    for row in got:
        assert byte_bpe.np.frombuffer(bytes(row["ids_"]), "<u4").tolist() == real.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded_"]).decode() == (row["text"] or "")
    assert byte_bpe.encode(spark.createDataFrame([], schema)).count() == 0


def test_query(spark, sf, real):
    import hashlib

    from roadpulse.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op7_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = real.encode_ordinary(texts[row["doc_id"]] or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(byte_bpe.np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((texts[row["doc_id"]] or "").encode()).hexdigest()
