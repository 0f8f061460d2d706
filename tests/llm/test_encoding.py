import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")

from millrace.llm import encoding

HARD = ["", "a", "don't", "it'll we've I'd", "  lead", "tail  ", "a\n\n\n b", "x" * 9000, " " * 5000, "漢字かな混じり文" * 600, "é" * 3000, "🙂👩‍👩‍👧" * 500, "<|endoftext|>", "ab1!" * 2500, "a'l" + "l" * 50, "​́\x00\t", "\r\n" * 3000]


def test_leaves_of_any_size_give_the_plain_ids():
    path, pattern = encoding.default_vocabulary()
    r = random.Random(3)
    alphabet = ["a", "Z", " ", "  ", "'", "'ll", "'s", "\n", "1", "é", "漢", "!", "​", "🙂", "\t", "l", "v", "e"]
    for leaf, window in ((1, 1), (2, 3), (7, 2), (64, 16), (4096, 256)):
        tree = encoding.TreeEncoder(path, pattern, leaf, window)
        for _ in range(250):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 70)))
            ids = tree.encode(text)
            assert ids.tolist() == tree.encoding.encode_ordinary(text), (leaf, text)
            assert tree.decode(ids) == text


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    tree = encoding.encoder(leaf_chars=500)
    assert tree.encode(text).tolist() == tree.encoding.encode_ordinary(text)
    assert tree.decode(tree.encode(text)) == text


def test_same_ids_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    tree = encoding.encoder(leaf_chars=300)
    for text in HARD:
        assert tree.encode(text).tolist() == other.encode(text, add_special_tokens=False).ids


def test_documents(spark, sf_dir):
    docs = spark.createDataFrame([(k, t, "ids") for k, t in enumerate([*HARD, None])] + [(None, "twice", "x"), (1, "a", "x")], "doc_id long, text string, ids string")
    encoded = encoding.encode_documents(docs, leaf_chars=700)
    rows = encoded.collect()
    assert len(rows) == len(HARD) + 3 and encoded.columns == ["doc_id", "ids"]
    by = {r.doc_id: r.ids for r in rows}
    assert by[0] == [] and by[len(HARD)] == []
    texts = {r.doc_id: r.text for r in encoding.decode_documents(encoded).collect()}
    assert all(texts[k] == t for k, t in enumerate(HARD)) and texts[None] == "twice"
    assert encoding.encode_documents(docs.limit(0)).count() == 0


def test_round_trip_on_the_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = encoding.decode_documents(encoding.encode_documents(docs)).withColumnRenamed("text", "again")
    joined = docs.select("doc_id", "text").join(back, "doc_id")
    assert joined.count() == docs.count()
    assert joined.where("coalesce(text, '') != again").count() == 0


def test_other_patterns_are_refused():
    path, pattern = encoding.default_vocabulary()
    assert encoding.encoder(path, pattern).encode("a b").tolist() == encoding.encoder().encode("a b").tolist()
    with pytest.raises(ValueError, match="not proven"):
        encoding.encoder(path, r"\S+|\s+")
