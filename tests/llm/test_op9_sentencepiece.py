import random

import pytest

from quartzite.llm.sentencepiece_fst import MODEL, Transducer, decode, digest, encode, op9_sentencepiece, read_model

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def machine():
    return Transducer(read_model(MODEL))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_same_ids_as_the_library(spark, machine, library):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    r = random.Random(7)
    alphabet = list("abcdeghilnorstu  \n\t.,;=/()0123456789ABCéüß中文日本😀⁇　ﬁ\x00")
    texts += ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "  ", " a", "a ", "\n \n", "x" * 500, "==" * 300, "<s></s><0x41>", "The quick brown fox's internationalization", "a" + " " * 40 + "b", " ​"]
    texts += [" " * k for k in range(70)] + ["word" + " " * k + "\n" for k in range(40)]
    for t in texts:
        ids = machine.encode(t)
        assert ids == library.encode(t), t[:80]
        assert machine.decode(ids) == t


def test_table_round_trip(spark, sf, odd_docs, no_docs):
    rows = op9_sentencepiece(spark, sf).collect()
    assert len(rows) == 200 and all(r.round_trip for r in rows)
    back = {(r.doc_id, r.text) for r in decode(encode(odd_docs)).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd_docs.collect()}
    assert digest(odd_docs).count() == 11 and digest(no_docs).count() == 0
    assert Transducer(read_model(MODEL)).decode(Transducer(read_model(MODEL)).encode("a▁b")) == "a b"
