"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivalry.llm import by_value, pieces, queries

from . import data

by_value()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
OWN = pieces.Pieces(pieces.model_path())
AWKWARD = ["", " ", "  ", "   a", "Hello   wörld \n\t 中文 <s> ▁x \x00", "a" * 5000, "ab" * 300, "aaab" * 100,
           " " * 100 + "x", " " * 1000, "é́ ﬁ", "🙂" * 10 + " x", "x\n\n\ny  \n  z", "<0x41> <unk>", "▁▁",
           *(" " * k for k in range(3, 50)), *(" " * k + "the" for k in range(20)), *(" " * k + "\n" for k in range(20))]


def ids(text):
    return LIBRARY.encode(text or "", add_bos=True, add_eos=True)


def raw(x):
    return np.array(x, "<u4").tobytes()


def both(text):
    coded = next(OWN.encode([text]))[0]
    assert np.frombuffer(coded, "<u4").tolist() == ids(text), text[:60]
    assert OWN.decode(coded) == LIBRARY.decode(ids(text))


def test_awkward_texts():
    for text in AWKWARD + [r[1] for r in data.rows() if r[1]]:
        both(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinrst  ▁é\n中=-*1.,;'🙂A"), max_size=200))
def test_any_text(text):
    both(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 258), st.integers(0, 2)), max_size=12))
def test_any_ids(found):
    assert OWN.decode(raw(found)) == LIBRARY.decode(found)


def test_long_words_by_rounds_and_by_queue(monkeypatch):
    r = random.Random(5)
    word = "".join(r.choice(data.WORDS) for _ in range(3000))
    both(word)                               # a part longer than LONG: the queue
    monkeypatch.setattr(pieces, "LONG", 10 ** 9)
    both(word)                               # the same by rounds
    both("".join(r.choice("ab") for _ in range(2000)))


def test_memory_that_is_full(monkeypatch):
    monkeypatch.setattr(pieces, "WORDS_KEPT", 3)
    monkeypatch.setattr(pieces, "STEP", 50)
    monkeypatch.setattr(pieces, "ROUNDS", 20)
    text = " ".join(data.WORDS)
    own = pieces.Pieces(pieces.model_path())
    found = [x for part in own.encode([text, *data.WORDS, "x" * 100] * 3) for x in part]
    for found, text in zip(found, [text, *data.WORDS, "x" * 100] * 3, strict=True):
        assert np.frombuffer(found, "<u4").tolist() == ids(text)
    assert len(own.memory) <= 3 + len(data.WORDS) and max(map(len, own.memory)) <= pieces.WORD_KEPT


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto
    model = proto.ModelProto()
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    path = tmp_path / "m.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Pieces(str(path))


def test_query(spark, tmp_path):
    rows = data.rows()
    folder = data.write(spark, str(tmp_path))
    got = sorted(map(tuple, queries.op11_pieces(spark, folder).collect()), key=repr)
    expected = [(r[0], len(ids(r[1])), hashlib.sha256(raw(ids(r[1]))).hexdigest(),
                 hashlib.sha256(LIBRARY.decode(ids(r[1])).encode()).hexdigest()) for r in rows]
    assert got == sorted(expected, key=repr)


def test_columns_pass_through(spark):
    d = data.table(spark).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x"))
    got = pieces.decode(pieces.encode(d))
    assert got.columns == [c for c in d.columns if c not in ("ids", "decoded")] + ["ids", "decoded"]
    assert got.where("doc_id = 200").first()["ids"] == raw(ids(""))
    assert pieces.encode(d.limit(0)).count() == 0
    assert pieces.decode(pieces.encode(d).withColumn("ids", F.lit(None).cast("binary"))).first()["decoded"] is None
