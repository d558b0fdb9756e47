import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from geoloom.llm import fst_bpe as op

from .helpers import docs_df, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "Don't STOP, now.. a.b, É, É.", "x́ ,. <|endoftext|> hi<|startoftext|>", "ΑΣ ΣΑΣ. 1234 --- 　a", "İstanbul,", "ﬁ ß SS ẞ.", "\x1c a\x1fb", "é É\n\t\x0b", "it's we'll I'm.", "日本語 \U0001f600.", "a" * 3000, "</w> w</w>"]


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def want(lib, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def texts():
    rng = random.Random(1)
    parts = ["a", "B", " ", "\n", ".", ",", "é", "'s", "1", "\t", "!", "Word", " the", "É", "ß", "-", "\x1d", "Ω", "́"]
    return [*ODD, *(prose(rng, 300) for _ in range(30)), *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 15))) for _ in range(1500)), prose(rng, 20_000)]


def test_digests_are_the_librarys(spark, lib):
    all_ = texts()
    df = docs_df(spark, all_).withColumnRenamed("lang", "word").withColumnRenamed("source", "n")
    df = df.union(df.where("doc_id < 3"))
    rows = op.encoded_digests(df, PATH).collect()
    assert len(rows) == len(all_) + 3
    for r in rows:
        assert tuple(r)[1:] == want(lib, all_[r["doc_id"]]), all_[r["doc_id"]]


def test_outputs(spark, lib):
    all_ = texts()[:50]
    for r in op.encode_documents(docs_df(spark, all_), PATH).collect():
        ids = lib.encode(all_[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == lib.decode(ids, skip_special_tokens=False)
    codec = op.Codec(PATH)
    assert codec.decode(codec.encode("Two words, here.")) == lib.decode(lib.encode("Two words, here.", add_special_tokens=False).ids, skip_special_tokens=False)


def test_automaton(tmp_path):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))).encode() for _ in range(400)})
    path = tmp_path / "x.fst"
    path.write_bytes(op.Lexicon.pack(words, np.array([i + k for i in range(len(words)) for k in (0, 1)]), 2 * np.arange(len(words) + 1)))
    lex = op.Lexicon(str(path))
    assert op.Lexicon(path.read_bytes()).find(words).tolist() == list(range(len(words)))
    assert lex.find(words).tolist() == list(range(len(words))) and lex.ids[lex.offset[7] : lex.offset[8]].tolist() == [7, 8]
    absent = [w + b"x" for w in words] + [b"", b"zzz", b"abcabcabc" * 9]
    assert set(lex.find(absent).tolist()) == {-1}
    # minimal: no two states have the same future
    arcs = {}
    for k, t in zip(lex.key.tolist(), lex.target.tolist()):
        arcs.setdefault(k >> 8, []).append((k & 255, t))
    states = [(int(f), tuple(arcs.get(s, ()))) for s, f in enumerate(lex.final)]
    assert len(set(states)) == len(states) and len(states) < sum(map(len, words)) / 2
    empty = tmp_path / "e.fst"
    empty.write_bytes(op.Lexicon.pack([], np.zeros(0, int), np.zeros(1, int)))
    assert op.Lexicon(str(empty)).find([b"a"]).tolist() == [-1]


def test_small_groups_change_nothing(lib, monkeypatch):
    monkeypatch.setattr(op, "GROUP", 2000)
    all_ = texts()[:200]
    codec = op.Codec(PATH)
    got = [t.as_py() for _, ids, ends in codec.encoded(pa.array(all_, pa.string())) for t in codec.joined(ids, ends, True)]
    assert got == [lib.decode(lib.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for t in all_]


def test_merges_are_the_librarys(lib):
    rng = random.Random(4)
    merges = op.Codec(PATH).merges
    table = dict(enumerate(op.byte_chars()))
    words = ["".join(rng.choice("aeinrsthlo") for _ in range(rng.randrange(1, 90))).encode() for _ in range(3000)]
    words += [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 80))) for _ in range(500)] + [b"th" * 4000, b"a" * 1001]
    ids, offset = merges.many(words)
    for i, w in enumerate(words):
        want_ = [t.id for t in lib.model.tokenize(w.decode("latin-1").translate(table))]
        assert ids[offset[i] : offset[i + 1]].tolist() == want_ == merges.one(w)


def test_white_space(lib):
    codec = op.Codec(PATH)
    for c in map(chr, [*range(0x3002), 0xFEFF, 0x10FFFF]):
        if not 0xD800 <= ord(c) < 0xE000 and not "a" <= c.lower() <= "z":
            text = f"{c}ab{c}{c}cd. {c}"
            assert codec.encode(text) == lib.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_the_lexicon_answers_first(spark, lib, tmp_path, monkeypatch):
    """Words of the lexicon never reach the merges; its size is that of a histogram's cut."""
    rng = random.Random(6)
    all_ = [prose(rng, 200) for _ in range(20)] + ["rare words zyxwv"]
    monkeypatch.setattr(op, "LEXICON", 500)
    place = op.compile_lexicon(docs_df(spark, all_), PATH)
    codec = op.Codec(PATH, op.Lexicon(place.removeprefix("file://")))
    seen = []
    monkeypatch.setattr(codec, "word_ids", lambda words, letters, own=codec.word_ids: seen.extend(words) or own(words, letters))
    for t in all_:
        assert codec.encode(t) == lib.encode(t, add_special_tokens=False).ids
    few = op.compile_lexicon(docs_df(spark, all_), PATH, size=50)
    assert seen == [] and 0 < len(op.Lexicon(few.removeprefix("file://")).offset) - 1 <= 50


def test_no_documents(spark):
    assert op.encoded_digests(docs_df(spark, []), PATH).collect() == []
