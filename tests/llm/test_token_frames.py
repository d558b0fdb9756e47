import random
import zlib
from pathlib import Path

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

import public_tokenizers
from geoloom.llm import token_frames as op

from .helpers import docs_df, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


ODD = ["", " ", "  ", "a  b", "a \nb", "a\n b", "\n \n", " \nx", "x\n\ny", "don't. I'll\nIt's", "<|endoftext|> a", "É. ü,\nÀb. c", "1.\n2", "a.\nB\nc d", "a\xa0b c", "x 　 y", "tab\t b", "a \x1c b", "ends ", " starts", "ﬁ.\nß,", "日本 語。", "\U0001f600 \U0001f600\n"]


def test_encoder_is_the_library(lib):
    rng = random.Random(1)
    parts = ["a", "B", " ", "\n", ".", ",", "é", "'s", "1", "\t", "!", "word", " the", "  ", "\x85", "\r\n"]
    texts = [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 15))) for _ in range(3000)), prose(rng, 20_000)]
    got = op.ChunkEncoder(PATH).encode_many(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_and_digests(spark, lib, tmp_path):
    rng = random.Random(2)
    texts = [*ODD, None, *(prose(rng, rng.randrange(200)) for _ in range(150)), prose(rng, 30_000)]
    df = docs_df(spark, texts).withColumnRenamed("lang", "h").withColumnRenamed("source", "part")
    df = df.union(df.where("doc_id in (3, 10)")).repartition(7)
    rows = sorted(op.encoded_documents(df, PATH).collect())
    at, want = 0, []
    for i, t in sorted([*enumerate(texts), (3, texts[3]), (10, texts[10])], key=lambda x: x[0]):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in rows] == want

    files = op.write_frames(df, PATH, str(tmp_path / "out"))
    assert sum(k for *_, k in files) == len(want) and [s for _, s, _ in files] == sorted(s for _, s, _ in files)
    f = op.FrameFile(files[0][0])
    raw = zstandard.ZstdDecompressor().decompressobj()  # any reader can decompress the first frame
    assert raw.decompress(Path(files[0][0]).read_bytes()) == f.frame(0)
    k = len(f.docs) - 1  # random access
    assert np.frombuffer(f.ids(k), "<u4").tolist() == [*lib.encode(texts[f.docs[k][0]] or "", add_special_tokens=False).ids, 0]


def test_damage_is_found(tmp_path):
    w = op.FrameWriter(frame_bytes=64)
    data = b"".join(w.add(i, np.arange(20, dtype="<u4").tobytes()) for i in range(9)) + w.flush() + w.finish()
    good = tmp_path / "a.glzf"
    good.write_bytes(data)
    f = op.FrameFile(str(good))
    assert len(f.frames) == 9 and [np.frombuffer(f.ids(k), "<u4").tolist() for k in range(9)] == [list(range(20))] * 9
    for at in (len(data) - 40, len(data) - 60):
        bad = bytearray(data)
        bad[at] ^= 1
        (tmp_path / "b.glzf").write_bytes(bytes(bad))
        with pytest.raises(ValueError):
            op.FrameFile(str(tmp_path / "b.glzf"))
    bad = bytearray(data)
    bad[20] ^= 1
    (tmp_path / "c.glzf").write_bytes(bytes(bad))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        op.FrameFile(str(tmp_path / "c.glzf")).ids(0)
    (tmp_path / "d.glzf").write_bytes(b"x" * 100)
    with pytest.raises(ValueError):
        op.FrameFile(str(tmp_path / "d.glzf"))


def test_no_documents(spark):
    assert op.encoded_documents(docs_df(spark, []), PATH).collect() == []
