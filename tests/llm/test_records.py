import zlib

import numpy as np
import pytest

from panelweave.llm import records
from panelweave.storage import new_path
from tests.llm.helpers import documents, prose

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def encoded(text):
    return tokenizers.Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


ODD = [
    (3, None), (1, ""), (2, "One\ntwo\tthree, don't. ΣΑΣ İstanbul é. <|endoftext|>. it's ..,, 12,3. straße."),
    (None, "no id"), (7, "same id b"), (7, "same id a"), (7, "same id a"), (9, prose(1, 30_000)), (-4, " \r\n "),
]


def test_round_trip_and_positions(spark):
    path = new_path(spark, "records")
    index = records.write_token_records(documents(spark, ODD), path, PATH, file_text_bytes=2_000).orderBy("start").collect()
    assert len(index) == len(ODD)
    assert [r["doc_id"] for r in index] == sorted((d for d, _ in ODD), key=lambda d: (d is not None, d))
    start = 0
    for r in index:
        assert r["start"] == start
        start += r["n_tokens"]
    want = sorted((d if d is not None else -99, zlib.crc32(np.array(encoded(t), "<u4").tobytes())) for d, t in ODD)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -99, r["ids_crc32"]) for r in index) == want
    back = records.read_ids(spark, path).collect()
    assert sorted(list(r["ids"]) for r in back) == sorted(encoded(t) for _, t in ODD)


def test_seek_by_index(spark, tmp_path):
    path = new_path(spark, "records")
    index = records.write_token_records(documents(spark, ODD), path, PATH)
    files = {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(f"{path}/records").collect()}
    for r in index.collect():
        data = files[r["file"]][r["offset"] : r["offset"] + r["length"]] + b"\n"
        ((_, _, doc_id, ids),) = records.frames(data)
        assert doc_id == r["doc_id"] and len(ids) == r["n_tokens"]


def test_damage_is_found():
    good = records.frame(5, b"\x01\x00\x02\x00", 2) + b"\n"
    assert [list(i) for *_, i in records.frames(good)] == [[1, 2]]
    for at in range(len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(records.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(records.frames(good[:-3]))


def test_empty_table(spark):
    path = new_path(spark, "records")
    assert records.write_token_records(documents(spark, []), path, PATH).count() == 0


def test_chunks_equal_whole_texts():
    encoder = records.ChunkEncoder(PATH, 1)
    texts = [t for _, t in ODD] + ["Ünïcode ﬁ ǅ. ªº 中文. हिन्दी. ´ ≠. ...a.,b", "x́. y z"]
    for text, ids in zip(texts, encoder.batch(texts)):
        assert list(np.frombuffer(ids, "<u2")) == encoded(text)
    assert encoder.by_chunk


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """The short way is taken by the tokenizer's settings alone."""
    import json

    from panelweave.llm.queries import tokenizer_path
    from panelweave.llm.records import ChunkEncoder

    text = "Two  words,\nOne's ΣΑΣ 1st <|endoftext|> x" + "y" * 500 + " " + "." * 300
    assert ChunkEncoder(tokenizer_path(), 1).by_chunk
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {}):
        settings = json.load(open(tokenizer_path())) | change
        path = tmp_path / "tokenizer.json"
        path.write_text(json.dumps(settings))
        encoder = ChunkEncoder(str(path), 1)
        assert encoder.by_chunk == (not change)
        want = [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert encoder.batch([text, None, text]) == [b"".join(i.to_bytes(encoder.width, "little") for i in ids) for ids in (want, [1], want)]
        assert all(len(c) <= 64 for c in [*encoder, *encoder.words, *encoder.marks])
