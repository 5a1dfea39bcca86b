import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from graphloom.llm import op05_token_files as op
from graphloom.llm.common import tokenizer_file
from tests.llm.helpers import documents, edge_rows, write


def reference(rows):
    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    return [(r[0], np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")) for r in rows]


def test_query_on_edge_rows(spark, tmp_path):
    rows = edge_rows()
    got = op.op5_token_files(spark, write(spark, tmp_path, documents=documents(spark))).collect()
    want = sorted(((i is not None, i or 0, len(x), zlib.crc32(x.tobytes())) for i, x in reference(rows)), key=lambda x: x)
    mine = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got)
    assert mine == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_many_files_and_random_access(spark, tmp_path):
    rows = [(k * 3 - 50, f"text number {k} " * (k % 7), "en", "a", 0) for k in range(200)]
    manifest = op.write_files(documents(spark, rows), str(tmp_path / "files"), tokenizer_file("byte_bpe_50k.json"), rows_per_file=17)
    files = manifest.orderBy("task", "part").collect()
    assert len(files) > 5 and sum(f["documents"] for f in files) == 200
    want, seen = dict(reference(rows)), []
    for f in files:
        reader = op.Reader(f["uri"])
        seen += reader.ids
        k = len(reader) // 2
        assert reader.find(reader.ids[k]) == [k]
        np.testing.assert_array_equal(reader.document(k), want[reader.ids[k]])
    assert seen == sorted(seen)


def test_checksums_catch_damage(spark, tmp_path):
    manifest = op.write_files(documents(spark, [(1, "some text to damage " * 50, "en", "a", 0), (2, "other", "en", "a", 0)]), str(tmp_path / "files"), tokenizer_file("byte_bpe_50k.json"))
    uri = manifest.first()["uri"]
    with open(uri, "r+b") as f:
        f.seek(20)
        b = f.read(1)
        f.seek(20)
        f.write(bytes([b[0] ^ 255]))
    reader = op.Reader(uri)
    with pytest.raises(Exception):  # noqa: B017, PT011
        reader.document(0)
    assert len(reader.document(1)) > 0


def test_files_are_plain_zstandard(spark, tmp_path):
    import io

    import zstandard

    manifest = op.write_files(documents(spark, [(1, "alpha beta", "en", "a", 0), (2, "gamma", "en", "a", 0)]), str(tmp_path / "files"), tokenizer_file("byte_bpe_50k.json"))
    with open(manifest.first()["uri"], "rb") as f:
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
    assert np.frombuffer(whole, "<u2").tolist() == [i for _, x in reference([(1, "alpha beta"), (2, "gamma")]) for i in x]


def test_empty_table(spark, tmp_path):
    assert op.op5_token_files(spark, write(spark, tmp_path, documents=documents(spark, []))).count() == 0


def test_special_tokens_as_the_library_has_them(spark, tmp_path):
    rows = [(1, "a <|endoftext|> b", "en", "a", 0), (2, "<|endoftext|><|endoftext|>\n\n  x", "en", "a", 0), (3, "<|endof text|>", "en", "a", 0)]
    got = {r["doc_id"]: r for r in op.op5_token_files(spark, write(spark, tmp_path, documents=documents(spark, rows))).collect()}
    want = dict(reference(rows))
    assert 50256 in want[1] and all(got[k]["ids_crc32"] == zlib.crc32(x.tobytes()) and got[k]["n_tokens"] == len(x) for k, x in want.items())


def test_ids_that_do_not_fit_are_refused(spark, tmp_path):
    docs, path, file = documents(spark, [(1, "text", "en", "a", 0)]), str(tmp_path / "files"), tokenizer_file("byte_bpe_50k.json")
    with pytest.raises(ValueError, match="70000"):
        op.write_files(docs, path, file, end_id=70_000, width=2)
    reader = op.Reader(op.write_files(docs, path, file, end_id=70_000).first()["uri"])
    assert reader.meta["width"] == 4 and reader.document(0)[-1] == 70_000


def test_a_hot_id_is_dealt_to_many_tasks(spark, tmp_path):
    rows = [(7 if k % 3 else k, f"text {k}", "en", "a", 0) for k in range(300)]
    manifest = op.write_files(documents(spark, rows), str(tmp_path / "files"), tokenizer_file("byte_bpe_50k.json"), rows_per_file=20)
    assert manifest.selectExpr("max(documents) as n").first()["n"] <= 20 and manifest.select("task").distinct().count() >= 10
    read = op.read_digests(manifest)
    assert read.rdd.getNumPartitions() == manifest.count()
    got, at = sorted(read.collect(), key=lambda r: r["start"]), 0
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in rows)
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_few_tasks_write_many_files(spark, tmp_path):
    rows = [(k, f"text {k}", "en", "a", 0) for k in range(100)]
    manifest = op.write_files(documents(spark, rows), str(tmp_path / "files"), tokenizer_file("byte_bpe_50k.json"), rows_per_file=10, most_tasks=2)
    assert manifest.count() >= 10 and sorted(r["doc_id"] for r in op.read_digests(manifest).collect()) == list(range(100))


def test_a_batch_looks_up_each_piece_once():
    encoder, looked = op.LibraryEncoder(tokenizer_file("byte_bpe_50k.json"), 2), []

    class Counted(op.UnitCache):
        def __getitem__(self, piece):
            looked.append(piece)
            return super().__getitem__(piece)

    encoder.pieces = Counted(encoder.piece)
    texts = [" ".join(f"word{'abcdefg'[(k + j) % 7]}{',.!'[j % 3]}" for j in range(50)) for k in range(300)]
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.batch(pa.array(texts))]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(looked) == len(set(looked)) <= 7 + 7 + 3


def test_batches_as_the_library_has_them(monkeypatch):
    parts = [*" \n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u3000\u2019\u200b\u0301", " ", "  ", "\n\n", "a", "Ab", "stra\u00dfe", "\u65e5\u672c", "\U0001f642", "7", "\u00b2", *".,'_^`~", "***", "'s", "'ll", "<|endoftext|>", "<|endof", "x" * 60]
    encoders, draw = [(op.LibraryEncoder(tokenizer_file("byte_bpe_50k.json"), w), f"<u{w}") for w in (2, 4)], random.Random(5)
    library = encoders[0][0].tokenizer
    texts = ["", "", *("".join(draw.choices(parts, k=draw.choice([0, 1, 2, 3, 5, 9, 30]))) for _ in range(3000)), ""]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (1 << 24, 300, 20):
        monkeypatch.setattr(op, "CHUNK_BYTES", most)
        for encoder, ids in encoders:
            for kind in (pa.string(), pa.large_string()):
                assert [np.frombuffer(x, ids).tolist() for x in encoder.batch(pa.array(["cut ", *texts, " off"], kind).slice(1, len(texts)))] == want
    assert list(encoders[0][0].batch(pa.array([], pa.string()))) == [] and list(encoders[0][0].batch(pa.array([""]))) == [b""]
