import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tarn.llm import suffix_dedup as s
from tarn.llm.common import read_table

from .helpers import documents, odd_rows


def brute(rows):
    """rows in the order of the corpus, as bytes; per row n_removed, n_spans and the hash of what is left."""
    seen, out = set(), []
    for data in rows:
        gone = bytearray(len(data))
        for k in range(len(data) - s.LENGTH + 1):
            part = data[k : k + s.LENGTH]
            if part in seen:
                gone[k : k + s.LENGTH] = b"\1" * s.LENGTH
            seen.add(part)
        left = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((len(data), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(left).hexdigest()))
    return out


def check(spark, rows, path):
    got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in s.repeated_bytes(documents(spark, rows, path)).collect()]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    want = brute([(rows[k][1] or "").encode() for k in order])
    assert sorted(map(str, got)) == sorted(str((rows[k][0], w)) for k, w in zip(order, want, strict=True))


def random_rows(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(12)]
    passages += ["ab" * 150, "x" * 400, "The one common line of all.", "z" * 101]
    rows = []
    for k in range(120):
        parts = [r.choice(passages)[: r.choice((60, 99, 100, 101, 400))] if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 8))]
        rows.append((k, (r.choice((" ", "")).join(parts))))
    return rows + [(200 + k, r.choice(rows)[1]) for k in range(20)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_corpora(spark, tmp_path, seed):
    check(spark, random_rows(seed), tmp_path / "d")


def in_buckets(batches, function):
    table = pa.Table.from_batches(batches)
    for n in set(table.column("bucket").to_pylist()):
        out = function(table.filter(pc.equal(table.column("bucket"), n)))
        yield from zip(out.column("rid").to_pylist(), out.column("v").to_pylist(), strict=True)


def test_pieces_and_flushes(monkeypatch):
    for name, value in (("PIECE", 512), ("FLUSH", 64), ("FLUSH_SUFFIXES", 8)):
        monkeypatch.setattr(s, name, value)
    monkeypatch.setattr(s, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 0)}))}))
    rows = [(k, t[:3000]) for k, t in random_rows(3)]
    ids = [k for k, _ in rows]
    batch = pa.RecordBatch.from_pydict({s.ROW_ID: ids, "doc_id": ids, "text": [t for _, t in rows]})
    found = defaultdict(list)
    for rid, v in in_buckets(list(s.anchor_blobs(5)(iter([batch]))), s.compare_contexts):
        found[rid].append(v)
    asked = batch.append_column("vs", pa.array([found.get(k) for k in ids], pa.list_(pa.int64())))
    for rid, v in in_buckets(list(s.suffix_blobs(np.array([b"b", b"n" * 32], "S32"))(iter([asked]))), s.compare_suffixes):
        found[rid].append(v)
    for k, want in zip(ids, brute([t.encode() for _, t in rows]), strict=True):
        assert len({i for v in found[k] if v >= 0 for i in range(v >> 9, (v >> 9) + (v & 511))}) == want[1]


def test_whole_table(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    want = {r.doc_id: w for r, w in zip(docs, brute([(r.text or "").encode() for r in docs]), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.op2_suffix_dedup(spark, sf).collect()}
    assert got == want


def test_odd_rows_and_empty_table(spark, tmp_path):
    check(spark, odd_rows(), tmp_path / "d")
    assert s.repeated_bytes(documents(spark, odd_rows(), tmp_path / "d").where("false")).count() == 0


def test_multikey_order():
    rows = np.random.default_rng(1).integers(0, 3, (500, 24)).astype(np.uint8)
    rows[::3, :16] = 1
    order = s.multikey_order(rows)
    assert [bytes(rows[k]) for k in order] == sorted(bytes(r) for r in rows)
