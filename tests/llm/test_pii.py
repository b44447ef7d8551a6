import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import pii
from tarn.llm.common import read_table

from .helpers import documents, odd_rows


def plain(text):
    """The contract's patterns as they are written."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        total = sum(d[-1::-2]) + sum(2 * n - 9 * (n > 4) for n in d[-2::-2])
        if 12 <= len(d) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1290.@+-_ ()%é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_cards_and_long_runs():
    assert [s for s in pii.base_spans("4111 1111 1111 1111 x 4111111111111112") if s[1] == 2] == [(0, 2, 19)]
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_whole_table(spark, sf):
    rows = pii.op1_pii(spark, sf).collect()
    texts = {r.doc_id: r.text for r in read_table(spark, sf, "documents").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def corpus():
    told = [(k, f"call zanzibar near me@x{k % 2}.example.com please and thanks number {k}") for k in range(8)]
    return told + [(100 + k, f"please and thanks call number {k}") for k in range(60)]


def test_disclosing_terms_against_brute_force(spark, tmp_path):
    docs = documents(spark, corpus(), tmp_path / "d")
    found = {(r.doc_id, s.start, s.stop): s.kind for r in pii.sanitising_spans(docs).collect() for s in r.more or []}
    text = dict(corpus())
    # zanzibar stands beside each entity in all of its documents, and in half of its own with each: PMI = IC - 1
    zanzibar = {k for k, v in found.items() if text[k[0]][k[1] : k[2]] == "zanzibar"}
    assert len(zanzibar) == 8 and {found[k] for k in zanzibar} == {4}  # IC = log2(68 / 4), PMI = log2(68 / 8)
    assert all(text[k[0]][k[1] : k[2]] not in ("call", "please", "and", "thanks") for k in found)


def test_stage_replaces_and_leaves_clean_texts_alone(spark, tmp_path):
    docs = documents(spark, corpus() + odd_rows(), tmp_path / "d")
    out = pii.pii_stage(spark, docs, "")
    assert out.schema.names == docs.schema.names and out.count() == docs.count()
    assert out.where(F.col("text").contains("@") & F.col("text").contains("example")).count() == 0
    assert out.where(F.col("text").contains("[EMAIL]") & F.col("text").contains("[TERM]")).count() == 8
    assert out.where("doc_id between 100 and 200").select("text").exceptAll(docs.where("doc_id between 100 and 200").select("text")).count() == 0
    assert out.where("text is null").count() == 2 and out.where("n_chars <> length(text)").count() == 0


def test_odd_rows_and_empty_table(spark, tmp_path):
    docs = documents(spark, odd_rows(), tmp_path / "d")
    assert pii.sanitising_spans(docs).count() == len(odd_rows())
    assert pii.sanitising_spans(docs.where("false")).count() == 0
    assert pii.pii_stage(spark, docs.where("false"), "").count() == 0


def test_terms_of_entities_seen_once_are_judged(spark, tmp_path):
    once = [(k, f"write to quillfeather at u{k}@host{k}.example.com please and thanks number {k}") for k in range(9)]
    rows = once + [(100 + k, f"please and thanks write number {k}") for k in range(90)]
    found = {(r.doc_id, s.start, s.stop): s.kind for r in pii.sanitising_spans(documents(spark, rows, tmp_path / "d")).collect() for s in r.more or []}
    text = dict(rows)
    # n = 99, n_c = n_ct = n_t = 9, smoothed by 3: PMI / IC = 1 + log2((9 + 27 / 99) / 12) / log2(11)
    assert {(k[0], text[k[0]][k[1] : k[2]], v) for k, v in found.items()} == {(k, "quillfeather", 4) for k in range(9)}


def test_flagged_terms_are_replaced_in_the_whole_document(spark, tmp_path):
    far = "please and thanks number " * 20
    rows = [(k, f"zanzibar {far} me@x{k % 2}.example.com {far} Zanzibar") for k in range(8)] + [(100 + k, far) for k in range(60)]
    found = [(r.doc_id, s.start, s.stop, s.kind) for r in pii.sanitising_spans(documents(spark, rows, tmp_path / "d")).collect() for s in r.more or []]
    text = dict(rows)
    assert sorted((d, text[d][a:b], k) for d, a, b, k in found) == sorted((d, w, 4) for d in range(8) for w in ("zanzibar", "Zanzibar"))
