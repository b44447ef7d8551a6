import pytest

from tarn.llm import language

from .helpers import documents


def test_stage_keeps_letters_where_no_label_is_known(spark, tmp_path):
    docs = documents(spark, [(1, "a clean text"), (2, "noch ein Text"), (3, "123 !"), (4, None), (5, "")], tmp_path / "d")
    assert language.fit(docs) is None
    assert sorted(r.doc_id for r in language.language_stage(spark, docs, "").collect()) == [1, 2]


@pytest.mark.parametrize("most", [1, 2])
def test_no_label_is_left_out(spark, tmp_path, monkeypatch, most):
    words = {"aa": "zebra lion", "bb": "kiwi mango", "cc": "stone river"}
    docs = documents(spark, [(k, f"{w} {w}", v) for v, w in words.items() for k in range(ord(v[0]) * 40, ord(v[0]) * 40 + 40)], tmp_path / "d")
    monkeypatch.setattr(language, "FULL_LABELS", most)
    monkeypatch.setattr(language, "SAMPLE", 4)
    assert language.fit(docs).labels == ["aa", "bb", "cc"]


def test_letters_are_what_isalpha_says(spark, tmp_path):
    for text in ("²³½", "Ⅷ", "①④", "12 ³ _", "", None, "٣", "!?"):
        assert not language.has_letter(text) and not len(language.features(text)[0])
    for text in ("x²", "ª", "中", "é", "ß1"):
        assert language.has_letter(text) and len(language.features(text)[0])
    rows = [(k, "the house and the dog", "en") for k in range(9)] + [(20 + k, "das haus und der hund", "de") for k in range(9)]
    docs = documents(spark, rows + [(50, "²³½"), (51, "Ⅷ"), (52, "the dog")], tmp_path / "d")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.fit(docs)).collect()}
    assert got[50] == got[51] == ("und", 0.0) and got[52][0] == "en"
    kept = {r.doc_id: r.lang for r in language.language_stage(spark, docs, "").collect()}
    assert 50 not in kept and kept[52] == "en" and kept[20] == "de"


def test_rows_of_the_model_are_bounded_exactly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 7)
    docs = documents(spark, [(4, f"text {'ab' * (k % 40)} of it", "en") for k in range(600)] + [(k, f"der text {k}", "de") for k in range(600, 900)], tmp_path / "d")
    found = {}
    monkeypatch.setattr(language, "Hierarchy", lambda rows, langs: found.update(langs=langs))
    language.fit(docs)
    assert {v: found["langs"].count(v) for v in ("en", "de")} == {"en": 7, "de": 7}
