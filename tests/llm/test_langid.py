import math

import numpy as np
import pytest

from skeinlake.llm import langid as L
from skeinlake.llm.labels import SPELLINGS
from skeinlake.session import table

SENTENCES = {
    "en": "The tests are green again and nobody has looked at it.", "de": "Ich habe das noch einmal geprüft, aber es bleibt langsam.",
    "fr": "Je pense que nous ne savons pas si la correction est complète.", "es": "El arreglo está hecho y todas las pruebas pasan otra vez.",
    "pt": "Acho que a tarefa foi contada duas vezes e ainda falta a cópia.", "ru": "Думаю, что все проверки снова проходят без ошибок.",
    "uk": "Гадаю, що всі перевірки знову проходять без помилок.", "th": "ขอบคุณมากครับ พรุ่งนี้จะดูอีกที", "ja": "テストはまた全部通りました。", "zh": "所有测试又都通过了。",
    "ko": "모두 합치기 전에 확인해 주시겠어요?", "ar": "لا أعرف السبب بعد.", "hi": "कारण अभी पता नहीं है।",
}


@pytest.fixture(scope="module")
def model(spark, data):
    d = data.replace("0.001", "0.01")
    return L.fit_sample(L.inputs(*(table(spark, d, t) for t in ("documents", "event_rows", "lang_labels"))))


def langs(text, model):
    return [s[0] for s in L.segments(text, model)]


def test_each_language_alone(model):
    assert {k: langs(v, model) for k, v in SENTENCES.items()} == {k: [k] for k in SENTENCES}


def test_every_pair_mixed(model):
    for a, x in SENTENCES.items():
        for b, y in SENTENCES.items():
            if a != b:
                assert langs(f"{x} {x}\n{y} {y} {y}\n{x} {x}", model) == [a, b, a], (a, b)


def test_what_has_no_language_ends_no_segment(model):
    x = SENTENCES["de"]
    code = '```\nconst the = that(is, 1); // and of it\n```\n[tool_use Read] {"the": "and of it"}\n$ make the thing\n## the heading of it\nuser: '
    assert langs(f"---\nname: the and of\ntype: note\n---\n{x}\n{code}{x}\nété r12ab été\n{x}", model) == ["de"]
    for none in (None, "", "  \n ", code, "12 345 !", "a1b2c3d4", "٣٤٥", "<|im_start|>x1<|im_end|>"):
        assert langs(none, model) == []


def test_offsets_and_confidence(model):
    text = f"user: {SENTENCES['en']}\n\nassistant: {SENTENCES['ru']}"
    (a, ca, s1, e1), (b, cb, s2, e2) = L.segments(text, model)
    assert (a, b) == ("en", "ru") and text[s1:e1] == SENTENCES["en"].rstrip(".") and text[s2:e2] == SENTENCES["ru"].rstrip(".") and min(ca, cb) > 0.9


def test_held_out_labels(spark, data, model):
    """Rows of another table than the fit's: one-segment texts agree with most clean labels."""
    docs, rows = L.inputs(*(table(spark, data, t) for t in ("documents", "event_rows", "lang_labels")))
    names = {n: c for c, own in SPELLINGS.items() for n in own}
    found = [(names.get((r["label"] or "").split("-")[0].split("_")[0].lower()), langs(r["text"], model)) for r in docs.unionByName(rows).collect()]
    pairs = [(label, got[0]) for label, got in found if label and len(got) == 1]
    assert len(pairs) > 100 and sum(a == b for a, b in pairs) / len(pairs) > 0.8


def test_cases_and_edges(spark, model):
    x, y = SENTENCES["en"], SENTENCES["th"]
    rows = [(1, x, "EN-us"), (2, x, "th"), (3, x, None), (4, x, "und"), (5, f"{x}\n{y}", "en"), (6, None, None), (7, "", "en"), (8, "x1", None), (9, x, "English"), (9, x, "English"), (10, f"{x} " * 4000, " ")]
    df = spark.createDataFrame([("documents", i, t, label, "x") for i, t, label in rows], "tab string, id long, text string, label string, seg string")
    got = {tuple(r) for r in L.wrongly_labelled(L.label_segments(df, model)).collect()}
    assert got == {("documents", i, 0, "en") for i in (2, 3, 4, 5, 10)} | {("documents", 5, 1, "th")}
    assert L.label_segments(df.limit(0), model).count() == 0
    empty = L.fit_sample([df.limit(0)])
    assert langs(y, empty) == ["th"] and langs(x, empty) == []


def test_offsets_with_invisible_characters(model):
    text = "\u200b".join(SENTENCES["en"]) + " \u200b" + SENTENCES["de"]
    (a, b) = L.segments(text, model)
    assert (a[0], b[0]) == ("en", "de")
    assert text[a[2] : a[3]].replace("\u200b", "") == SENTENCES["en"][:-1] and text[b[2] : b[3]] == SENTENCES["de"][:-1]


def test_search_over_sentences_is_that_over_words(model):
    texts = [" ".join([SENTENCES[a], SENTENCES[b], SENTENCES[a][:20], SENTENCES[c]]) for a in SENTENCES for b, c in (("en", "fr"), ("ja", "uk"))]
    for text in texts:
        units = L.units_of(text)
        penalties = [L.SWITCH if u.first else L.SWITCH_WITHIN for u in units]
        by_sentence = L.viterbi(model.scores(units), penalties)
        words = [(model.row(*w), p if i == 0 else math.inf) for u, p in zip(units, penalties) for i, w in enumerate(u.words)]
        by_word = L.viterbi(np.array([r for r, _ in words]), [p for _, p in words])
        assert by_word == [s for u, s in zip(units, by_sentence) for _ in u.words]


def test_confidence_is_calibrated_and_lower_where_little_is_said(model):
    assert 0.5 <= model.temperature < 50
    long, short = L.segments(" ".join([SENTENCES["es"]] * 3), model)[0][1], L.segments("la nota no.", model)
    assert long > 0.9 and all(c <= long for _, c, *_ in short)
