"""Language identification of words that are long or of several scripts."""

import numpy as np

from llm_cases import frame
from skyroll.llm import langid

ZH = "我们今天去学校学习中文然后和朋友一起吃饭他说这个问题很重要因为大家都想知道答案"
JA = "私たちは今日学校へ行って日本語を勉強しますそれから友達と一緒にご飯を食べました"
TH = "วนนเราไปโรงเรยนเพอเรยนภาษาไทยแลวกนขาวกบเพอน"
EN = "the children walk to school every morning and they read their books with great joy"


def rows(spark):
    return spark.createDataFrame(
        [(i, t, lang) for i, (t, lang) in enumerate([(ZH, "zh"), (JA, "ja"), (TH, "th"), (EN, "en")] * 3)],
        "doc_id long, text string, lang string")


def test_pieces_cover_every_gram_once():
    for word in ("a", "word", "x" * 39 + "yz" * 30, ZH, ZH + "abc" + JA, "текст" * 30 + "漢字"):
        got = langid.pieces(word)
        assert sum(p.letters for _, p in got) == len(word)
        assert [i for i, _ in got] == np.cumsum([0] + [p.letters for _, p in got])[:-1].tolist()
        want = []
        for run in langid._RUN.finditer(word):
            w = f"^{run[0]}$"
            want += [w[i:i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)] + list(run[0])
        assert sorted(g for _, p in got for g in langid.grams(p)) == sorted(want)


def test_runs_agree_with_script_of():
    for c in map(chr, range(0x41, 0xD7B0)):
        if c.isalpha():
            assert langid._RUN.match(c).lastgroup == langid.script_of(c)


def test_long_unspaced_texts_are_read_whole(spark):
    model = langid.train_languages(rows(spark))
    tail = EN.replace(" ", "")
    texts = [ZH * 2 + TH * 6, TH + ZH * 6, ZH * 3 + JA * 9, ZH * 2 + tail * 6, "x1" + TH * 4 + "!", EN]
    got = {r.doc_id: r for r in langid.label_languages(
        frame(spark, list(enumerate(texts))), model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["th", "zh", "ja", "en", "th", "en"]
    for i, (langs, at) in {0: (["zh", "th"], len(ZH) * 2), 1: (["th", "zh"], len(TH)),
                           3: (["zh", "en"], len(ZH) * 2)}.items():
        spans = got[i].spans
        assert [s.lang for s in spans] == langs
        assert [(s.first_word, s.n_words, s.first_char) for s in spans] == [(0, 1, 0), (0, 1, at)]
    assert [s.lang for s in got[2].spans][::len(got[2].spans) - 1] == ["zh", "ja"]
    assert [tuple(s) for s in got[5].spans] == [(0, len(EN.split()), "en", 0)]
