import glob
import os
import random

import pytest

from loomindex.llm.languages import Discriminator, document_languages, label_code, paragraph_words, plain_letters

SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"
needs_samples = pytest.mark.skipif(not glob.glob(SAMPLES), reason="needs the language samples")


def test_prose_of_a_text():
    text = "---\nid: X-1\ntitle: Ein kurzer Satz\n---\n\n# Head\r\n\r\nRead `a_b` or src/x.py (see the `log` command), then callMe now.\n\n```js\nlet x = 1;\n```\n\n&#96;&#96;&#96;\ncode words here\n&#96;&#96;&#96;\n\n  \nEnd of it."
    assert paragraph_words(text) == [["ein", "kurzer", "satz"], ["head"], ["read", "or", "then", "now"], ["end", "of", "it"]]
    assert paragraph_words("") == [] and paragraph_words(" \n\t") == [] and paragraph_words("```\nx\n```") == []
    assert paragraph_words("rÃ©ponses GROẞE l'été") == [["réponses", "große", "l'été"]]


def test_labels():
    cases = {"EN": "en", " en": "en", "eng": "en", "pt_BR": "pt", "es-MX": "es", "deu": "de", "xx": None, "und": None, "": None, None: None, "n/a": None, "Deutsch": "de", "nld": "nl"}
    assert {k: label_code(k) for k in cases} == cases


def _samples(spark):
    return [(r.lang, r.sample_text) for r in spark.read.parquet(SAMPLES).collect()]


@needs_samples
def test_held_out_sentences(spark):
    data = _samples(spark)
    random.Random(1).shuffle(data)
    cut = len(data) * 3 // 4
    machine = Discriminator(data[:cut])
    right = total = 0
    for code, text in data[cut:]:
        for shown in (text, plain_letters(text), text.upper()):
            words = [w for p in paragraph_words(shown) for w in p]
            right += machine.judge([words])[0][0] == code
            total += 1
    assert right / total >= 0.85


@needs_samples
def test_documents(spark):
    by = {}
    for code, text in _samples(spark):
        by.setdefault(code, []).append(text)
    de, en, fr = (" ".join(by[c][:4]) for c in ("de", "en", "fr"))
    docs = [
        (1, de, "de", "x"), (2, en, "fr", "x"), (3, f"{de}\n\n{en}", None, "x"), (4, None, "en", "x"), (5, "", "en", "x"), (6, "```\nlet x = 1\n```", "en", "x"), (7, plain_letters(fr).upper(), "FR_ca", "x"),
        (8, (en + "\n\n") * 400, "en", "x"), (None, en, "en", "x"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, segments string")
    got = {r.doc_id: r for r in document_languages(df, spark.read.parquet(SAMPLES)).collect()}
    assert set(got) == {1, 2, 3, 5, 6, 7, 8}
    assert (got[1].lang_code, got[2].lang_code, got[7].lang_code) == ("de", "en", "fr")
    assert set(got[3].languages) == {"de", "en"} and [s.lang_code for s in got[3].segments] == ["de", "en"]
    assert got[5].lang_code is None and got[6].languages == [] and len(got[8].segments) == 400
    assert 0.5 < got[1].confidence <= 1
    assert document_languages(df.limit(0), spark.read.parquet(SAMPLES)).count() == 0
    assert os.path.exists(SAMPLES)
