from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from sunloom.llm import langid, registry

TABLE = Path("/root/testdata/sf0.01/documents.parquet")
LINES = {
    "en": ["The measurements were repeated several times, and the threshold value remained stable.", "It has been found that the valve ages faster if the cover is not protected from moisture.", "The sensor can also be used together with the cable if the housing is missing."],
    "de": ["Die Messungen wurden mehrmals wiederholt, und der Schwellenwert blieb dabei stabil.", "Es hat sich gezeigt, dass das Ventil schneller altert, wenn die Abdeckung nicht geschützt wird.", "Der Messfühler kann auch zusammen mit dem Kabel verwendet werden, falls das Gehäuse fehlt."],
    "fr": ["Les mesures ont été répétées plusieurs fois et la valeur seuil est restée stable.", "Il a été constaté que la soupape vieillit plus vite lorsque le couvercle n'est pas protégé.", "Le capteur peut aussi être utilisé avec le câble lorsque le boîtier est absent."],
    "es": ["Las mediciones se repitieron varias veces y el valor umbral permaneció estable.", "Se ha comprobado que la válvula envejece más rápido si la tapa no está protegida.", "El sensor también puede utilizarse junto con el cable cuando falta la carcasa."],
    "it": ["Le misurazioni sono state ripetute più volte e il valore di soglia è rimasto stabile.", "È stato constatato che la valvola invecchia più rapidamente se il coperchio non è protetto.", "Il sensore può anche essere usato insieme con il cavo se manca l'alloggiamento."],
    "pt": ["As medições foram repetidas várias vezes e o valor limite manteve-se estável.", "Verificou-se que a válvula envelhece mais depressa quando a tampa não está protegida.", "O sensor também pode ser utilizado em conjunto com o cabo se a caixa não existir."],
    "nl": ["De metingen werden meermaals herhaald en de drempelwaarde bleef daarbij stabiel.", "Gebleken is dat de klep sneller veroudert wanneer het deksel niet wordt beschermd.", "De sensor kan ook samen met de kabel worden gebruikt wanneer de behuizing ontbreekt."],
    "ru": ["Измерения были повторены несколько раз, и пороговое значение оставалось стабильным.", "Было установлено, что клапан стареет быстрее, если крышка не имеет защиты от влаги.", "Датчик может применяться также вместе с кабелем, если корпус отсутствует."],
    "zh": ["测量重复了多次,阈值保持稳定,并且由与盖板相同的材料制成。", "已经发现,如果盖板没有防潮保护,阀门会更快老化。", "如果没有壳体,传感器也可以与电缆一起使用。"],
    "ja": ["測定は何度も繰り返され、しきい値は安定したままであった。", "カバーが湿気から保護されていない場合、弁はより早く劣化することが分かった。", "ハウジングがない場合、センサはケーブルと共に使用することもできる。"],
}


def document(lang, extra=()):
    return "\n".join(["Title", "", *LINES[lang], *extra])


@pytest.fixture(scope="module")
def model():
    texts = [(document(k), k) for k in LINES for _ in range(4)]
    return langid.fit_on([t for t, _ in texts], [k for _, k in texts])


def labels(model, text):
    got = list(langid.Labeller(model).label([text]))
    return [(n, langid.LANGUAGES[k]) for n, k, _ in got[0][1]] if got else []


def test_held_out_accuracy_on_the_common_words_alone():
    bare = langid.fit_on([], [])
    right = [labels(bare, document(k))[:1] == [(0, k)] for k in LINES if k != "zh"]
    assert np.mean(right) == 1.0


def test_mixed_documents(model):
    for main in LINES:
        for other in LINES:
            if other != main:
                text = "\n".join(["Title of it", *LINES[main], LINES[other][1], *LINES[main]])
                assert labels(model, text) == [(0, main), (5, other)], (main, other)


def test_what_is_no_line(model):
    text = document("en", ["DIE ABDECKUNG MIT DEM SENSOR", "Patentansprüche und Zeichnungen", "η = P_mp / (G · A) = 7.31 (23)", "<mrow><mi>η</mi><mo>=</mo><mn>1.27</mn><mrow", "Kaldisor2000", "Das ist kurz.", "1. Der Sensor (92), umfassend das Kabel und die Abdeckung, wobei das Kabel an dem Sensor befestigt ist.\r"])
    assert labels(model, text) == [(0, "en"), (12, "de")]
    for none in ("", "0", "—", "[[EQ-0050]]\nI_sc = I_0·(e^(q·V/(n·k·T)) − 1 3", "\n\n", "Kaldisor2000"):
        assert labels(model, none) == []


def test_decoding_together_equals_exact_viterbi(model):
    rng = np.random.default_rng(0)
    texts = ["\n".join(rng.choice([x for v in LINES.values() for x in v], n)) for n in (1, 2, 3, 5, 8)]
    lab = langid.Labeller(model)
    numbers = [lab.numbers(t) for t in texts]
    lab.learn()
    for tokens, got in zip(numbers, lab.decode(numbers)):
        def value(path):
            total = lab.scores[tokens[0], path[0]]
            for i in range(1, len(path)):
                if path[i] != path[i - 1]:
                    total -= langid.CHANGE_AT_BREAK if tokens[i - 1] == 0 else langid.CHANGE
                total += lab.scores[tokens[i], path[i]]
            return float(total)

        k = len(langid.LANGUAGES)
        best = lab.scores[tokens[0]].astype(float)
        for i in range(1, len(tokens)):
            pen = langid.CHANGE_AT_BREAK if tokens[i - 1] == 0 else langid.CHANGE
            best = np.array([max(best[a] - (pen if a != b else 0) for a in range(k)) for b in range(k)]) + lab.scores[tokens[i]]
        assert value(list(got)) == pytest.approx(best.max(), abs=1e-3)
    assert lab.decode([np.zeros(0, np.int32)])[0].tolist() == []


def test_posteriors_equal_the_sums_over_all_paths(model, monkeypatch):
    lab = langid.Labeller(model)
    texts = ["la sensor de valve\nder cable", "die", "le la\n\nthe del het mit der"]
    numbers = [lab.numbers(t) for t in texts]
    lab.learn()
    labels = lab.decode(numbers)
    k = len(langid.LANGUAGES)
    for tokens, own, got in zip(numbers, labels, lab.posterior(numbers, labels)):
        emit = np.exp(lab.scores[tokens].astype(float))

        def step(t):
            c = np.exp(-(langid.CHANGE_AT_BREAK if tokens[t] == 0 else langid.CHANGE))
            return np.full((k, k), c) + (1 - c) * np.eye(k)

        ahead, back = [emit[0]], [np.ones(k)]
        for t in range(1, len(tokens)):
            ahead.append(ahead[-1] @ step(t - 1) * emit[t])
            back.insert(0, step(len(tokens) - t - 1) @ (emit[len(tokens) - t] * back[0]))
        both = np.array(ahead) * np.array(back)
        want = (both / both.sum(axis=1, keepdims=True))[np.arange(len(tokens)), own]
        assert np.allclose(got, want, atol=1e-4)
    # In pieces as in one.
    long = lab.numbers("\n".join(x for _ in range(20) for v in list(LINES.values())[:7] for x in v))
    lab.learn()
    labels = lab.decode([long])
    whole = lab.posterior([long], labels)[0]
    monkeypatch.setattr(langid, "PIECE", 300)
    assert np.abs(lab.posterior([long], labels)[0] - whole).max() < 1e-3


@pytest.mark.skipif(not TABLE.exists(), reason="no test tables")
def test_confidence_is_the_share_of_right_labels_on_held_out_snippets():
    """Fitted on the even documents; a few words of lines of the odd ones against the language of their whole line."""
    docs = pd.read_parquet(TABLE, columns=["doc_id", "text", "lang"])
    docs = docs[docs.lang.isin(langid.LANGUAGES[:7]) & docs.text.str.len().between(200, 20_000)]
    fit, held = docs[docs.doc_id % 2 == 0], docs[docs.doc_id % 2 == 1]
    lab = langid.Labeller(langid.fit_on(list(fit.text), list(fit.lang)))
    rng = np.random.default_rng(3)
    lines = [x for t in held.text for x in t.split("\n") if langid.is_running(x) and len(x.split()) > 8 and x.isascii()]
    whole, parts = [], []
    for i in rng.permutation(len(lines))[:3000]:
        words, n = lines[i].split(), int(rng.integers(1, 7))
        a = int(rng.integers(0, len(words) - n))
        whole.append(lab.numbers(lines[i]))
        parts.append(lab.numbers(" ".join(words[a : a + n])))
    lab.learn()
    of = lambda labels: np.array([np.bincount(x).argmax() for x in labels])
    labels = lab.decode(parts)
    right = of(labels) == of(lab.decode(whole))
    sure = np.array([p.mean() for p in lab.posterior(parts, labels)])
    assert right[sure > 0.99].mean() > 0.98 and right[sure < 0.6].mean() < 0.75
    assert abs(sure.mean() - right.mean()) < 0.03


def test_found_on_labels_nulls_repeats_and_long_texts(spark, model):
    rows = [(1, document("de"), "de-DE"), (2, document("de"), "en"), (3, document("fr"), None), (4, None, None), (5, "", "xx"), (6, document("es"), "ES"), (7, document("nl", [LINES["en"][0]]), "nld"), (2, document("de"), "en"), (8, "\n".join(LINES["pt"] * 3000), "und"), (9, document("it"), "it_IT")]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, lang string, label string, line_no int")
    got = sorted((r.doc_id, r.line_no, r.lang) for r in langid.found(df, model).collect())
    assert got == [(2, 0, "de"), (2, 0, "de"), (3, 0, "fr"), (7, 6, "en"), (8, 0, "pt")]
    assert langid.found(df.limit(0), model).count() == 0
    every = langid.main_languages(df, model).collect()
    assert sorted(r.doc_id for r in every) == sorted(r[0] for r in rows)
    m = {r.doc_id: r for r in every}
    assert m[4].lang is None and m[1].label_ok and m[1].confidence > 0.9 and not m[3].label_ok


def test_fit_takes_a_bounded_sample(spark):
    rows = [(i, document(k) * 3, k.upper()) for i, k in enumerate(list(LINES) * 30)] + [(9999, None, "en"), (9998, "short", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.sample_rows(df, rows=5)
    assert 0 < len(sample) <= 50 and sorted(sample) == sorted(langid.sample_rows(df.repartition(6), rows=5))
    assert langid.fit_model(df.limit(0)).words


def test_a_query_gives_the_confidence_of_all_parts(spark, tmp_path):
    rows = [(i, document(k) * 3, k.upper()) for i, k in enumerate(list(LINES) * 10)] + [(9000, document("nl", [LINES["en"][0]]), "nl")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["p8_parts"](spark, str(tmp_path)).filter("doc_id = 9000").collect()
    assert {r.line_no > 0: r.lang for r in got} == {False: "nl", True: "en"}
    assert all(0 < r.confidence <= 1 for r in got)
