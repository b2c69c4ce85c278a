import zlib

import numpy as np
import pytest

from paperlake.llm import op3_language as op

SF = "/root/testdata/sf0.01"
ROWS = [("the cat sat on the mat and the dog ran", "en"), ("le chat est sur la table et le chien court", "fr"), ("der hund und die katze sind auf dem tisch", "de")] * 4


def brute(model, text):
    """Sum over the runs of letters: a known word's log frequencies, else the mean over its places of the longest known n-gram's, less a penalty for each shorter step."""
    total, runs = np.zeros(len(model.langs)), 0
    word = ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            runs += 1
            if word in model.words:
                total += model.logs[model.words[word]]
            else:
                marked, sums, places = f"^{word}$", np.zeros(len(model.langs)), 0
                for i in range(len(marked) - 1):
                    for n in (4, 3, 2, 1):
                        gram = marked[i : i + n]
                        if len(gram) == n and gram in model.grams:
                            sums += model.logs[model.grams[gram]] + (min(4, len(marked) - i) - n) * op.BACK_OFF
                            places += 1
                            break
                total += sums / max(places, 1)
            word = ""
    if not runs or not model.langs:
        return "und", 0.0
    e = np.exp(total - total.max())
    return model.langs[int(np.argmax(e))], float(e.max() / e.sum())


@pytest.mark.parametrize("text", [None, "", " 12 .,!", "the", "chats noirs", "Hunde und Katzen", "zzz", "l'homme--table", "THE CAT", "the le der", "x" * 4000, "ß", "İstanbul", "katze.", "-le", "a1b", "北京", "é"])
def test_word_first_backoff(text):
    model = op.train(ROWS)
    (lang,), (score,) = op.Identifier(model).identify([text])
    want = brute(model, text)
    assert lang == want[0] and score == pytest.approx(want[1])


def test_known_words_decide_before_their_letters():
    """A word that is known in one language only counts by itself, however its n-grams look."""
    model = op.train([("tionment " * 5 + "nation ment tion " * 50, "fr"), ("tionment " * 50 + "hound dog", "en")])
    assert op.Identifier(model).identify(["tionment"])[0] == ["en"]


def test_unseen_words_back_off_to_n_grams():
    model = op.train(ROWS)
    assert op.Identifier(model).identify(["katzentisch", "lechien"])[0] == ["de", "fr"]


def test_a_full_cache_starts_afresh():
    model = op.train(ROWS)
    texts = [t for t, _ in ROWS[:3]] + ["other words altogether here"]
    assert [op.Identifier(model, most=6).identify([t]) for t in texts] == [op.Identifier(model).identify([t]) for t in texts]


def test_odd_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(ROWS * 5)] + [(900, None, "en"), (901, "", None), (902, "123", "fr"), (903, "the dog", None), (None, "le chien", "fr"), (904, "katze " * 9000, None), (904, "katze " * 9000, None)]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = op.language(df).collect()
    assert len(got) == len(rows)
    pred = {r["doc_id"]: r["lang_pred"] for r in got}
    assert (pred[900], pred[901], pred[902], pred[903], pred[None], pred[904]) == ("und", "und", "und", "en", "fr", "de")
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_without_languages_and_without_rows(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in op.language(df).collect()] == [("und", 0.0)]
    assert op.language(df.limit(0)).collect() == []


def test_held_out_languages_do_not_reach_the_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.selectExpr("doc_id", "text", "IF(crc32(CAST(doc_id AS STRING)) % 4 = 2, 'xx', lang) AS lang")
    a, b = op.fit(docs), op.fit(other)
    assert a.langs == b.langs and a.words == b.words and a.grams == b.grams and (a.logs == b.logs).all()


def test_the_query_is_brute_force_over_the_whole_table(spark):
    """The registered query; at this size every row outside the test fold is learned."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    model = op.train(sorted((r["text"], r["lang"]) for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None))
    texts = {r["doc_id"]: r["text"] for r in docs}
    got = op.op3_language(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        want = brute(model, texts[r["doc_id"]])
        assert r["lang_pred"] == want[0] and r["score"] == pytest.approx(want[1], abs=1e-6)


def test_the_fit_is_bounded_and_counts_every_row_of_its_sample(spark, monkeypatch):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(ROWS * 5)]
    df = spark.createDataFrame(rows + [(k, "seltenes wort " * 3000, "de") for k in (3, 3, 3, 3, 7)], "doc_id long, text string, lang string")
    kept = [r for r in df.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    a, b = op.fit(df.repartition(5)), op.train([(r["text"], r["lang"]) for r in kept])
    assert a.words == b.words and a.grams == b.grams and np.allclose(a.logs, b.logs)
    monkeypatch.setattr(op, "FIT_LANGS", 2)
    monkeypatch.setattr(op, "FIT_WORDS", 5)
    few = op.fit(df)
    assert len(few.langs) == 2 and len(few.words) <= 5


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in op.op3_language(spark, SF).collect() if r["held_out"]]
    assert len(held) > 200 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
