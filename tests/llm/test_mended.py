"""Cases that once lost rows or failed."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quadmosaic.lineage import names_in
from quadmosaic.llm import langid, pii, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=80):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_one_id_with_two_texts_loses_neither(spark):
    alone, copied = prose(1), prose(2)
    data = [(3, copied, "en", "s", 1), (5, alone, "en", "s", 1), (5, copied, "en", "t", 1), (5, alone, "en", "u", 1), (7, prose(3), "en", "s", 1), (None, copied, "en", "s", 1)]
    docs = spark.createDataFrame(data, SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, "").collect()), key=repr)
    assert got == sorted([(3, copied), (5, alone), (7, prose(3)), (None, copied)], key=repr)


def test_two_groups_may_have_one_smallest_id(spark):
    a, b = prose(4), prose(5)
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string")
    rows = simhash.near_duplicates(docs).collect()
    assert {r.component_id for r in rows} == {1} and len({r.component_fp for r in rows}) == 2
    kept = corpus_pipeline.near(spark, docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")}), "").collect()
    assert {(r.doc_id, r.text) for r in kept} == {(1, a), (1, b)}


def test_very_long_words_beside_an_identifier(spark):
    """A word of a million letters, and one to be generalised: work is linear in a word's length. Null, empty and repeated rows are there too."""
    rnd = random.Random(9)
    filler = [f"w{chr(97 + i)}ord" for i in range(20)]
    data = [(None, None), (None, ""), (1000, "x" * 1_000_000 + " boss@corp.example"), (1000, "x" * 1_000_000 + " boss@corp.example")]
    for i in range(300):
        words = [rnd.choice(filler) for _ in range(12)]
        if i % 20 == 0:
            words[5:5] = ["secretname", "boss@corp.example"]
        elif i % 31 == 0:
            words[3:3] = ["secretname"]
        elif i % 7 == 0:
            words[3:3] = ["secretary"]
        data.append((i, " ".join(words)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    chosen = {r.term: r.replacement for r in pii.disclosing(docs, generalise=0.6, remove=0.99).collect()}
    assert chosen["secretname"] and "secretname".startswith(chosen["secretname"])
    rows = pii.find_personal_data(docs, with_text=True, generalise=0.6, remove=0.99).collect()
    assert len(rows) == len(data)
    long = [r for r in rows if r.doc_id == 1000]
    assert len(long) == 2 and all(r.spans[-1].start == 1_000_001 for r in long)


def test_generalised_words_keep_few_letters(spark):
    word = "k" * 40 + "end"
    data = [(i, f"{prose(i, 6)} {word} boss@corp.example {prose(-i, 6)}") for i in range(4)] + [(i, prose(i, 20) + (" " + "k" * 36 + "other" if i % 2 else "")) for i in range(10, 90)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    chosen = {r.term: r.replacement for r in pii.disclosing(docs, remove=1.1).collect()}
    assert chosen == {word: "k" * pii.LONGEST_START}


def test_a_run_keeps_the_last_stage_only(spark, small):
    folder = corpus_pipeline.scratch(spark, "x").rsplit("/", 1)[0]
    before = {x for x in names_in(spark, folder) if x.startswith("pipeline-")}
    out = corpus_pipeline.run(spark, small)
    (new,) = {x for x in names_in(spark, folder) if x.startswith("pipeline-")} - before
    assert names_in(spark, f"{folder}/{new}") == ["4-packing"] and out.count() > 0


def test_marks_stay_in_their_words():
    assert langid.words_in("हिन्दी भाषा, ภาษาไทย!") == ["हिन्दी", "भाषा", "ภาษาไทย"]
    assert langid.words_in("Cafe\u0301 NAI\u0308VE 3x") == ["café", "naïve", "x"] == langid.words_in("Café NAÏVE 3x")
    assert langid.words_in("\u0301\u0301 42 ½") == []


def test_hindi_and_decomposed_words_are_scored_as_words(spark):
    data = [(i, t, lang) for i in range(20) for t, lang in ((f"यह हिन्दी में लिखा हुआ वाक्य है {i}", "hi"), (f"यो नेपालीमा लेखिएको वाक्य हो {i}", "ne"), (f"voilà une phrase écrite en français {i}", "fr"))]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert "हिन्दी" in model.tables[0] and "écrite" in model.tables[0]
    texts = ["हिन्दी में लिखा", "नेपालीमा लेखिएको", "une phrase e\u0301crite", "\u0301"]
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["hi", "ne", "fr", "und"]


def test_a_model_of_many_languages_is_as_large_as_its_rows(monkeypatch):
    """200 languages with words of their own: the scores kept are those that were seen, and the answers those of a full table, also with a cache that holds few words."""
    rng = np.random.default_rng(3)
    letters = "abcdefghijklmnopqrst"
    made = lambda: "".join(rng.choice(list(letters), rng.integers(3, 9)))
    seen = {}
    for k in range(200):
        for w in {made() for _ in range(40)} | {"the", "la"}:
            for n in range(langid.MAX_GRAM + 1):
                for g in [w] if n == 0 else langid.grams(w, n):
                    seen[f"l{k:03d}", n, g] = seen.get((f"l{k:03d}", n, g), 0) + int(rng.integers(1, 5))
    model = langid.Model([(*key, times) for key, times in seen.items()])
    kinds = {key[1:] for key in seen}
    assert len(model.langs) == 200 and model.nbytes <= 6 * len(seen) + 8 * (len(kinds) + 6) < len(kinds) * 200 * 4 / 10
    totals = {}
    for (lang, n, _), times in seen.items():
        totals[lang, n] = totals.get((lang, n), 0) + times

    def plain(word):
        for n in (0, *range(langid.MAX_GRAM, 0, -1)):
            found = [g for g in ([word] if n == 0 else langid.grams(word, n)) if (n, g) in kinds]
            if found:
                score = lambda lang, g, n=n: np.log10(seen[lang, n, g] / totals[lang, n]) if (lang, n, g) in seen else langid.PENALTY
                return np.array([np.mean([score(lang, g) for g in found]) for lang in model.langs])
        return np.full(200, langid.PENALTY)

    words = [g for _, n, g in list(seen)[:4000:97] if n == 0] + [made() for _ in range(60)] + ["the", "zzz", "x", "abc" * 3000]
    for w in words:
        np.testing.assert_allclose(model.word(w), plain(w), rtol=1e-5)
    texts = [" ".join(rng.choice(words[:-1], 30)) for _ in range(20)] + ["", None, "42"]
    wide = model.scorer()(texts)
    monkeypatch.setattr(langid, "CACHE_BYTES", 8 * 200 * 16)
    narrow = model.scorer()(texts)
    assert wide[0] == narrow[0]
    np.testing.assert_allclose(wide[1], narrow[1], rtol=1e-9)
    for text, lang in zip(texts[:20], wide[0]):
        mean = np.mean([plain(w) for w in langid.words_in(text)], axis=0)
        assert mean[model.langs.index(lang)] >= mean.max() - 1e-5
