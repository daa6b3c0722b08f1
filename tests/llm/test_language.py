"""Languages: labels, sentences, passages, and held-out accuracy with wrong labels."""

from lathe.llm.language import Compressors, detect, fit_dictionaries, is_sentence, label_code, sentences, wrong_labels

D = "/root/testdata/sf0.01/documents.parquet"


def test_labels(spark):
    want = {"EN": "en", " en": "en", "en-GB": "en", "en_US": "en", "English": "en", "eng": "en", "deu": "de", "ger": "de", "pt-BR": "pt", "und": None, "zz": None, "??": None, "": None, "  ": None, "unknown": None, None: None}
    df = spark.createDataFrame([(k, i) for i, k in enumerate(want)], "lang string, i int")
    assert [r.c for r in df.select("i", label_code("lang").alias("c")).orderBy("i").collect()] == list(want.values())


def test_sentences():
    s = sentences("Staff Engineer\nWe ship software every day. Do you like it here?\n• 私たちは毎日ソフトウェアを書きます。新しい仲間を探しています。")
    assert [x for x, ok in s if ok] == ["We ship software every day.", "Do you like it here?", "私たちは毎日ソフトウェアを書きます。", "新しい仲間を探しています。"]
    assert not is_sentence("About the role:") and not is_sentence("") and not is_sentence("Hi there.")


def test_found_languages(spark):
    """Rows whose label is known to be right keep it; foreign sentences put into them come out as passages."""
    docs = spark.read.parquet(D)
    dic = fit_dictionaries(docs)
    assert len(dic) == 10
    c = Compressors(dic)
    add = {
        "de": "Unser Team arbeitet gern zusammen und sucht neue Kolleginnen. Die Arbeitszeiten sind frei, und niemand muss am Freitag lange bleiben.",
        "en": "Our team likes to work together and is looking for new colleagues. The hours are flexible, and nobody has to stay late on Friday.",
        "fr": "Notre équipe aime travailler ensemble et cherche de nouveaux collègues. Les horaires sont libres, et personne ne reste tard le vendredi.",
        "es": "A nuestro equipo le gusta trabajar junto y busca nuevos compañeros. El horario es libre y nadie se queda hasta tarde los viernes.",
        "ja": "私たちのチームは一緒に働くことが好きで、新しい仲間を探しています。勤務時間は自由で、金曜日に遅くまで残る人はいません。",
    }
    for lang, text in add.items():
        assert [(p, x) for p, x, _ in c.passages(text)] == [(1, lang)]
    for a in add:
        for b in add:
            if a != b:
                assert [x for _, x, _ in c.passages(add[a] + "\n" + add[b])] == [a, b]
    assert [x for _, x, _ in c.passages("Staff Engineer Berlin\n" + add["fr"] + " Das Wort Kindergarten.")] == ["fr"]
    for nothing in (None, "", "   ", "🚀—★", "https://a.example/1 22 / 33", "Staff Engineer"):
        assert c.passages(nothing) == []
    assert [x for _, x, _ in c.passages("Our team likes to work \r\n together, and \x0b nobody stays late.é")] == ["en"]
    long = (add["en"] + " ") * 300
    assert [x for _, x, _ in c.passages(long)] == ["en"]


def test_rejected_passages(spark):
    """Texts of no listed language, or of no language, are undetermined, alone and beside others."""
    docs = spark.read.parquet(D)
    dic = fit_dictionaries(docs)
    c = Compressors(dic)
    strange = {
        "fi": "Talvella järvet jäätyvät ja lapset luistelevat niillä. Sen jälkeen kaikki juovat kuumaa kaakaota.",
        "hu": "Télen befagynak a tavak, és a gyerekek korcsolyáznak rajtuk. Utána mindenki forró kakaót iszik.",
        "el": "Τον χειμώνα οι λίμνες παγώνουν και τα παιδιά κάνουν πατινάζ. Μετά όλοι πίνουν ζεστή σοκολάτα.",
        "none": "Qwzx vbnm plkj hgfd wert. Zxcq vbtr mnpl kjhg fdsa qwer.",
    }
    for text in strange.values():
        (pos, lang, confidence), = c.passages(text)
        assert (pos, lang) == (1, "und") and confidence < 0.1
    # A language that loses its dictionary is no longer found, and not taken for another one.
    kept = Compressors({k: v for k, v in dic.items() if k != "pl"})
    texts = [r.text for r in docs.where("lang = 'pl' AND text IS NOT NULL").collect()]
    sure = [t for t in texts if [x for _, x, _ in c.passages(t)] == ["pl"]]
    assert len(sure) > 10 and sum([x for _, x, _ in kept.passages(t)] == ["und"] for t in sure) / len(sure) > 0.95
    out = wrong_labels(spark.createDataFrame([(1, strange["fi"], None), (2, strange["none"], "en")], "doc_id long, text string, lang string").unionByName(docs.select("doc_id", "text", "lang").where("doc_id > 2")))
    assert out.where("doc_id <= 2").count() == 0
    rows = [(p, x) for p, x, _ in c.passages("Our team likes to work together and is looking for new colleagues. " + strange["el"].replace("Μετά", "\n Μετά"))]
    assert rows[0] == (1, "en")


def test_held_out_labels(spark):
    """Most labels are right, so detected languages must agree with most of them, whatever rows were sampled."""
    docs = spark.read.parquet(D).where("doc_id % 2 = 0")
    rest = spark.read.parquet(D).where("doc_id % 2 = 1")
    got = detect(rest, fit_dictionaries(docs)).where("passages = 1 AND label IS NOT NULL").collect()
    assert sum(r.label == r.lang for r in got) / len(got) > 0.85 and min(r.confidence for r in got) >= 0


def test_cases_and_empty(spark):
    schema = "doc_id long, text string, lang string, pos int"
    assert wrong_labels(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(1, None, "en", 0), (2, "", None, 0), (3, "No labels here at all, so nothing can be learned.", None, 0)], schema)
    assert wrong_labels(one).count() == 0
