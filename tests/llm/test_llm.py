"""Small tests of the training-data operators: defined cases, brute force, round trips."""

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm import encoding, leakage, lstm, mixing, pii, pii_train, scans, sentences, split, uniform

# ---------------------------------------------------------------- splitting


LIMITS = [("text", "x", 40, 10), ("chunk", "x", 20, 0), ("text", "y", None, 5)]


def pieces(spark, text, most=40, over=10):
    df = spark.createDataFrame([(text, most, over)], "t string, m int, o int")
    return df.select(split.pieces(F.col("t"), F.col("m"), F.col("o")).alias("p")).first().p


@pytest.mark.parametrize("seed", range(6))
def test_pieces_round_trip(spark, seed):
    r = random.Random(seed)
    text = "".join(r.choice("абв xyz.!?\n,。") for _ in range(r.randrange(41, 900)))
    p = pieces(spark, text)
    assert all(len(x) <= 40 for x in p) and p[0] + "".join(x[10:] for x in p[1:]) == text
    assert all(a.endswith(b[:10]) for a, b in zip(p, p[1:]))


def test_pieces_cases(spark):
    assert pieces(spark, None) is None and pieces(spark, "") == [""] and pieces(spark, "a" * 40) == ["a" * 40]
    assert [len(x) for x in pieces(spark, "a" * 100)] == [30, 40, 40, 20]
    assert pieces(spark, "a" * 100, None) == ["a" * 100]
    assert pieces(spark, "Первое предложение тут. Второе предложение там, с хвостом", 40, 0) == ["Первое предложение тут. ", "Второе предложение там, с хвостом"]
    assert pieces(spark, "один большой абзац текста\n\nи другой абзац. текста тут", 40, 0)[0] == "один большой абзац текста\n\n"
    assert max(map(len, pieces(spark, "слово " * 20_000, 40, 39))) <= 40


@pytest.mark.parametrize("over", [0, 5, 25, 39, 40, 90])
def test_any_overlap_below_the_limit(spark, over):
    text = "Первое предложение тут. Второе там, с хвостом!\n\n" * 9 + "без границ" * 12
    real = min(over, 39)
    for t in (text, text + split.MARK + text):
        p = pieces(spark, t, 40, over)
        assert all(len(x) <= 40 for x in p) and all(a.endswith(b[:real]) or len(a) < real for a, b in zip(p, p[1:]))
        got = p[0]
        for x in p[1:]:
            got += x[min(real, len(got)) :]
        assert got == t


def test_oversized(spark):
    rows = [(1, "x", "t" * 41, ["c" * 21, None, "c"], 1), (2, "x", None, None, 1), (3, "z", "t" * 99, [], 1), (4, "y", "t" * 99, None, 1), (1, "x", "t" * 41, ["c" * 21, None, "c"], 1)]
    df = spark.createDataFrame(rows, "result_id long, file_format string, text string, chunks array<string>, pieces int")
    lim = spark.createDataFrame(LIMITS, "item_kind string, file_format string, max_chars int, overlap_chars int")
    got = sorted((r.item_kind, r.result_id, r.chunk_no) for r in split.oversized(df, lim).collect())
    assert got == [("chunk", 1, 0), ("chunk", 1, 0), ("text", 1, -1), ("text", 1, -1)]
    assert split.oversized(df.limit(0), lim).count() == 0


# ---------------------------------------------------------------- sentences

S = sentences.Splitter(frozenset({"Почему", "The", "Das", "Запись", "Did"}), frozenset({"г", "т", "д", "etc"}))


@pytest.mark.parametrize(
    "units",
    [
        ["Срок хранения 7 лет, см. п. 6.4 положения.", "Почему справка пропала?"],
        ["«Согласен. Исполнить.», после чего бумагу убрали.", "Почему?!"],
        ["«Мы ничего не удаляли!» — заявили сотрудники.", "Запись верна."],
        ["Binders, tapes, etc. were counted.", "The shelf holds binders, tapes, etc.", "Did it close?"],
        ["В 2009 г. ООО «Берег» сменило порядок.", "Это было в 2009 г.", "Запись сделана."],
        ["Die Vollmacht wurde am 11. März geprüft.", "Das darf nicht sein!"],
        ["„Wo ist das Original?“, fragte die Prüferin.", "Der Bearbeiter schrieb: „der Antrag fehlt.“", "Das war alles."],
        ["The guard noted, “It is sealed.”", "The file moved."],
        ["It was in file_1.v2.pdf at 192.0.2.1, i.e. there.", "iScan units came back."],
    ],
)
def test_sentences_spaced(units):
    text = " ".join(units)
    assert [text[a:b] for a, b in S.units(text)] == units


@pytest.mark.parametrize(
    "text, units",
    [
        ("“资料已经齐全。”档案室的值班员说。为什么没有归档？（该件另行存放。）“谁签的？”主管问道。", ["“资料已经齐全。”档案室的值班员说。", "为什么没有归档？", "（该件另行存放。）", "“谁签的？”主管问道。"]),
        ("都由审计科保管……至今没有清点。本季度占73.84%。", ["都由审计科保管……至今没有清点。", "本季度占73.84%。"]),
        ("डॉ. शाखा प्रमुख ने हस्ताक्षर नहीं किए। \"यह किसका है?\" निरीक्षक ने पूछा।", ["डॉ. शाखा प्रमुख ने हस्ताक्षर नहीं किए।", "\"यह किसका है?\" निरीक्षक ने पूछा।"]),
        ("راجع د. الصفحة من السجل قبل الظهر. لا يجوز أن يتكرر هذا! لماذا؟", ["راجع د. الصفحة من السجل قبل الظهر.", "لا يجوز أن يتكرر هذا!", "لماذا؟"]),
        ("قال المدير: «أين العقد؟» ثم غادر القاعة. لماذا؟", ["قال المدير: «أين العقد؟» ثم غادر القاعة.", "لماذا؟"]),
        ("ไม่มีใครทราบ ฝ่ายบัญชีเก็บไว้ 11 ปีก่อน แฟ้ม a.pdf เปิดไม่ได้", ["ไม่มีใครทราบ", "ฝ่ายบัญชีเก็บไว้ 11 ปีก่อน", "แฟ้ม a.pdf เปิดไม่ได้"]),
        ("О порядке хранения\n\nЗапись верна.\n1) первое дело;\n2) второе дело.", ["О порядке хранения", "Запись верна.", "1) первое дело;", "2) второе дело."]),
        ("Письмо было отправлено вчера вечером\nсекретарём отдела кадров нашего общества\nпо почте. Запись сделана в журнале дел\nотдела.", ["Письмо было отправлено вчера вечером\nсекретарём отдела кадров нашего общества\nпо почте.", "Запись сделана в журнале дел\nотдела."]),
        ("  \n\t ", []), ("", []), (None, []),
    ],
)
def test_sentences_other(text, units):
    assert [text[a:b] for a, b in S.units(text)] == units


def test_sentences_table(spark):
    docs = [(1, "Он пришёл. Запись верна.", 5), (2, None, 5), (3, "", 5), (1, "Он пришёл. Запись верна.", 5), (4, "слово. " * 30_000, 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, start_pos int")
    got = sentences.split_sentences(df).collect()
    assert sum(r.doc_id == 1 for r in got) == 4 and not [r for r in got if r.doc_id in (2, 3)]
    assert all(docs[0][1][r.start_pos : r.end_pos] == r.sentence for r in got if r.doc_id == 1)
    assert sentences.split_sentences(df.limit(0)).count() == 0


def test_long_quotations_are_protected():
    for n in (10, 90, 2000):
        text = "Он сказал: «" + "Это так. " * n + "», и ушёл. Потом пришёл другой."
        assert len(S.units(text)) == 2, n


def test_abbreviations_of_the_document():
    plain = sentences.Splitter()
    assert len(plain.units("Принесли экз. Тарлыкина и копию.")) == 2
    assert len(plain.units("Принесли экз. Тарлыкина и копию. Второй экз. остался у Тарлыкина.")) == 2
    assert len(plain.units("Er traf Dr. Weber dort. Das war am Mittwoch.")) == 2


def test_sentences_take_linear_time():
    import time

    text = "Он пришёл в 2009 г. Москва ждёт, т. е. слово Слово и дело. Запись верна (см. п. 4). "
    for t in (text * 60_000, "слово " * 800_000, "\n" * 3_000_000, "«" + "слово. " * 300_000):
        at = time.process_time()
        S.units(t)
        assert time.process_time() - at < 30


def test_joined_and_sent_words_agree(spark, monkeypatch):
    docs = [(k, f"Взяли экз. Тарлыкина {k}. Запись верна. Почему экз. пропал? Запись цела. См. табл. {k} и экз. Тарлыкина. «Опись. Дело.» Конец.") for k in range(30)]
    docs += [(50, "Взяли экз. Тарлыкина. Запись верна."), (51, None), (52, ""), (None, "Взяли экз. Тарлыкина. Запись верна."), (50, "Взяли экз. Тарлыкина. Запись верна.")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("starters", F.lit(1))
    few = sorted(map(str, sentences.split_sentences(df).collect()))
    monkeypatch.setattr(sentences, "MAX_WORDS", 0)
    assert sorted(map(str, sentences.split_sentences(df).collect())) == few
    assert sum("Взяли экз. Тарлыкина.'" in r for r in few) == 3


# ---------------------------------------------------------------- leakage

ITEMS = [
    (1, "В хранилище старой типографии нашли 4526 грузовых накладных, и только 191 имели ярлык «Стрелка-485», вслепую и без свидетелей, хотя сторож спал."),
    (2, "В хранилище новой лесопильни нашли 1111 погодных таблиц, и только 222 имели ярлык «Камыш-333», вопреки запрету и погоде, хотя сторож спал."),
    (3, "Слишком мало слов здесь."), (4, None),
]


def exact(doc: str, item: str) -> bool:
    """Brute force: every window of item words against every place of the document."""
    d, w = leakage.words(doc), leakage.words(item)
    for a in range(len(w) - 14):
        for n in range(15, len(w) - a + 1):
            for k in range(len(d) - n + 1):
                same = [x == y for x, y in zip(w[a : a + n], d[k : k + n])]
                figures = [any(c.isdigit() for c in x) for x in w[a : a + n]]
                changed = sum(f and not x for f, x in zip(figures, same))
                if same[0] and same[-1] and (n - sum(same)) * 7 <= n and (not changed or changed < sum(figures)):
                    return True
    return False


def test_leaks_against_brute_force(spark):
    r = random.Random(3)
    base = ITEMS[0][1].split()
    docs = []
    for k in range(60):
        a = r.randrange(0, 6)
        part = base[a : a + r.randrange(8, 20)]
        for _ in range(r.randrange(0, 4)):
            part[r.randrange(len(part))] = "иное"
        docs.append((k, "Начало дела. " + " ".join(part).upper() + " Конец дела."))
    docs += [(100, None), (101, ""), (102, ITEMS[0][1] * 200), (102, ITEMS[0][1] * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(7))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((x.doc_id, x.item_id) for x in leakage.leaks(df, items).collect())
    want = sorted((k, i) for k, t in docs[:60] for i, it in ITEMS[:2] if exact(t, it))
    assert [g for g in got if g[0] < 100] == want and len(want) > 10
    assert got[-2:] == [(102, 1), (102, 1)]
    assert leakage.leaks(df.limit(0), items).count() == 0 and leakage.leaks(df, items.limit(0)).count() == 0


def test_blocks_hot_grams_and_parts_change_nothing(spark, monkeypatch):
    """Items that share an instruction; a document with that alone leaks nothing, however the items are cut."""
    told = "Прочитайте отрывок из дела внимательно до самого конца и ответьте на вопрос, который стоит под ним, не глядя в другие листы. "
    own = [" ".join(f"{a}{w}" for w in "хранилище нашло четыре накладных листа без ярлыка вслепую пока сторож спал крепко рядом с архивом".split()) for a in ("пере", "недо", "сверх", "обо", "под", "за")]
    items = spark.createDataFrame([(k, told + t + ".") for k, t in enumerate(own)], "item_id long, text string")
    docs = [(1, told), (2, told * 300), (3, told + own[2]), (4, "Дело. " + own[4] + " Конец. " + told * 50 + own[1]), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = [(3, 2), (4, 1), (4, 4)]
    rows = lambda: sorted(tuple(r) for r in leakage.leaks(df, items).collect())
    assert rows() == want
    for name, value in (("ITEM_BLOCK", 2), ("HOT", 2), ("POSTINGS", 500)):
        monkeypatch.setattr(leakage, name, value)
    assert rows() == want
    index = leakage.Index([(k, told + t, [" ".join(leakage.words(told))]) for k, t in enumerate(own)])
    assert sorted(index.search([(d, t) for d, t in docs if t])) == [(2, 2), (3, 1), (3, 4)]


# ---------------------------------------------------------------- uniform text


def test_uniform_mapping():
    u = uniform.Uniform()
    assert u("Ｗｅｎｄｅｌｌ　８５０") == "Wendell 850" and u("оp​ен") == "орен"
    assert u("thе mail") == "the mail" and u("Cофья Дapья") == "Софья Дарья" and u("йё ü") == "йё ü"
    assert u("Web-форма IT-службы «№ 5» — ok…") == "Web-форма IT-службы «№ 5» — ok…"
    assert u("слово\xad\nдальше") == "слово\xad\nдальше" and u("сло\xadво") == "слово" and u("открьіть") == "открьіть"
    assert u("внёс, a реестр") == "внёс, а реестр" and u(None) is None and u("") == ""
    v = uniform.Uniform(lowered=True)
    assert v("skerrow.cсобакаmailточкаtest") == "skerrow.cсобакаmailточкаtest" and v("черемскевhикοлaй") == "черемскевниколай"


def test_uniform_is_stable_and_agrees_with_tables():
    u = uniform.Uniform()
    for k, v in uniform.MAPPING.items():
        if len(k) == 2:
            assert unicodedata.normalize("NFC", k) == v
        assert u(u(f"а {k} б")) == u(f"а {k} б")
    r = random.Random(5)
    keys = list(uniform.MAPPING)
    marks = [chr(c) for c in range(0x300, 0x345)]
    for low in (False, True):
        v = uniform.Uniform(low)
        for k in range(1500):
            t = "".join(r.choice([*"абвеорсabceop xy .,-;\n", *marks[: 9 * (k % 3)], r.choice(keys), "й", "ё", "ё", "ab ", "он "]) for _ in range(40))
            once = v(t)
            assert v(once) == once, repr(t)
            assert low or uniform.triggered([t])[0] or once == t


def test_uniform_widths_marks_and_whole_words():
    u = uniform.Uniform()
    assert u("ｶﾞｲﾄﾞ ￥5 𝐀𝐁ﬁ") == "ガイド ¥5 ABfi" and u("e\u0302\u0323") == u("e\u0323\u0302") == "ệ"
    assert u("дом cop там") == "дом сор там" and u("the сор is") == "the cop is" and u("он y нас, и всë") == "он у нас, и всё"
    assert u("он сказал: OK, HP и PC там") == "он сказал: OK, HP и PC там" and u("слева a.pdf и copy.exe там") == "слева a.pdf и copy.exe там"
    assert u("8-50\xad0-271") == "8-500-271" and uniform.Uniform(True)("850\xad0271") == "8500271"
    with pytest.raises(ValueError):
        uniform.conflict_free({"a": "b", "b": "c"})


def test_uniform_table(spark):
    df = spark.createDataFrame([(1, "обычный текст"), (2, "a\xa0b"), (3, None), (4, ""), (2, "a\xa0b"), (5, "x" * 100_000 + "​")], "i long, t string").withColumn("uniform", F.lit(1))
    assert sorted(r.i for r in uniform.unify(df, "i", "t").collect()) == [2, 2, 5]
    texts = [r.t or "" for r in df.collect()]
    assert [bool(x) for x in uniform.triggered(texts)] == [u != t for t, u in ((t, uniform.Uniform()(t)) for t in texts)]


# ---------------------------------------------------------------- wrong encodings

CLEAN = ["Руководитель архива написал на полях, и бумагу убрали в сейф.", "Срок хранения расписки составляет 7 лет, см. п. 6.4 положения.", "Почему трудовой договор оказался в чужой папке, неизвестно, п. 3."]


def garbled_corpus():
    known = encoding.mappings()
    rows = [(k, t.replace("7", str(k)) + " Хранитель добавил, что опись верна, п. 5.") for k, t in enumerate(CLEAN * 20)]
    truth = {}
    for k, p in enumerate([("utf-8", "cp1251"), ("utf-8", "latin-1"), ("cp1251", "cp866"), ("koi8-r", "cp1251"), ("cp1251", "latin-1")] * 4):
        t = rows[k][1]
        truth[100 + k] = t
        rows.append((100 + k, known[p].garble(t)))
    return rows, truth


def test_encoding(spark):
    rows, truth = garbled_corpus()
    twice = encoding.mappings()["utf-8", "cp1251"]
    rows += [(200, twice.garble(twice.garble(CLEAN[0]))), (201, None), (202, ""), (203, "Ñusta Ãlvares и Ђорђе Њушић, Łucja Żądłowska"), (204, "ЖУРНАЛ УЧЁТА ДОКУМЕНТ0В"), (205, "MÃ¥ns Östergård"), (206, "Ђорђе Њушић")]
    df = spark.createDataFrame(rows, "i long, text string").withColumn("restored", F.lit(0))
    fitted = encoding.fit(df)
    got = {r.i: r.restored for r in encoding.affected(df, "i", "text", fitted).collect()}
    assert set(got) == {*truth, 200, 205}
    assert all(got[k] == t for k, t in truth.items()) and got[200] == CLEAN[0] and got[205] == "Måns Östergård"
    empty = df.limit(0)
    assert encoding.affected(empty, "i", "text", encoding.fit(empty)).count() == 0


def test_encoding_round_trips():
    for p, m in encoding.mappings().items():
        if p[0] in ("cp1251", "koi8-r", "cp866") and p[1] in ("latin-1", "cp866", "koi8-r", "cp1251"):
            assert m.garble(CLEAN[0]).translate(m.map) == CLEAN[0]


def test_codecs_outside_the_list_are_learned(spark):
    """Cyrillic read as Greek: no pair of CODECS; the table comes from the aligned characters."""
    rows = [(k, t.replace("7", str(k)) + " Хранитель добавил, что опись верна, п. 5.") for k, t in enumerate(CLEAN * 30)]
    other = encoding.Mapping("cp1251", "cp1253")
    rows += [(200 + k, other.garble(rows[k][1])) for k in range(12)]
    df = spark.createDataFrame(rows, "i long, text string")
    learned, logp = encoding.fit(df)
    assert [p[0] for p in learned] == ["table"]
    got = {r.i: r.restored for r in encoding.affected(df, "i", "text", (learned, logp)).collect()}
    assert set(got) == set(range(200, 212)) and all(sum(x != y for x, y in zip(t, rows[k - 200][1])) <= 0.1 * len(t) for k, t in got.items())


def test_alignment():
    known = encoding.mappings()
    for p in (("utf-8", "cp1251"), ("cp1251", "cp866"), ("utf-8", "latin-1")):
        g = known[p].garble("«расписки»")
        assert all(known[p].explains(x, y) for x, y in encoding.aligned(g, "«расписки»")[0]) and len(encoding.aligned(g, "«расписки»")[0]) == 10
        assert not all(known[p].explains(x, y) for x, y in encoding.aligned(g, "«рассылки»")[0])
        clean = {h for h, _, _ in encoding.words_of(CLEAN[1], True)}
        assert clean >= {h for h, _, _ in encoding.words_of(known[p].garble(CLEAN[1]), False)}
    assert encoding.aligned("два", "один")[0] == [] and encoding.aligned("a1б", "a2в")[0] == [] and encoding.words_of("Да.", True) == []


def test_every_twin_is_compared(spark):
    """The true twin lies between others of the same key."""
    like = ["Дело {} лежит у нас, п. 5, в шкафу архива.".format(w) for w in ("аааа", "вода", "ямбы", "гора", "мост")]
    garbled = [encoding.mappings()["koi8-r", "cp1251"].garble(x) for x in (like[1], like[3])]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(like + garbled)], "i long, text string")
    assert ("koi8-r", "cp1251") in encoding.fit(df)[0]


# ---------------------------------------------------------------- scans


def test_scans(spark):
    plain = [(k, "docx", "Сотрудник архива получил документ. Почему справка оказался в папке научно-технического бюро?", None, {"backend": "text"}) for k in range(90)]
    pages = [f"ЖУРНАЛ УЧЁТА\n- {n} -\nСотрудник архива по-\nлучил докумепт. Почему справка\nоказался в папке научно-\nтехнического бюро?" for n in range(1, 6)]
    pages[2] = pages[2].replace("ЖУРНАЛ", "ЖУРПАЛ").replace("Сотрудник", "С0трудник")
    scan = [(100 + k, "pdf", "\n\n".join(pages), pages, {"backend": "ocr"}) for k in range(3)]
    odd = [(200, "tif", None, None, None), (201, "png", "", [], None), (202, "tif", "Одна строка", None, None), (202, "tif", "Одна строка", None, None), (203, "pdf", "слово " * 20_000, [None], {"backend": "ocr"})]
    df = spark.createDataFrame(plain + scan + odd, "result_id long, file_format string, text string, chunks array<string>, metadata map<string,string>").withColumn("fixes", F.lit(1))
    got = [r for r in scans.repair(df).collect()]
    assert sorted(r.result_id for r in got) == [100, 101, 102, 202, 202, 203]
    r = next(r for r in got if r.result_id == 100)
    found = {(f.line_no, f.kind) for f in r.found}
    for n in range(5):
        at = 7 * n
        assert {(at + 1, "header"), (at + 2, "page_number"), (at + 3, "hyphen"), (at + 4, "misread")} <= found
        assert (at + 5, "hyphen") not in found
    assert {(15, "misread"), (17, "misread")} <= found and len(found) == 22
    assert r.paragraphs[0] == "Сотрудник архива получил документ. Почему справка оказался в папке научно-технического бюро?"
    assert scans.repair(df.limit(0)).count() == 0


def test_anagram_join_against_brute_force(spark):
    r = random.Random(2)
    right = ["".join(r.choice("абвгдеинотчл") for _ in range(7)) for _ in range(40)]
    words = {w: (50, 50) for w in right}
    for w in right:
        g, b = r.choice([("н", "п"), ("о", "0"), ("и", "н"), ("л", "^"), ("ч", "4")])
        if g in w:
            words.setdefault(w.replace(g, b, 1), (2, 0))
    df = spark.createDataFrame([("w", w, n, m) for w, (n, m) in words.items()], "kind string, a string, n long, m long")
    got = {x.wrong: x.right for x in scans.corrections(df).collect()}
    want = {}
    for w, (n, m) in words.items():
        near = [x for x in right if m == 0 and x != w and any(w[:k] + g + w[k + len(b) :] == x and w[k : k + len(b)] == b for g, b in scans.CONFUSABLE for k in range(len(w)))]
        if near:
            want[w] = max(near)
    assert got == want and got


def test_pdf_with_numbered_header_is_a_scan_in_both_passes(spark):
    plain = [(k, "docx", "Сотрудник архива получил документ.", None, {"backend": "text"}) for k in range(60)]
    pages = [f"ЖУРНАЛ УЧЁТА\n- {n} -\nСотрудник получил докумепт." for n in range(1, 6)]
    numbered = [f"ЖУРНАЛ УЧЁТА {n}\nСотрудник получил докумепт." for n in range(1, 4)]
    df = spark.createDataFrame(
        plain + [(100, "pdf", "\n\n".join(pages), pages, {"backend": "ocr"}), (101, "pdf", "\n\n".join(numbered), numbered, {"backend": "text"})],
        "result_id long, file_format string, text string, chunks array<string>, metadata map<string,string>",
    )
    got = {r.result_id: [f.kind for f in r.found] for r in scans.repair(df).collect()}
    assert got[100].count("misread") == 5 and got[101].count("misread") == 3 and got[101].count("header") == 3


def test_words_need_a_frequent_variant(spark):
    """Words with figures and signs, two errors, long words and letters of any script; nothing without its right form in the corpus."""
    long = "сверхвысоко" * 5 + "частотный"
    words = [("документ", 9, 90), ("д0кумепт", 2, 0), ("mp3файл", 3, 0), ("Windows8x", 3, 0), ("Т34танк", 3, 0), ("файл", 9, 90), (long, 3, 3), (long.replace("н", "п"), 1, 0), ("ẁerte", 4, 4), ("ẁcrte", 1, 0), ("слово", 0, 500), ("я3ык", 1, 0), ("язык", 2, 2)]
    df = spark.createDataFrame([("w", *x) for x in words], "kind string, a string, n long, m long")
    got = {x.wrong: x.right for x in scans.corrections(df).collect()}
    assert got == {"д0кумепт": "документ", "я3ык": "язык", "ẁcrte": "ẁerte"}
    monkey = scans.FREQUENT
    try:
        scans.FREQUENT = 3
        got = {x.wrong: x.right for x in scans.corrections(df).collect()}
    finally:
        scans.FREQUENT = monkey
    assert got == {"д0кумепт": "документ", "я3ык": "язык", long.replace("н", "п"): long, "ẁcrte": "ẁerte"}


def test_misread_headers_are_joined(spark):
    shapes = [("s", "ЖУРНАЛ УЧЁТА ДЕЛ", 9, 0), ("s", "ЖУРПАЛ УЧЁТА ДЕЛ #", 1, 0), ("s", "ЖУРПАЛ УЧ3ТА ДЕЛ", 1, 0), ("s", "ЖУРПАЛ УЧЁТА ДЕЛ", 1, 3), ("s", "ЖУРНАП УЧЁТА ДЕЛ", 1, 0), ("s", "обычная строка", 1, 9)]
    got = {r.a for r in scans.headers(spark.createDataFrame(shapes, "kind string, a string, n long, m long")).collect()}
    assert got == {"ЖУРНАЛ УЧЁТА ДЕЛ", "ЖУРПАЛ УЧЁТА ДЕЛ"}


def test_a_stray_occurrence_keeps_a_correction(spark):
    words = [("документ", 100, 400), ("докумепт", 20, 1), ("архив", 100, 400), ("архнв", 5, 20), ("слово", 0, 100)]
    df = spark.createDataFrame([("w", *x) for x in words], "kind string, a string, n long, m long")
    assert {x.wrong: x.right for x in scans.corrections(df).collect()} == {"докумепт": "документ"}


def test_least_counts_do_not_grow(spark):
    df = spark.createDataFrame([("s", "ЖУРНАЛ", 5, 0), ("s", "строка", 100_000_000, 100_000_000)], "kind string, a string, n long, m long")
    assert "ЖУРНАЛ" in str(getattr(scans.headers(df), "collect", lambda: scans.headers(df))())


def scan_corpus(spark):
    plain = [(k, "docx", "Сотрудник архива получил документ. Почему справка в папке научно-технического бюро?", None, {"backend": "text"}) for k in range(60)]
    pages = [f"ЖУРНАЛ УЧЁТА {n}\nСотрудник получил докумепт научно-\nтехнического бюро, а архи-\nва" for n in range(1, 7)]
    rows = plain + [(100, "pdf", "\n\n".join(pages), pages, {"backend": "ocr"})]
    rows += [(110 + k, "pdf", p.replace("ЖУРНАЛ", "ЖУРПАЛ"), None, {"backend": "text"}) for k, p in enumerate(pages)] + [(102, "tif", "Он взял доку-\nмепт", None, None)]
    return spark.createDataFrame(rows, "result_id long, file_format string, text string, chunks array<string>, metadata map<string,string>")


def test_headers_and_compounds_are_joined(spark, monkeypatch):
    df = scan_corpus(spark).filter("result_id <> 102")
    few = sorted(map(str, scans.repair(df).collect()))
    monkeypatch.setattr(scans, "MAX_FIXES", 0)
    many = scans.repair(df).collect()
    assert len(many) == len(few) == 7 and sum(f.kind == "header" for r in many for f in r.found) == 12
    assert all("научно-технического" in " ".join(r.paragraphs) and "архива" in " ".join(r.paragraphs) for r in many)


def test_joined_and_broadcast_evidence_agree(spark, monkeypatch):
    df = scan_corpus(spark)
    df = df.union(df.filter("result_id = 102"))
    few = sorted(map(str, scans.repair(df).collect()))
    monkeypatch.setattr(scans, "MAX_FIXES", 0)
    assert sorted(map(str, scans.repair(df).collect())) == few and sum("Он взял документ" in r for r in few) == 2


def test_many_fixes_are_joined(spark, monkeypatch):
    monkeypatch.setattr(scans, "MAX_FIXES", 0)
    rows = [(k, "docx", "получил документ", None, {"backend": "text"}) for k in range(30)] + [(100, "pdf", "получил докумепт", ["получил докумепт"], {"backend": "ocr"})]
    df = spark.createDataFrame(rows, "result_id long, file_format string, text string, chunks array<string>, metadata map<string,string>")
    r = scans.repair(df).first()
    assert [(f.line_no, f.kind) for f in r.found] == [(1, "misread")] and r.paragraphs == ["получил документ"]


# ---------------------------------------------------------------- mixing

VOCABULARY = mixing.os.path.join(mixing.TOKENIZERS, mixing.TOKENIZER)


@pytest.mark.skipif(not mixing.os.path.exists(VOCABULARY), reason="no tokenizer file")
def test_mixing(spark):
    docs = [(k, "big", "счёт и договор " * 20) for k in range(60)] + [(100 + k, "small", "letter of the clinic " * 20) for k in range(6)] + [(200 + k, None, "ничей текст") for k in range(5)] + [(300, "big", None), (301, "other", ""), (0, "big", "счёт и договор " * 20)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("tokens", F.lit(1))
    targets = spark.createDataFrame([("m", "big", 0.6, 3, 0.5), ("m", "small", 0.3, 2, 0.5), ("m", "absent", 0.1, 9, 0.5)], "mix_name string, source string, target_share double, max_repeats int, budget_ratio double")
    used, shares = mixing.mixture(df, targets)
    s = {r.source: r for r in shares.collect()}
    assert abs(s["big"].expected_tokens / s["big"].target_tokens - 1) < 0.005 and s["absent"].reached_share == 0
    assert used.agg(F.max("repeats")).first()[0] <= 3 and used.filter("source is null").count() == 0
    assert s["small"].tokens <= 2 * s["small"].available_tokens
    want = {n for n, cap, share in (("big", 3, 0.6), ("small", 2, 0.3), ("absent", 9, 0.1)) if s[n].available_tokens * cap < s[n].target_tokens}
    assert {r.source for r in mixing.unreachable(df, targets).collect()} == want >= {"absent"}
    assert mixing.unreachable(df.limit(0), targets).count() == 0
    assert mixing.unreachable(df, targets.limit(0)).count() == 0


def test_fitted_rates_against_an_exact_solver(spark):
    """Soft memberships, one domain out of reach: coordinate descent on every document's rate to the end."""
    r = np.random.default_rng(4)
    member = r.dirichlet([0.4, 0.4, 0.4, 0.4], 60).astype(np.float32)
    source = ["abcx"[k] for k in member.argmax(1)]
    tokens = r.integers(1, 300, 60)
    df = spark.createDataFrame([(s, int(t), m.tolist()) for s, t, m in zip(source, tokens, member)], "source string, tokens long, member array<float>")
    row = lambda **k: type("Row", (), k)
    total = int(tokens.sum())
    rows = [row(source=s, target_share=x, budget_ratio=1.5, max_repeats=c) for s, x, c in (("a", 0.3, 3), ("b", 0.2, 2), ("c", 0.5, 1))]
    mix = mixing.Mix("m", rows, ["a", "b", "c"], total)
    mixing.fit_rates(df, [mix])
    a, cap = member[:, :3] * tokens[:, None].astype(float), np.array([mix.cap.get(s, 0.0) for s in source])
    x = np.zeros(60)
    miss = mix.target[:3] - a.T @ x
    for _ in range(3000):
        for i in range(60):
            new = np.clip(x[i] + a[i] @ miss / max(a[i] @ a[i], 1e-12), 0, cap[i])
            miss -= a[i] * (new - x[i])
            x[i] = new
    best = (miss**2).sum()
    mine = ((mix.target - mix.expected)[:3] ** 2).sum()
    assert best > 1 and mine <= 1.01 * best and np.allclose(mix.expected[:3], mix.target[:3] - miss, rtol=0.02)


def test_weight_of_the_text_follows_from_held_out_rows(spark):
    if not mixing.os.path.exists(VOCABULARY):
        pytest.skip("no tokenizer file")
    told = [(k, "ab"[k % 2], ("счёт и договор " if k % 2 else "letter of the clinic ") * 9) for k in range(80)]
    same = [(k, "ab"[k // 7 % 2], f"одно и то же {k % 5} " * 9) for k in range(80)]
    kind = "doc_id long, source string, text string"
    c = mixing.fit_classifier(spark.createDataFrame(told, kind), ["a", "b"], VOCABULARY)
    encode = mixing.tokenizer(VOCABULARY)
    assert c.weight > 0.1 and c.posterior(np.array(encode("letter of the clinic")), None).argmax() == 0 and c.posterior(np.array([], np.int64), "b")[1] > 0.99
    assert mixing.fit_classifier(spark.createDataFrame(same, kind), ["a", "b"], VOCABULARY).weight < 0.1


# ---------------------------------------------------------------- personal information


def test_gradients():
    p = {k: v.astype(np.float64).astype(np.float32) for k, v in lstm.fresh(4).items()}
    r = np.random.default_rng(0)
    ids, tags = r.integers(0, 90, (10, 3)), np.zeros((10, 3), np.int64)
    tags[2:5, 1] = [1, 2, 2]
    _, g = lstm.gradients(p, ids, tags)
    for k, at in (("o", (3, 1)), ("a", (1, 2)), ("ob", (0,)), ("cf", (5,)), ("cb", (2,))):
        up, down = ({a: b.copy() for a, b in p.items()} for _ in "ab")
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert abs((lstm.gradients(up, ids, tags)[0] - lstm.gradients(down, ids, tags)[0]) / 2e-2 - g[k][at]) < 2e-4


def test_viterbi_against_brute_force():
    m = lstm.Model(lstm.fresh(3, 1))
    m.a = (np.random.default_rng(1).normal(0, 1, m.a.shape) + lstm.forbidden()).astype(np.float32)
    e = np.random.default_rng(2).normal(0, 2, (4, lstm.TAGS, 5)).astype(np.float32)
    import itertools

    for b, path in enumerate(m.decode(e).T):
        score = lambda q: e[0, q[0], b] - (1e4 if q[0] and q[0] % 2 == 0 else 0) + sum(m.a[q[t - 1], q[t]] + e[t, q[t], b] for t in range(1, 4))  # noqa: E731, B023
        assert score(tuple(path)) >= max(score(q) for q in itertools.product(range(lstm.TAGS), repeat=4)) - 1e-3


def test_windows_below_the_margin_have_no_spans():
    m = lstm.Model(lstm.fresh(3, 1))
    r = np.random.default_rng(3)
    for _ in range(20):
        m.a = (r.normal(0, 1, m.a.shape) + lstm.forbidden()).astype(np.float32)
        e = r.normal(0, 1, (6, lstm.TAGS, 50)).astype(np.float32)
        e[:, 0] = e[:, 1:].max(1) + pii.margin(m.a) + 0.01
        assert not m.decode(e).any()


def test_training_learns():
    rows = [(f"почта user{k}@mail.ru и ещё слова номер {k} тут", [(6, 6 + len(f"user{k}@mail.ru"), 0)]) for k in range(200)]
    p = pii_train.train(pii_train.arrays(rows), hidden=8, steps=60, rate=0.03, note=lambda *a, **k: None)
    x, tags = pii_train.arrays(rows[:40])[7]
    m = lstm.Model(p)
    assert (m.decode(m.emissions(x[:, None]))[:, 0] == tags).mean() > 0.9


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger()


def test_tagger(tagger):
    texts = [
        "Заявитель Тарлыкин Артём Николаевич просит направить ответ на lorrimond.m@fil-7.example. Документ, серия и номер 3524 № 147016, числится утраченным.",
        "Parcel addressed to O. Kestleby, 141 Copperfield Road, Apt. 42, Westering 00398, came back unopened.", "", "   ", "Всего учтено 611 дел, т. е. на 12.57 % больше прошлогоднего.",
    ]
    got = [[(t[a:b], k) for a, b, k in s] for t, s in zip(texts, tagger.spans(texts))]
    assert got[0] == [("Тарлыкин Артём Николаевич", "name"), ("lorrimond.m@fil-7.example", "email"), ("3524 № 147016", "id_number")]
    assert got[1] == [("O. Kestleby", "name"), ("141 Copperfield Road, Apt. 42, Westering 00398", "address")]
    assert got[2:] == [[], [], []]


def test_windows_agree(tagger):
    one = "Клиент продиктовал номер 8-590-399-52-29 и попросил не звонить. Исполнитель: Ухаркенко А. С., тел. +7 526 540 24 31. "
    spans = tagger.spans([one * 40])[0]
    want = tagger.spans([one])[0]
    inner = [s for s in spans if len(one) * 2 <= s[0] < len(one) * 38]
    assert {(a % len(one), b - a, k) for a, b, k in inner} == {(a, b - a, k) for a, b, k in want} and len(inner) == 36 * len(want)


def test_held_out_accuracy(tagger, tmp_path):
    """Against labelled spans of tables that the model didn't see, where they are at hand."""
    pq = pytest.importorskip("pyarrow.parquet")
    d = "/root/testdata/check_s"
    if not pii.os.path.exists(d):
        pytest.skip("no held-out tables")
    t = pq.read_table(f"{d}/extraction_results.parquet", columns=["result_id", "text"]).slice(0, 300)
    texts = {i: x for i, x in zip(t["result_id"].to_pylist(), t["text"].to_pylist()) if x}
    f = pq.read_table(f"{d}/pii_findings.parquet", columns=["result_id", "pattern_name", "value", "context_snippet"])
    rows = pii_train.labelled(texts, [r for r in zip(*(f[c].to_pylist() for c in f.column_names)) if r[0] in texts])
    got = tagger.spans([t for t, _ in rows])
    gold = [{(a, b, lstm.KINDS[k]) for a, b, k in g} for _, g in rows]
    assert sum(len(g & set(s)) for g, s in zip(gold, got)) >= 0.99 * sum(map(len, gold))


def test_findings(spark):
    t = "Клиент Зимогорев Матвей Евгеньевич продиктовал номер\n8-590-399-52-29 и попросил не звонить после обеда."
    results = spark.createDataFrame([(1, t, 0), (2, None, 0), (3, "", 0)], "result_id long, text string, block int")
    rows = [
        (10, 1, "phone", "85903995229", "…ев Матвей Евгеньевич продиктовал номер 8-590-399-52-29 и попросил не звонить…"), (11, 1, "full_name", "зимогоревматвейевгеньевич", None), (12, 2, "phone", "85903995229", "тел. 8-590-399-52-29 конец"),
        (13, None, None, None, None), (14, 9, "biometric", "снимоклица", "Снимок лица посетителей"), (15, 1, "phone", "", ""), (10, 1, "phone", "85903995229", "…ев Матвей Евгеньевич продиктовал номер 8-590-399-52-29 и попросил не звонить…"),
    ]
    f = spark.createDataFrame(rows, "finding_id long, result_id long, pattern_name string, value string, context_snippet string").withColumn("text", F.lit("x"))
    got = [tuple(r) for r in pii.occurrences(results, f).collect()]
    a = t.index("8-590")
    assert ("text", 1, a, a + 15, "phone") in got and ("text", 1, 7, 34, "name") in got
    assert got.count(("value", 10, 0, 11, "phone")) == 2 and ("value", 11, 0, 25, "name") in got and ("value", 12, 0, 11, "phone") in got
    s = rows[0][4].index("8-590")
    assert got.count(("context_snippet", 10, s, s + 15, "phone")) == 2 and ("context_snippet", 12, 5, 20, "phone") in got
    assert not [g for g in got if g[1] in (13, 14, 15)]
    out = {(r.field, r.row_id): r.replaced for r in pii.findings_in(results, f).collect()}
    assert out["text", 1] == "Клиент [NAME] продиктовал номер\n[PHONE] и попросил не звонить после обеда."
    assert pii.findings_in(results.limit(0), f.limit(0)).count() == 0


def test_blocks_of_many_findings(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 2)
    t = "Клиент продиктовал номер 8-590-399-52-29 и попросил не звонить."
    results = spark.createDataFrame([(1, t)], "result_id long, text string")
    f = spark.createDataFrame([(k, 1, "phone", "85903995229", t) for k in range(9)], "finding_id long, result_id long, pattern_name string, value string, context_snippet string")
    got = [tuple(r) for r in pii.occurrences(results, f).collect()]
    assert len([g for g in got if g[0] == "text"]) == 1 and len([g for g in got if g[0] == "value"]) == 9


def test_nothing_outside_imports_this_package():
    import pathlib

    root = pathlib.Path(pii.__file__).parent.parent
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            assert not re.search(r"siftwork\.llm|from \.+llm|import llm", p.read_text()), p
