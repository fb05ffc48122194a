"""P9 operator: round trips through wrong encodings, and ordinary texts left alone."""

import pytest

from lodeworks.llm.mojibake import garbled, restore

TEXTS = {
    "de": "Über die „Grüße“ aus Köln — schöne Füße, größer als 20 °C…",
    "fr": "Déjà l’été, où « même » les garçons rêvent à Noël.",
    "pt": "Não há “coração” nem você também às três.",
    "pl": "Już są „żółte” gęsi, więc będzie źle w Łodzi.",
    "ru": "Если это не так, то также между ними может быть ёж — № 5.",
    "el": "Είναι «μια» μέρα με ήλιο και όταν θέλω.",
    "en": "Don’t “quote” me — it’s 50 € or ±3…",
}
PLAIN = [None, "", "plain ASCII", *TEXTS.values(), "O CORAÇÃO “LÃ” É «JÃ»", "Der „Gruß“ und Fuß…", "85 µm und 85 ΜM, x² + 1, 20 °C", "Hufabrobo® Naïve café", "ñandú über été", "geipfa​unzuch fafäch", "CAFÉ” MÜNCHEN…", "он сказал «её»", "ΡΊΣΆΧΆΣ «ΓΉΜΆΝ…»", "liberté»… l’été", "他说“你好”。", "Příliš žluťoučký kůň úpěl ďábelské ódy", "ĐÂY LÀ “CÂU”", "x\xa0= 5\xa0€"]


SCRIPTS = {
    "he": "שלום לכולם, מה שלומכם היום?",
    "hi": "नमस्ते दुनिया, आप कैसे हैं?",
    "th": "สวัสดีชาวโลก วันนี้อากาศดี",
    "zh": "今天天气很好，我们去公园散步。",
    "ar": "مرحبا بالعالم، كيف حالك اليوم؟",
    "ja": "これは日本語の文章です。カタカナもあります。",
    "ko": "안녕하세요, 오늘 날씨가 좋습니다.",
    "vi": "Đây là một câu tiếng Việt có dấu.",
    "ka": "გამარჯობა მსოფლიო",
    "ta": "வணக்கம் உலகம்",
}


def misread(text, codec):
    raw = text.encode("utf-8")
    if codec == "latin_1":
        return raw.decode("latin_1")
    return "".join(_one(b, codec) for b in raw)


def _one(byte, codec):
    try:
        return bytes([byte]).decode(codec)
    except UnicodeDecodeError:
        return chr(byte)


@pytest.mark.parametrize("codec", ["latin_1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman"])
@pytest.mark.parametrize("lang", TEXTS)
def test_utf8_misread(lang, codec):
    found = restore(misread(TEXTS[lang], codec))
    assert found is not None
    if codec not in ("cp1250", "cp1251"):  # those leave some bytes without a character of their own
        assert found[4] == TEXTS[lang]


@pytest.mark.parametrize("codec", ["latin_1", "cp1252", "mac_roman", "cp437", "cp1251"])
@pytest.mark.parametrize("lang", SCRIPTS)
def test_any_script(lang, codec):
    assert restore(SCRIPTS[lang]) is None
    found = restore(misread(SCRIPTS[lang], codec))
    assert found[0] == "utf8" and found[4] == SCRIPTS[lang]


@pytest.mark.parametrize(("lang", "codec"), [("ja", "shift_jis"), ("ja", "euc_jp"), ("zh", "gbk"), ("ko", "euc_kr")])
def test_double_byte(lang, codec):
    found = restore("".join(_one(b, "cp1252") for b in SCRIPTS[lang].encode(codec)))
    assert found[0] == "double_byte" and found[4] == SCRIPTS[lang]


def test_many_times_misread():
    text = garbled_text = "schöne Grüße"
    for _ in range(7):
        garbled_text = misread(garbled_text, "latin_1")
    assert restore(garbled_text)[4] == text


@pytest.mark.parametrize("lang", ["de", "fr", "pt", "en"])
def test_twice_misread(lang):
    found = restore(misread(misread(TEXTS[lang], "cp1252"), "cp1252"))
    assert found is not None and found[4] == TEXTS[lang]


@pytest.mark.parametrize(("text", "true", "wrong"), [("schöne Grüße für Mäuse", "cp1252", "cp1251"), ("schöne Grüße für Mäuse", "cp1252", "mac_roman"), ("schöne Grüße für Mäuse", "cp1252", "cp437"), ("между ними может быть", "koi8_r", "latin_1"), ("déjà été rêvé où ça", "cp1252", "mac_roman")])
def test_single_byte(text, true, wrong):
    found = restore(text.encode(true).decode(wrong))
    assert found is not None and found[0] == "single_byte" and found[4] == text


def test_quotes_alone():
    assert restore("ôwitheaganö.") == ("single_byte", "cp1252<cp437", 1, 0, "“witheagan”.")
    assert restore("été ôté öde") is None


def test_partly():
    found = restore("Grüße und schÃ¶ne Füße")
    assert found == ("utf8", "cp1252", 1, 0, "Grüße und schöne Füße")
    assert restore("sch�ne F��e")[0] == "lost" and restore("donï¿½t")[3] == 1


@pytest.mark.parametrize("text", PLAIN)
def test_ordinary_texts(text):
    assert restore(text) is None


def test_table(spark):
    rows = [(1, "schÃ¶n", "x"), (1, "schÃ¶n", "x"), (2, None, "x"), (None, "schÃ¶n", "x"), (3, "fine", "x"), (4, "schÃ¶n " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert sorted(r.doc_id for r in garbled(df).collect()) == [1, 1, 4]
    assert garbled(df.limit(0)).count() == 0
