import random

from tidemark.llm import encoding, spam

SENTENCES = {
    "de": ["Prüfsumme ungültig, Block {} wird erneut übertragen", "Schlüssel gelöscht, Neustart nötig für Gerät {}", "Das Gerät {} antwortet über den Kanal nicht, Rückfall"],
    "fr": ["Échec de vérification à l'étape {}", "Clé périmée, accès refusé au calculateur {}", "Téléchargement interrompu après {} ko déjà reçus"],
    "ru": ["Низкое напряжение батареи: {} мВ", "Откат выполнен успешно за {} секунд", "Загрузка прервана, осталось {} пакетов"],
    "zh": ["存储空间不足，已清理缓存目录{}", "签名证书已过期，第{}次重试", "网关无响应，正在重试第{}次"],
}


def clean(n=40):
    rnd = random.Random(8)
    return [s.format(rnd.randint(10, 9999)) for _ in range(n) for v in SENTENCES.values() for s in v]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if b is None else bytearray(b), "x") for i, (t, b) in enumerate(rows)], "rec_id bigint, text string, raw_bytes binary, chain string")


def test_wrong_encodings_are_found_and_undone(spark):
    base = [(t, t.encode()) for t in clean()]
    wrong = []
    for t in clean(1):
        for right, read in [("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "koi8-r"), ("utf-8", "cp1251"), ("gb18030", "latin-1"), ("cp1251", "latin-1"), ("utf-8", "gb18030")]:
            try:
                bad = t.encode(right).decode(read)
            except UnicodeError:
                continue
            if bad != t:
                wrong.append((bad, t))
    twice = "Échec de vérification à l'étape 7"
    wrong.append((twice.encode().decode("latin-1").encode().decode("latin-1"), twice))
    wrong.append((f"{clean(1)[3]} <- {clean(1)[0].encode().decode('latin-1')}", f"{clean(1)[3]} <- {clean(1)[0]}"))
    lossy = [("Sess�o", None), ("Größe".encode("latin-1").decode("utf-8", "replace"), "Größe".encode("latin-1"))]
    fine = ["plain ascii", "sensor reads 3 °C, limit ±5 °C", "", None, "ü" * 20_000]
    rows = base + [(b, None) for b, _ in wrong] + lossy + [(t, None) for t in fine] + base[:5]
    got = {r.rec_id: r for r in encoding.repair(frame(spark, rows), "rec_id", "text", "raw_bytes").collect()}
    n = len(base)
    assert not any(got[i].affected for i in range(n)), [got[i].restored for i in range(n) if got[i].affected][:3]
    missed = [b for i, (b, t) in enumerate(wrong) if not got[n + i].affected]
    assert len(missed) <= 0.03 * len(wrong), missed
    right = sum(got[n + i].restored == t for i, (b, t) in enumerate(wrong))
    assert right >= 0.9 * len(wrong)
    m = n + len(wrong)
    assert got[m].affected and got[m].chain == "" and got[m + 1].affected and got[m + 1].restored == "Größe"
    assert not any(got[m + 2 + i].affected for i in (0, 1, 4)) and m + 4 not in got and m + 5 not in got


def test_no_dictionary_and_no_rows(spark):
    assert encoding.repair(frame(spark, []), "rec_id", "text", "raw_bytes").count() == 0
    out = encoding.repair(frame(spark, [("RÃ¼ckfall auf Ã¤ltere Fassung", None)]), "rec_id", "text", "raw_bytes").first()
    assert out.affected and out.restored == "Rückfall auf ältere Fassung"


PROSE = "The gateway waited for the controller, and the update went on. Nobody knows why the second attempt failed, but the log is clear. "
LOG = "".join(f"2025-01-02 03:04:{i:02d}.123 [core] INFO cache opened size={i} ref=ab{i}\n" for i in range(40))


def pages():
    rnd = random.Random(3)
    words = ["ecu unlock", "ota flash tool", "vin decoder", "map update", "dealer key", "obd adapter"]
    spam_ = [
        ", ".join(rnd.choice(words) for _ in range(90)),
        " ".join(rnd.choice(words) for _ in range(90)),
        "\n".join(f"{rnd.choice(words)} Altus {rnd.randint(1, 9)} cheap" for _ in range(40)),
        "\n".join(f"» {rnd.choice(words)} https://www.{rnd.choice('abc')}.example/x?id={i}" for i in range(20)),
        "#" + " #".join(rnd.choice(words).replace(" ", "_") for _ in range(30)),
        " | ".join(f"GW-{i}A {rnd.choice(words)} €{i}" for i in range(40)),
        "车机破解, 网关解锁, 固件下载, " * 30,
        PROSE[:63] + "\n" + "Tags: " + ", ".join(rnd.choice(words) for _ in range(60)),
    ]
    fine = [
        PROSE * 4, LOG, PROSE * 5 + "\nSee also:\n" + "\n".join(f"- a https://b.example/{i}" for i in range(5)), "closing, not reproducible",
        "| 0x71 | charger | " + PROSE * 3 + "|\n| 0x72 | modem | " + PROSE * 2 + "|", "- " + PROSE.replace(". ", ".\n- ") * 3,
        "总之，步骤失败，车队暂停推送。" * 20, "a" * 50_000, "", " \n ", None, "{" + '"a": 1, ' * 3 + "}",
    ]
    return spam_, fine


def test_spam_pages(spark):
    bad, fine = pages()
    rnd = random.Random(1)
    corpus = [PROSE * rnd.randint(1, 8) + str(i) for i in range(60)]
    rows = [(i, t, "en", 0.5) for i, t in enumerate([*bad, *fine, *corpus])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, ratio double")
    found = {r.doc_id for r in spam.spam_pages(df, "doc_id", "text").collect()}
    assert found == set(range(len(bad)))
    assert spam.spam_pages(df.limit(0), "doc_id", "text").count() == 0
    assert {r.doc_id for r in spam.spam_pages(df.union(df), "doc_id", "text").collect()} == found


def test_stuffed_sentences_are_found_and_repeated_sentences_are_not(spark):
    rnd = random.Random(4)
    words = ["ecu unlock", "ota flash tool", "固件下载", "map update"]
    pick = lambda: (rnd.choice(words), rnd.choice(words))
    stuffed = ["".join(f"{rnd.choice(['Best', 'Buy'])} {a} {rnd.choice(['for', 'with'])} {b} {a}{rnd.choice('!.')} " for a, b in (pick() for _ in range(60))) for _ in range(3)]
    fine = ["Die Werkstatt suchte im Netz nach Firmware und fand nichts Brauchbares. " * 20, PROSE * 20]
    corpus = [" ".join(f"{w} {rnd.randint(1, 10**6):x}" for w in PROSE.split()) + "." for _ in range(60)]
    df = spark.createDataFrame([(i, t, "EN-us") for i, t in enumerate([*stuffed, *fine, *corpus])], "doc_id bigint, text string, lang string")
    for columns in (["text"], ["text", "lang"]):
        assert {r.doc_id for r in spam.spam_pages(df, "doc_id", *columns).collect()} == {0, 1, 2}
