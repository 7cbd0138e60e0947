import pytest

from quillspark.llm import mojibake as m

CLEAN = [
    "Piñata mode costs £12 – “quoted” naïve façade… à la carte", "Größenwert für Änderungen überschreibt nächtlich", "Każdy wątek ma najwyżej źródło, świeże ścieżki i węzły",
    "Чтобы удалить узлы, сервер сжимает весь журнал. Каждый раздел содержит не более записей", "├── a\n│   └── b ×3 ± £4",
]
GARBLED = [("utf-8", "cp1252", 0), ("utf-8", "latin-1", 1), ("utf-8", "mac-roman", 1), ("utf-8", "cp437", 0), ("utf-8", "cp1251", 3), ("utf-8", "cp1252", 2), ("cp1250", "cp1252", 2), ("iso8859-2", "latin-1", 2), ("cp1251", "cp1252", 3), ("koi8-r", "cp1251", 3)]


@pytest.mark.parametrize("w,r,i", GARBLED)
def test_round_trip(w, r, i):
    learned = tuple(dict.fromkeys((a, b) for a, b, _ in GARBLED))
    bad = m.garble(CLEAN[i], w, r)
    assert bad != CLEAN[i]
    assert m.repair(bad, learned) == (CLEAN[i], True, False)
    twice = m.garble(m.garble(CLEAN[1], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert m.repair(twice, learned)[0] == CLEAN[1]


def test_clean_text_stays():
    learned = tuple(dict.fromkeys((a, b) for a, b, _ in GARBLED))
    for t in [*CLEAN, "ATENÇÃO: NÃO É PADRÃO", "¿Por qué? ¡Ojo! 5 m³, 20 °C, Ça", "MAÑANA  EL  EQUIPO", "Пётр ЧИТАЕТ", "", "plain"]:
        assert m.repair(t, learned) == (t, False, False), t


def test_loss_is_found_and_left():
    assert m.repair("Gr��en", ()) == ("Gr��en", True, True)


def test_alignment():
    assert m.align("bÃºsquedas", "búsquedas") == [("Ãº", "ú")]
    assert m.align("abc", "abd") == []
    assert "utf-8>cp1252" in m.explain("Ãº", "ú")


def test_learns_from_near_twins(spark):
    good = "Las búsquedas rápidas y las señales únicas también. Große Änderungen für “alle”"
    rows = [(i, good) for i in range(6)] + [(10, m.garble(good, "utf-8", "cp1252")), (11, good[:40] + m.garble(" La señal única", "utf-8", "cp1252")), (12, None), (13, ""), (13, "x"), (14, "Gr��n"), (10, m.garble(good, "utf-8", "cp1252"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'k' as key")
    assert ("utf-8", "cp1252") in m.learn(df)
    out = {r.doc_id: (r.text, r.lost) for r in m.repair_documents(df).collect()}
    assert set(out) == {10, 11, 14} and out[10] == (good, False) and out[11][0].endswith("La señal única") and out[14][1]
    assert m.repair_documents(df.where("false")).count() == 0


def test_learns_from_every_form_and_from_frequent_garbling(spark):
    """A key with more than a dozen frequent forms, and garbled text that outnumbers the clean."""
    words = [f"w{a}rd" for a in "áéíóúñäëïöüàèìòù"]
    rows = [" ".join(words)] * 9 + [f"w{c}rd" for c in "âê"] + [m.garble(f"w{c}rd", "utf-8", "cp1252") for c in "âê"] * 3
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert ("utf-8", "cp1252") in m.learn(df)
    ru = ["Чтобы удалить узлы", "сервер сжимает журнал", "каждый раздел содержит"]
    df = spark.createDataFrame(list(enumerate(ru + [m.garble(t, "cp1251", "cp1252") for t in ru] * 2)), "doc_id long, text string")
    learned = m.learn(df)
    assert ("cp1251", "cp1252") in learned and ("cp1252", "cp1251") not in learned


GREEK = "Η αναζήτηση βρίσκει όλα τα κείμενα – και τις σημειώσεις. Κάθε ενότητα περιέχει λίγες εγγραφές, ποτέ περισσότερες"
OTHER = ("דוגמה של טקסט עברי", "これは日本語の文章です", "مثال على نص عربي")


@pytest.mark.parametrize("w,r", [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("cp1253", "latin-1"), ("cp1253", "cp1252"), ("iso8859-7", "latin-1")])
def test_greek(w, r):
    learned = (*dict.fromkeys((a, b) for a, b, _ in GARBLED), ("cp1253", "latin-1"), ("cp1253", "cp1252"), ("iso8859-7", "latin-1"))
    text = GREEK if w != "iso8859-7" else GREEK.replace("–", "-")
    bad = m.garble(text, w, r)
    assert bad != text and m.repair(bad, learned) == (text, True, False)
    assert m.repair(GREEK, learned) == (GREEK, False, False)


def test_other_scripts_written_as_utf8():
    learned = (("utf-8", "latin-1"),)
    for t in OTHER:
        assert m.repair(m.garble(t, "utf-8", "latin-1"), learned) == (t, True, False)
    for t in ("publié\u00a0», même", "déjà\u00a0» dit-il", "Ï\u00a0» x", *OTHER):
        assert m.repair(t, learned) == (t, False, False)


def test_learns_greek_from_near_twins(spark):
    parts = GREEK.split(" ")
    rows = [GREEK] * 3 + [m.garble(GREEK, "utf-8", "latin-1"), m.garble(" ".join(parts[2:9]), "cp1253", "latin-1"), m.garble(" ".join(parts[5:12]), "cp1253", "latin-1")] + [" ".join(parts[i : i + 6]) for i in range(8)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in m.repair_documents(df).collect()}
    assert out == {3: GREEK, 4: " ".join(parts[2:9]), 5: " ".join(parts[5:12])}


def test_restored_share_of_planted_documents(spark):
    """Every planted document comes out as it was first written."""
    import random

    rng = random.Random(9)
    rows, want = [], {}
    for i in range(400):
        t = " ".join(rng.choice(c.split(" ")) for c in (CLEAN[:4] if i % 2 else CLEAN[1:4]) for _ in range(8)) if i % 5 else CLEAN[3]
        if i % 7 == 0:
            bad = m.garble(t, "utf-8", rng.choice(("cp1252", "latin-1")))
            if bad and bad != t:
                want[i], t = t, bad
        rows.append((i, t))
    got = {r.doc_id: r.text for r in m.repair_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(want) and sum(got[i] == t for i, t in want.items()) >= 0.98 * len(want)
