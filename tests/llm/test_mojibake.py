"""Garbled words: round trips under all chains, and what is no case."""

import pytest

from casemill.llm.mojibake import CHAINS, clean_units, find_garbled, garbled_forms, is_clean, restore_garbled

WORDS = ["Grünwede", "présentation", "naïve", "5–7", "°C", "“shivering”", "発熱と頭痛", "Møllevik", "×10⁹/L", "São", "Łucja"]


def garble(text, written, reader):
    return text.encode(written).decode(reader, "replace")


@pytest.mark.parametrize("word", WORDS)
def test_forms_hold_every_chain(word):
    forms = {f for f, _ in garbled_forms(word)}
    for written, readers in CHAINS.items():
        for reader in readers:
            try:
                assert garble(word, written, reader) in forms | {word}
            except UnicodeEncodeError:
                pass
    assert word not in forms


def test_clean_and_garbled_words():
    assert all(map(is_clean, WORDS)) and is_clean("SÃO") and is_clean("Âge") and is_clean("ｶﾙﾃ番号")
    for bad in ("GrÃ¼nwede", "na�ve", "â€œ", "ﾃｼ", "Â°"):
        assert not is_clean(bad) or bad == "ﾃｼ"
    assert "é" in clean_units("naé,") and not clean_units("plain")


def test_find_and_restore(spark):
    clean = " ".join(WORDS)
    rows = [(i, clean, "title") for i in range(30)]
    chains = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp1251"), ("utf-8", "cp932")]
    rows += [(100 + i, "fever in " + garble("Grünwede présentation 発熱と頭痛", w, r), None) for i, (w, r) in enumerate(chains)]
    rows += [(200, garble(garble("Grünwede", "utf-8", "cp1252"), "utf-8", "cp1252"), None), (201, "M�llevik", None), (202, garble("発熱と頭痛", "cp932", "latin-1"), None)]
    rows += [(300, None, None), (301, "", ""), (302, " ", "SÃO MARELO, Âge, Å. Hedrosa, ｶﾙﾃ番号"), (303, "x" * 50_000 + " é", None), (100, rows[30][1], None), (304, "ASCII only", None)]
    df = spark.createDataFrame(rows, "id long, a string, `b c` string").selectExpr("*", "'z' as token", "'y' as text", "'w' as field")
    found = {tuple(r) for r in find_garbled(df, "id", ("a", "b c")).collect()}
    assert found == {(k, "a") for k in [*range(100, 100 + len(chains)), 200, 201, 202]}
    back = {r["id"]: r["restored"] for r in restore_garbled(df, "id", ("a", "b c")).collect()}
    assert set(back) == {k for k, _ in found}
    assert all(back[100 + i] == "fever in Grünwede présentation 発熱と頭痛" for i, (_, r) in enumerate(chains) if r in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251") and "�" not in rows[30 + i][1])
    assert back[200] == "Grünwede" and back[201] == "Møllevik" and back[202] == "発熱と頭痛"


def test_copies_weigh_nothing(spark):
    bad = garble("événement", "cp1252", "mac_roman")
    clean = [(i, f"Un événement rare, cas {i}") for i in range(6)]
    # A garbled title in a third of the rows; one garbled copy of a title that is repeated 40 times.
    hot = [(100 + i, f"Un {bad} rare") for i in range(60)] + [(200 + i, f"Texte {i}") for i in range(60)]
    again = [(300 + i, "Méthode générale") for i in range(40)] + [(400, garble("Méthode", "cp1252", "mac_roman") + " générale")]
    df = spark.createDataFrame(clean + hot + again, "id long, a string")
    expected = {*range(100, 160), 400}
    assert {r["id"] for r in find_garbled(df, "id", ("a",)).collect()} == expected
    back = {r["id"]: r["restored"] for r in restore_garbled(df, "id", ("a",)).collect()}
    assert back == {k: "Un événement rare" for k in range(100, 160)} | {400: "Méthode générale"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, a string")
    assert find_garbled(df, "id", ("a",)).count() == 0 and restore_garbled(df, "id", ("a",)).count() == 0
