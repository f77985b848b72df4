"""Leaked passages in many settings, short quotations, shared wording, odd tables."""

import random

import pytest

from casemill.llm.leaks import ItemIndex, edit_distance, find_leaks, normal

ITEMS = [
    (1, "At 54 a seamstress in Dol-Amren develops yellow sclerae 35 days after a cave survey. Examiners record yellow sclerae, bradycardia and burning soles at hour 60. Her brother sold pelts near Coquelard until week 52."),
    (2, "At 31 a ferry pilot in Nashiroba develops torpor 7 days after bathing in a weir. Examiners record torpor, bradycardia and orthostatic collapse at hour 96. What should be told to household contacts aged under 96?"),
    (3, "Un vidriero de Nashiroba presenta tremor 40 días después de desollar liebres. El equipo anota tremor, mareo y náuseas en la hora 90, y su hermano vive en Orvelund hasta la semana 3."),
    (4, "short item"), (5, None), (6, ""),
]
NOISE = "The family also reported contact with a flooded cellar. Supportive care was sufficient and the patient recovered well in the end. "


@pytest.fixture(scope="module")
def index():
    return ItemIndex([i for i in ITEMS if i[1]])


def leaked(index, text):
    return sorted(i for i, _ in index.search([text])[0])


def typos(text, every):
    rng, words = random.Random(1), text.split(" ")
    for i in range(3, len(words), every):
        w = words[i]
        if len(w) > 4:
            k = rng.randint(1, len(w) - 2)
            words[i] = w[:k] + w[k + 1] + w[k] + w[k + 2 :]
    return " ".join(words)


A = ITEMS[0][1]
SETTINGS = [
    A, A.upper(), A.replace(" ", "\n"), A.replace(".", "").replace(",", ""), "<p>" + A.replace("yellow", "<b>yellow</b>").replace(" ", "&nbsp;") + "</p>", A.replace("e", "е").replace("o", "о"),
    "​".join(A.split("e")[0]) + A[A.index("e") :], A.replace("sclerae", "scle­rae"), typos(A, 5), A.replace("develops", "shows").replace("record", "note"),
    A[:90] + NOISE[:60] + A[90:], "> " + A.replace(". ", ".\n> "), A.translate({c: c + 0xFEE0 for c in range(0x21, 0x7F)}), " ".join(A.split()[5:22]),
]


@pytest.mark.parametrize("passage", SETTINGS)
def test_found_in_every_setting(index, passage):
    assert leaked(index, NOISE * 3 + passage + " " + NOISE) == [1]


def test_escaped_json(index):
    import json

    assert leaked(index, NOISE + json.dumps({"q": ITEMS[2][1]})) == [3]


def test_what_is_no_case(index):
    for text in (NOISE * 20, "Compare “yellow sclerae, bradycardia and burning soles” here. " + NOISE, "Examiners record torpor, bradycardia and", "short", "", "  ", None, A[:40]):
        assert leaked(index, text) == []


def test_several_items_in_one_document(index):
    assert leaked(index, NOISE + ITEMS[1][1] + NOISE + ITEMS[2][1] + NOISE + A) == [1, 2, 3]


def test_shared_wording_is_no_case():
    shared = "which single step limits the named complaint before the day on which the contact was last seen by staff "
    index = ItemIndex([(1, shared + "alpha bravo charlie delta echo"), (2, shared + "quebec romeo sierra tango uniform")])
    assert leaked(index, NOISE + shared + NOISE) == []
    assert leaked(index, NOISE + shared + "alpha bravo charlie delta echo " + NOISE) == [1]


def test_passage_behind_many_better_fragments():
    phrase = "extraordinarily complicated haemorrhagic manifestations notwithstanding continuously administered intravenous electrolyte replacement"
    middle = " whereas neighbouring settlements remained unaffected throughout the monsoon quarter and later "
    passage = "he was at the ford by six and had a cup of red tea with two men"
    index = ItemIndex([(1, phrase + middle + passage)])
    for times in (1, 30):
        assert leaked(index, (phrase + " qq ") * times + NOISE * 6 + passage + ". " + NOISE) == [1]
    assert leaked(index, (phrase + " qq ") * 30 + NOISE * 6) == []


def test_very_long_document(index):
    assert leaked(index, NOISE * 8000 + A + NOISE * 8000) == [1]


PIECES = ITEMS[1][1].split()
FILL = ("Reposting the minutes of the allotment society with its rota and the lending list of the tool shed for members who could not come. " * 4)[:376]
INTERRUPTED = [" ".join(PIECES[:24][a : a + 6]) for a in range(0, 24, 6)]


@pytest.mark.parametrize("size", [1_000, 20_000, 300_000])
def test_a_passage_is_found_alike_at_every_place_of_documents_of_every_length(index, size):
    """Four pieces of six words with 376 characters in between: the same words are reported wherever it stands."""
    passage = f" {FILL} ".join(INTERRUPTED)
    alone = index.search(["zzz " + passage + " zzz"])[0]
    assert [i for i, _ in alone] == [2] and alone[0][1] >= 23
    pad = NOISE * (size // len(NOISE) + 1)
    texts = [pad[:at] + " zzz " + passage + " zzz " + pad[at:size] for at in range(0, size, max(1, size // 12))]
    assert [index.search([t])[0] for t in texts] == [alone] * len(texts)


def test_slices_of_the_text_do_not_show(index, monkeypatch):
    from casemill.llm import leaks

    pad = NOISE * 500
    texts = [pad[:at] + A + pad[at:] + ITEMS[1][1] for at in range(0, len(pad), 3001)]
    whole = index.search(texts)
    monkeypatch.setattr(leaks, "CELLS", 1)
    assert index.search(texts) == whole and all(len(w) == 2 for w in whole)


def test_whole_items_count_at_any_length():
    twelve = "which vector carries the agent of the eastern fever in the delta"
    index = ItemIndex([(1, twelve), (2, "name the reservoir"), (3, "発熱と頭痛を訴えた患者の渡航歴を確認すべきか"), (4, "ab c")])
    assert leaked(index, NOISE + twelve + "? " + NOISE) == [1] and leaked(index, " ".join(twelve.split()[:11]) + " " + NOISE) == []
    assert leaked(index, "Name the reservoir!") == [2] and leaked(index, NOISE + "発熱と頭痛を訴えた患者の渡航歴を確認すべきか。") == [3] and leaked(index, "ab c") == []


def test_scattered_edits_within_the_budget(index):
    words = A.split()[3:20]
    text = " ".join(words)
    for i in range(7, len(text), 17):
        text = text[:i] + "q" + text[i + 1 :]
    assert leaked(index, NOISE + text + ". " + NOISE) == [1]


def test_edit_distance():
    def plain(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j - 1] + (x != y), prev[j] + 1, row[j - 1] + 1))
            prev = row
        return prev[-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(1, 70))) for _ in range(2))
        assert edit_distance(a, b) == plain(a, b)


def test_normal_form():
    assert normal("Ünï<b>t</b> \\u00e9 &amp; ＡＢ") == "unit e & ab"


def test_tables(spark):
    docs = spark.createDataFrame([(1, NOISE + A, 9), (2, None, 9), (3, "", 9), (4, NOISE + A, 9), (4, NOISE + A, 9), (None, A, 9)], "doc_id long, text string, words int")
    items = spark.createDataFrame(ITEMS, "item_id long, item_text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect()), key=str)
    assert got == [(1, 1), (4, 1), (None, 1)]
    assert sorted(((r["doc_id"], r["item_id"]) for r in find_leaks(docs, items, block_chars=200).collect()), key=str) == got
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0
