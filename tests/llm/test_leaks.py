import numpy as np
import pytest

from spindrel.llm.leaks import LeakFinder, alike, leaks, letter
from spindrel.llm.page_text import fold, segments

PASSAGE = "No ferry in Gulldale has been so unexpectedly photographed as the bitter embankment beyond the petition. Why was the museum promptly opened by leaking inspectors, and who discussed the damaged charter outside Stonemere?"
WORDS = PASSAGE.split()


def found(text, x0=None, y0=None, **k):
    return LeakFinder([(7, PASSAGE)], **k).scan(text, x0 and np.array(x0), y0 and np.array(y0))


def test_sixteen_words_but_not_fifteen():
    for n, hit in ((15, False), (16, True)):
        got = found("Before. " + " ".join(WORDS[5 : 5 + n]) + " Afterwards nothing.")
        assert bool(got) == hit
        if hit:
            assert got[0][:2] == (7, 16)


def test_case_punctuation_and_misread_letters():
    t = " ".join(WORDS[2:22]).upper().replace(",", "").replace("O", "0", 2)
    assert found(t) and found("".join(t.lower().replace("m", "rn").replace("e", "c", 5)))
    assert found(" ".join(w if i % 6 else w[:2] + w[3:] for i, w in enumerate(WORDS[:24], 1)))


def test_broken_words_and_adverts():
    t = "Then no ferry in Gulldale has been so unexpec-\ntedly photographed as the bit¬\nNONE BETTER THAN KESTWELL SOAP\nBox 12, this paper\nter embankment beyond the petition. Why\nwas the museum promptly closed."
    got = found(t)
    assert got and got[0][1] >= 20 and t[got[0][2] : got[0][3]].startswith("no ferry") and t[: got[0][3]].endswith("the museum promptly")


def test_columns_in_mixed_order_and_joined():
    left, right = ["The council met and", "No ferry in Gulldale has been", "so unexpectedly photographed as"], ["the bitter embankment beyond the", "petition. Why was the museum", "promptly opened by others"]
    rows = [x for p in zip(left, right) for x in p]
    assert found("\n".join(rows), [50, 700] * 3, [100, 100, 120, 120, 140, 140])
    assert not found("\n".join(right + left))
    assert found("\n".join(right + left), [700] * 3 + [50] * 3, [100, 120, 140] * 2)
    assert found("\n".join(f"{a}   {b}" for a, b in zip(left, right)))


def test_other_words_break_the_run():
    other = WORDS[:10] + ["quickly"] + WORDS[10:21]
    assert not found(" ".join(other))
    swapped = WORDS[:12] + ["garden"] + WORDS[13:24]
    assert not found(" ".join(swapped))


def test_alike():
    assert alike("embonkrent", 0, "embankment") == 10 and alike("embnkment", 0, "embankment") == 9
    assert alike("station", 0, "viaduct") is None and alike("as", 0, "of") is None and alike("", 0, "abc") is None
    assert fold("Oxe-FORD, 5torn") == fold("0xeford Storn") and fold("closed") == fold("dosed") and fold("é—") == "e"


def test_reading_order_edges():
    assert segments("", None, None) == []
    assert segments("a\n\nb", np.array([1, 1]), np.array([1, 2])) == [(0, 1), (3, 4)]
    assert segments("a\nb", np.array([5, 5]), np.array([9, 2])) == [(2, 3), (0, 1)]


def test_on_spark(spark):
    shape = "doc_id long, text string, lines array<struct<line_no int, x0 int, y0 int, x1 int, y1 int, conf float>>, item_id int"
    text = "x " * 30_000 + PASSAGE
    docs = spark.createDataFrame([(1, text, None, 0), (1, text, [], 0), (2, None, None, 0), (3, "", [], 0), (None, PASSAGE, [(0, None, 1, 1, 1, 0.5)], 0), (4, "nothing of it", [(0, 1, 1, 1, 1, 0.5)], 0)], shape)
    items = spark.createDataFrame([(7, PASSAGE), (8, None), (None, PASSAGE), (9, ""), (10, "too short")], "item_id long, passage string")
    assert sorted(((r.doc_id or 0), r.item_id) for r in leaks(docs, items).collect()) == [(0, 7), (1, 7), (1, 7)]
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


def test_too_many_items(spark, monkeypatch):
    monkeypatch.setattr("spindrel.llm.leaks.MOST_ITEMS", 1)
    items = spark.createDataFrame([(7, PASSAGE), (8, "b")], "item_id long, passage string")
    with pytest.raises(ValueError):
        leaks(spark.createDataFrame([], "doc_id long, text string, lines array<struct<x0 int, y0 int>>"), items)


def test_offsets_are_those_of_the_passage():
    for before, after in (("", ""), ("Before this; ", " Afterwards nothing."), ("\n\n x ", "!!\nclosing"), ("rn cl ", "")):
        core = " ".join(WORDS[3:24])
        t = before + core + after
        (_, n, a, b), = found(t)
        assert n == 21 and t[a:b] == core.rstrip(",.?")


def test_letters_of_pairs():
    t = "a, cl-rn?b"
    assert [t[slice(*letter(t, 0, len(t), k))] for k in range(len(fold(t)))] == ["a", "cl", "rn", "b"]
