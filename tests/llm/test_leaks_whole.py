"""Leaks of passages that many items share, and of passages broken by many foreign lines."""

from spindrel.llm.leaks import LeakFinder
from test_leaks import PASSAGE, WORDS, found


def test_a_passage_in_many_items_is_found_for_each():
    finder = LeakFinder([(i, PASSAGE) for i in range(6)] + [(9, PASSAGE + " Nobody knew.")])
    assert sorted(r[0] for r in finder.scan("Before. " + PASSAGE)) == [0, 1, 2, 3, 4, 5, 9]


def test_stretches_shared_by_near_copies_are_kept():
    finder = LeakFinder([(i, f"Suite {i} asks this. {PASSAGE}") for i in range(8)])
    assert sorted(r[0] for r in finder.scan("Before. " + " ".join(WORDS[3:25]))) == list(range(8))


def test_any_number_of_foreign_lines():
    for n in (14, 15, 60):
        got = found("\n".join([" ".join(WORDS[:10]), *["SOAP of the best kind"] * n, " ".join(WORDS[10:22])]))
        assert got and got[0][1] == 22
