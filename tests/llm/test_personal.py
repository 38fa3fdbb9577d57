"""Personal information in plain sentences of no test table, whole values, and what the labelers' estimates do."""

from __future__ import annotations

import pytest

from quaver.llm import personal

PLAIN = [
    ("Please phone Kwame Boateng tomorrow", "name", "Kwame Boateng"),
    ("Meeting with Siobhan Gallagher today", "name", "Siobhan Gallagher"),
    ("Yours, Fatoumata Diallo", "name", "Fatoumata Diallo"),
    ("Dear Ludwig van der Berg, we got it", "name", "Ludwig van der Berg"),
    ("He lives at 12 Rue de Rivoli, 75001 Paris", "address", "12 Rue de Rivoli, 75001 Paris"),
    ("Via Roma 12, 00100 Roma", "address", "Via Roma 12, 00100 Roma"),
    ("It is 1600 Pennsylvania Avenue NW, Washington, DC 20500, ask there", "address", "1600 Pennsylvania Avenue NW, Washington, DC 20500"),
    ("call 010-9158-2231 after six", "phone", "010-9158-2231"),
    ("tel. +81 3-1234-5678", "phone", "+81 3-1234-5678"),
    ("(+44 7700 900313) tested", "phone", "+44 7700 900313"),
    ("a" * 300 + "@example.org is long", "email", "a" * 300 + "@example.org"),
    ("write to jo dot doe at mail dot example please", "email", "jo dot doe at mail dot example"),
    ("SSN 078-05-1120 please delete", "id_number", "078-05-1120"),
]


def test_plain_sentences(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(PLAIN)], "doc_id long, text string")
    got = {(r.doc_id, r.kind, r.value) for r in personal.personal_values(df).collect()}
    assert {(k, kind, value) for k, (_, kind, value) in enumerate(PLAIN)} <= got


@pytest.mark.parametrize("text", ["2019-03-12 18:00", "192.168.0.1", "12345", "build 1.11.3", "96 = N 2 0", "The Wooden", "Nach dem"])
def test_no_candidates(text):
    assert personal.spans(text) == []


def test_values_are_not_cut_at_windows():
    street = "7 " + "Verylong" * 20 + " Street, Town ZX1 2AB"
    assert [t[1:3] for t in personal.spans("x " + street)] == [(2, 2 + len(street))]
    phone = "+44 20 7946 0813 ext. 12345"
    assert [phone[t[1] : t[2]] for t in personal.spans(phone)] == [phone]


def test_reliabilities():
    """A labeler that votes at random is found out, one that agrees with the rest is believed."""
    good, noise = (0, 1, 1, 0, 0, 0, 0, 0, 0, 0), (0, 0, 0, 1, 0, 0, 0, 0, 0, 0)
    other = (0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
    both = (0, 1, 1, 1, 0, 0, 0, 0, 0, 0)
    q = personal.reliabilities([(both, 50), (good, 50), (noise, 450), (other, 450)])
    assert q[good] > 0.95 and q[both] > 0.95 and q[other] < 0.05
    assert personal.reliabilities([]) == {}
    # a kind whose spans are all real stays whole
    assert min(personal.reliabilities([((1, 1, 0, 0, 0, 0, 0, 0, 0, 0), 90), ((1, 0, 0, 0, 0, 0, 0, 0, 0, 0), 10)]).values()) > 0.9


def test_contexts_are_learned(spark):
    """Names with unlisted given names are found where the corpus shows what their context means."""
    rows = [(k, f"The lane got a checkmark of {given} {'Barn' + chr(97 + k % 26) + 'well'} on site. Song Golden Bridge{chr(97 + k % 7)} is fine.") for k, given in enumerate(sorted(personal.GIVEN)[:60])]
    rows = [(k, t.replace(t.split()[6], t.split()[6].capitalize())) for k, t in rows]
    rows.append((1000, "The lane got a checkmark of Zorbina Barnqwell on site."))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.value) for r in personal.personal_values(df).collect()}
    assert (1000, "Zorbina Barnqwell") in got and not any("Golden" in v for _, v in got)
