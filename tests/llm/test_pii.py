import re

import pytest
from pyspark.sql import functions as F

from lorebase.llm import pii


def luhn(x):
    total = 0
    for i, c in enumerate(reversed(x)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for order, kind in enumerate(pii.KINDS):
        for m in re.finditer(pii.PLAIN[kind], text or "", re.A):
            v = m.group()
            d = re.sub("[^0-9]", "", v)
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}
            if good[kind]:
                out.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def result(df):
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return sorted(((r[0], r[1]) for r in df.select("doc_id", pii.span_text(base)).collect()), key=repr)


CASES = [
    "a@b.co, é.x+1@d-e.f.g! a@b a@b..c @x.y a@b@c.de", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1111 4111111111111112",
    "+1 (234) 555-6789 +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 ++49 30 1234567", "\U0001f600 über@x.de \U0001f600 10.0.0.1", "1" * 400, "9 " * 300, "a.b" * 300 + "@x.org", "x" * 5000 + "@" + "y.z" * 200,
    "1.1.1.1 " * 400, "",
]


def test_base_spans(frame, odd):
    rows = list(enumerate(CASES)) + [(None, CASES[0]), (1, CASES[1])]
    assert result(pii.find_personal_data(frame(rows))) == sorted(((d, brute(t)) for d, t in rows), key=repr)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(pii.find_personal_data(odd)) == sorted(((d, brute(t)) for d, t in rows), key=repr)
    assert pii.find_personal_data(frame([])).count() == 0


def test_terms_that_name_an_entity(frame):
    rows = [(k, f"note {k} from zebrafish{k} says redfox writes to kim@mail.org about case{k}") for k in range(6)]
    rows += [(k, f"text {k} about other things says nothing") for k in range(10, 40)] + [(50, "(Redfox) was here, says one")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(frame(rows)).collect()}
    words = {r["text"][s["start"] : s["end"]].lower() for r in got.values() for s in r["spans"] if s["kind"] == "term"}
    assert "redfox" in words and "says" not in words and not any(w.startswith("zebra") for w in words)
    assert [(s["start"], s["end"]) for s in got[50]["spans"]] == [(1, 7)]
    assert all(not r["spans"] for d, r in got.items() if 10 <= d < 40)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(pii.find_personal_data(frame(rows))).collect()}
    assert clean[50] == "([word]) was here, says one" and "kim@" not in clean[0] and "[email]" in clean[0]


def test_copies_prove_nothing(frame):
    rows = [(k, "the very same words around kim@mail.org in every copy") for k in range(8)]
    assert all(len(r["spans"]) == 1 for r in pii.find_personal_data(frame(rows)).collect())


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 1000])
def test_places_of_many_matches(frame, n):
    text = "é1.1.1.1ü" * n
    assert result(pii.find_personal_data(frame([(1, text)]))) == [(1, brute(text))]


def test_numbers_do_not_end_the_surroundings(frame):
    names = ["ada", "bob", "cyd", "dee", "eve", "fay"]
    rows = [(k, f"{n} redfox paid 17 orders with 4111 1111 1111 1111 in 2024 via bluejay {n}") for k, n in enumerate(names)]
    rows += [(k, f"text {k} about other things") for k in range(10, 40)]
    got = pii.find_personal_data(frame(rows)).collect()
    words = {r["text"][s["start"] : s["end"]] for r in got for s in r["spans"] if s["kind"] == "term"}
    assert {"redfox", "bluejay"} <= words


def test_surroundings_are_the_text_within_reach(frame):
    texts = ["é" * a + " 10 a@b.co " + "\U0001f600" * 300 + " 10.0.0.1\n" + "x 12 " * b for a in (0, 79, 255, 600) for b in (0, 16, 400)]
    for r in pii.base_spans(frame(list(enumerate(texts))).select("doc_id", "text")).collect():
        for s in r["spans"]:
            assert s["before"] == r["text"][max(s["start"] - pii.REACH - 1, 0) : s["start"]]
            assert s["after"] == r["text"][s["end"] : s["end"] + pii.REACH + 1]


def test_short_words_and_numbers_disclose(frame):
    places = ["from a river", "near the wood", "by that hill", "at one shore", "in our park", "on its isle"]
    rows = [(k, f"note {k} {p} says Ann 李明 7731 of kim@mail.org") for k, p in enumerate(places)]
    rows += [(k, f"text {k} says of other things") for k in range(10, 40)] + [(50, "(Ann) says 李明 has badge 7731, of old --")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(frame(rows)).collect()}
    words = [got[50]["text"][s["start"] : s["end"]] for s in got[50]["spans"]]
    assert words == ["Ann", "李明", "7731"]
