"""op2: base spans against the plain patterns, added spans on disguised cases."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwell.llm import private_data, queries, runtime

SF = "/root/testdata/sf0.01"


def brute(text):
    ok_card = lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0
    plain = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", ok_card),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    return [[m.span() for m in re.finditer(p, text) if ok(m[0])] for p, ok in plain]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab@@..-_ 0123456789+()é"), max_size=60))
def test_base_on_random_texts(text):
    assert private_data.find(text) == brute(text)


CASES = {
    "write to jane.doe [at] mail (dot) example [dot] com now": "email=jane.doe [at] mail (dot) example [dot] com",
    "write to jane_doe at mail dot example dot com now": "email=jane_doe at mail dot example dot com",
    "write to jane.doe(at)example.com now": "email=jane.doe(at)example.com",
    "jane7 at example.com": "email=jane7 at example.com",
    "jane dot doe at example dot org": "email=jane dot doe at example dot org",
    "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ": "email=ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ",
    "mail jаne@example.com": "email=jаne@example.com",  # a Cyrillic letter; base has ne@example.com
    "ja\u200bne@exam\u200bple.com": "email=ja\u200bne@exam\u200bple.com",
    "call plus one five five five zero one two three four five six now": "phone=plus one five five five zero one two three four five six",
    "call +1 five five five, zero one two 3456 now": "phone=+1 five five five, zero one two 3456",
    "host one nine two dot one six eight dot one dot two": "ip=one nine two dot one six eight dot one dot two",
    "card four one one one one one one one one one one one one one one one": "card=four one one one one one one one one one one one one one one one",
    "card ٤١١١ ١١١١ ١١١١ ١١١١": "card=٤١١١ ١١١١ ١١١١ ١١١١",
}
CLEAN = ["She looked at the dot on the map.", "one two three", "Meet at noon. dot com era.", "look at example.com for more", "one of two or three of the four", "Die Punkte sind null und nichtig.", "un point de vue", "a b­c d", "éàü ñ ß", "at at dot dot", "x at y dot", None, ""]


@pytest.mark.parametrize("text", list(CASES))
def test_disguises(text):
    base, more = private_data.all_spans(text)
    kind, want = CASES[text].split("=")
    found = [(k, text[a:b]) for k, own in zip(private_data.KINDS, private_data.disguised(text), strict=True) for a, b in own]
    assert found == [(kind, want)] and base == brute(text)


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert not any(map(any, private_data.all_spans(text or "")))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "dot", " at ", " dot ", "[at]", "(dot)", "@", ".", " ", "one", " two ", "five", "é", "​", "а", "1", "plus ", "-", "٣", "com"]), max_size=25))
def test_spans_lie_in_the_text(parts):
    text = "".join(parts)
    base, more = private_data.all_spans(text)
    assert base == brute(text)
    assert all(0 <= a < b <= len(text) for own in base + more for a, b in own)
    private_data.masked(text)


def test_long_texts_are_fast():
    for text in ("a" * 300_000, "1" * 200_000, "a." * 100_000 + "@", "1 " * 100_000, "+1" * 100_000, "@a" * 100_000, " at " * 50_000, " dot " * 50_000, "one " * 50_000, "1." * 100_000):
        private_data.all_spans(text)


def test_query(spark):
    texts = {r.doc_id: r.text for r in runtime.table(spark, SF, "documents").collect()}
    rows = queries.op2_private_data(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, own in zip(private_data.KINDS, base, strict=True) for a, b in own)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, base))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans == said


def test_rows_and_mask(spark):
    rows = [(1, None, "x", 0), (2, "", "x", 0), (3, "mail a@b.c or +1 (555) 123-4567 now", "x", 35), (3, "a [at] b [dot] com", "x", 18), (None, "clean", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    found = private_data.private_spans(docs).collect()
    assert len(found) == 5 and {r.spans for r in found} == {"", "email:5:10,phone:14:31", "email:0:18"}
    assert {r.text for r in private_data.mask(docs).collect()} == {None, "", "mail [EMAIL] or [PHONE] now", "[EMAIL]", "clean"}
    assert private_data.private_spans(docs.limit(0)).count() == 0 and private_data.mask(docs.limit(0)).columns == docs.columns


ALONE = ["max [klammeraffe] example.de", "jane {@} example.com", "jane <@> example.com", "jane [ @ ] example.com", "jane@example{.}com", "jane@example [ . ] com", "jane7 at  example.com", "jane7 at\nexample.com", "jane7\tat example.com", "jane7 AT example.com"]


@pytest.mark.parametrize("text", ALONE)
def test_disguises_need_nothing_else_in_the_text(text):
    _, alone = private_data.all_spans(text)
    _, behind = private_data.all_spans("a (dot) b, " + text)
    assert alone == [[(0, len(text))], [], [], []] and behind[0] == [(11, 11 + len(text))]


ALTERNATING = {
    "host 192 dot 168 dot 1 dot 20 is up": "ip=192 dot 168 dot 1 dot 20",
    "host 10.0 dot 0.7 is up": "ip=10.0 dot 0.7",
    "host 10.0.0.seven is up": "ip=10.0.0.seven",
    "call plus one 555 zero 123 four 567 now": "phone=plus one 555 zero 123 four 567",
    "call plus 1 555 123 4567 now": "phone=plus 1 555 123 4567",
    "call plus 15551234567 now": "phone=plus 15551234567",
    "call +1 (555) - (four five six)    1234 now": "phone=+1 (555) - (four five six)    1234",
    "card 4111 one 111 1111 1111 now": "card=4111 one 111 1111 1111",
}
NO_NUMBERS = ["host 192 dot 168 dot 1 dot 256", "host 192 dot 168 dot 1", "call plus one 555 zero", "card 4111 one 111 1111 1112", "call +1 555 123 4567 one more time", "call +1 555 123 4567, one more", "two +1 555 123 4567", "at 192.168.1.1 one of us", "five plus 300 or 5 plus one", "one 2 three"]


@pytest.mark.parametrize("text", list(ALTERNATING))
def test_numbers_between_written_ones(text):
    base, more = private_data.all_spans(text)
    kind, want = ALTERNATING[text].split("=")
    assert base == brute(text) and [(k, text[a:b]) for k, own in zip(private_data.KINDS, more, strict=True) for a, b in own] == [(kind, want)]


@pytest.mark.parametrize("text", NO_NUMBERS)
def test_number_words_that_are_prose(text):
    assert not any(private_data.all_spans(text)[1])


@pytest.mark.parametrize("unit", [" a9 at b dot com", " a dot b at c dot com", " x at", " one two", " a@b.co and c [at] d [dot] com,", " 555 O1O 12l4 55", "a dot ", " twenty-one"])
def test_time_is_linear(unit):
    took = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        private_data.all_spans(unit * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.5 and took[1] < 10


@pytest.mark.parametrize("text,kind,span", [
    ("write ιnfo@example.com", 0, (6, 22)), ("write ɑdmin@example.com", 0, (6, 23)), ("write ӏnfo@example.com", 0, (6, 22)), ("write ʙob@example.com", 0, (6, 21)),
    ("call +1 555 O1O l234 now", 3, (5, 20)), ("call plus one five five five twenty-one fifty five eleven now", 3, (5, 57)), ("max dot m at example dot com", 0, (0, 28)),
])
def test_more_disguises(text, kind, span):
    base, more = private_data.all_spans(text)
    assert span in more[kind] and span not in base[kind]


@pytest.mark.parametrize("text", ["Oil l0l IO 2020", "I o l I O o l I O l", "look at the dot on the map, ten to one", "twenty one pilots at eleven", "v1.O.2 l1 I0 O0"])
def test_prose_is_left_alone(text):
    assert private_data.all_spans(text) == ([[], [], [], []], [[], [], [], []])
