import random
import re

import pytest

from tracelake.llm import pii


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 12, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return sorted(out)


def test_plain_spans_equal_the_patterns():
    pick = random.Random(6)
    signs = ["a", "b@", "@", ".", "-", "_", "1", "2", "255", "0", " ", "+", "(", ")", "é", "c.d", "12.3.", "4111 1111", "+1 "]
    for _ in range(8000):
        text = "".join(pick.choice(signs) for _ in range(pick.randrange(25)))
        assert sorted(pii.detect(text)) == plain(text)


@pytest.mark.parametrize(
    "text, kind, source",
    [
        ("mail jane dot roe at example dot com today", "email", "jane dot roe at example dot com"),
        ("jane (at) mail [dot] example [dot] org", "email", "jane (at) mail [dot] example [dot] org"),
        ("see jane＠example．com.", "email", "jane＠example．com."[:-1]),
        ("јane@ехample.com", "email", "јane@ехample.com"),
        ("ring plus one four one five five five five two six seven one", "phone", "plus one four one five five five five two six seven one"),
        ("mail jane.roe at example.com today", "email", "jane.roe at example.com"),
        ("host one nine two dot one six eight dot one dot nine up", "ip", "one nine two dot one six eight dot one dot nine"),
        ("at 10 dot 0 dot 0 dot 7 now", "ip", "10 dot 0 dot 0 dot 7"),
        ("card ４１１１ 1111 1111 1111!", "card", "４１１１ 1111 1111 1111"),
        ("j​ane@exam­ple.org", "email", "j​ane@exam­ple.org"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    _, added = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in added] == [(kind, source)]


def test_clean_text_is_left_alone():
    for text in ("We met at the door and look at one another.", "Point one: the dot at the end.", "Look at example.com for more.", "È già là; œuvre été", "1 2 3 at four"):
        assert pii.find(text) == ([], []) and pii.redacted(text, []) == text


def test_plain_spans_stay_and_long_texts_end():
    text = "a@b.co and c at d dot com"
    found, added = pii.find(text)
    assert found == [("email", 0, 6)] and [text[a:b] for _, a, b in added] == ["c at d dot com"]
    for long in ("a" * 200000, "1 " * 100000, "@a" * 50000, "1.1." * 30000, "9" * 10000 + ".1.1.1"):
        pii.find(long)


def test_frame(make_docs):
    texts = [(1, "x a@b.co y"), (2, None), (3, ""), (1, "x a@b.co y"), (None, "+1 (555) 123-4567")]
    got = pii.find_spans(make_docs(texts), ["doc_id", "score"]).collect()
    assert [[(s.kind, s.start, s.stop, s.plain) for s in r.spans] for r in got] == [[("email", 2, 8, True)], [], [], [("email", 2, 8, True)], [("phone", 0, 17, True)]]
    cleaned = [r.text for r in pii.redact(make_docs(texts)).collect()]
    assert cleaned == ["x [EMAIL] y", None, "", "x [EMAIL] y", "[PHONE]"]
    assert pii.redact(make_docs([])).count() == 0


@pytest.mark.parametrize(
    "text, source",
    [
        ("mail jane dot roe at example.com today", "jane dot roe at example.com"),
        ("jane [dot] m [dot] roe at mail.example.org", "jane [dot] m [dot] roe at mail.example.org"),
        ("to jane four two at example.com!", "four two at example.com"),
        ("mail jane.roe at firma.ch now", "jane.roe at firma.ch"),
        ("mail jane.roe at example.co.uk, please", "jane.roe at example.co.uk"),
        ("mail jane_roe at mail.example.museum.", "jane_roe at mail.example.museum"),
        ("joe at mail.example dot com", "joe at mail.example dot com"),
        ("joe at a.b.example dot co.uk", "joe at a.b.example dot co.uk"),
        ("joe at mail.example (dot) com", "joe at mail.example (dot) com"),
    ],
)
def test_disguised_addresses_in_mixed_forms(text, source):
    _, added = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in added] == [("email", source)]


def test_words_at_a_place_are_no_address():
    for text in ("The one at example.com is new.", "Look at firma.ch for more.", "No one at mail.example.co.uk knows.", "jane.roe at home. Then", "Nobody. Jane at example.ch"):
        assert pii.find(text) == ([], [])
    for long in ("a dot " * 50000 + "b at x.ch", "a.b at " * 30000, "a.b at " + "x." * 100000, "a.b at " + "x" * 200000, "one " * 50000 + "at x.ch"):
        pii.find(long)
