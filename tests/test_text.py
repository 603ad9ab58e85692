import pytest

from veilspark.functions import registry
from veilspark.functions import text as one

BATCH = [
    "John Smith works at Acme Corp. His email is j.smith@acme.com and SSN 123-45-6789.",
    "Acme Corporation announced that John Smith will lead the new project. Contact: j.smith@acme.com.",
    "Reference: SSN 123-45-6789 confirmed for John Smith of Acme Corp.",
]


def brief(text, **options):
    return [(s.kind, s.text, round(s.score, 2)) for s in one.detect(text, **options)]


def test_batch_of_three():
    assert [brief(t) for t in BATCH] == [
        [("ORGANIZATION", "Acme Corp", 0.35), ("EMAIL_ADDRESS", "j.smith@acme.com", 1.0), ("US_SSN", "123-45-6789", 0.85)],
        [("ORGANIZATION", "Acme Corporation", 0.7), ("EMAIL_ADDRESS", "j.smith@acme.com", 1.0)],
        [("US_SSN", "123-45-6789", 0.85), ("ORGANIZATION", "Acme Corp", 0.7)],
    ]


def test_registry_is_complete():
    assert len(registry.PATTERNS) == 75 and len(registry.KINDS) == 29 and len(registry.TAGS) == 33 and len(registry.TYPES) == 33


@pytest.mark.parametrize("text", [None, "", " \n", "x", "é" * 3000, "1" * 5000, "(" * 500, "Name:\n\n\n\n", "by:", "\x00 +1"])
def test_odd_texts(text):
    one.detect(text)


def test_zones_miss_no_match():
    text = "a " * 200 + "DE12 3456 ABCD EFGH IJKL MNOP QRST 12 " + "b " * 90 + "+1 (499) 555-6503 and 4111-1111-1111-1111" + " c" * 70 + " 559038-\n" + " " * 200 + "9531"
    found = {(s.start, s.end, s.reason) for s in one.regex_spans(text)}
    for p in registry.PATTERNS:
        for m in registry.python(p.regex).finditer(text):
            if one.guarded(text, m.start(), m.end(), p.kind) == "keep":
                assert (m.start(), m.end(), f"pattern:{p.name}") in found


def test_ascii_boundaries():
    assert len(list(registry.python(r"\b4").finditer("é4x 4"))) == 2
    assert registry.python(r"a\sb").search("a b")


def test_spans_are_slices():
    text = 'Signed by See "Marta Brandt".\nCEO / Authorized Signatory: Edith Silva (acting), +1 (650) 555-0291\nsee also Zarvo Ltd as\nWitness:\n____\nPavel Okafor'
    for s in one.detect(text):
        assert text[s.start : s.end] == s.text
    assert {"Edith Silva", "Pavel Okafor"} <= {s.text for s in one.detect(text)}


def test_overlap_rule():
    s = lambda a, b, k, c: one.Span(a, b, k, c, "x", "t")
    assert one.without_overlaps([s(0, 5, "A", 0.5), s(3, 9, "B", 0.5)]) == [s(0, 5, "A", 0.5)]
    assert one.without_overlaps([s(0, 9, "A", 0.7), s(3, 5, "A", 0.85)]) == [s(0, 9, "A", 0.7)]
    assert one.without_overlaps([s(0, 9, "A", 0.7), s(3, 5, "A", 0.95)]) == [s(3, 5, "A", 0.95)]
    assert one.without_overlaps([s(0, 9, "A", 0.7), s(3, 5, "B", 0.75), s(6, 9, "C", 0.1)]) == [s(3, 5, "B", 0.75), s(6, 9, "C", 0.1)]


def test_model_hook_and_chunks():
    text = "word " * 1500 + "Marta Brandt lives here"
    windows = list(one.chunks(text))
    assert windows[0][0] == 0 and windows[-1][1] == len(text) and all(b - a <= 2500 for a, b in windows)
    assert all(c <= b for (_, b), (c, _) in zip(windows, windows[1:]))

    def model(part):
        at = part.find("Marta Brandt")
        return [(at, at + 12, "PERSON", 0.8)] if at >= 0 else []

    assert brief(text, model=model) == [("PERSON", "Marta Brandt", 0.8)]


def test_frequency_rule_is_an_option():
    text = "Witness: Marta Brandt\n" * 9
    assert brief(text) == [] and len(brief(text, most=None)) == 9


def test_snap_parts_lines():
    text = "at Harbour Road,\nLeeds now"
    out = one.snap(text, [one.Span(3, 22, "LOCATION", 0.6, "x", text[3:22])])
    assert [(s.text, text[s.start : s.end]) for s in out] == [("Harbour Road", "Harbour Road"), ("Leeds", "Leeds")]
