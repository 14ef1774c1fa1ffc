"""The kernel on texts of our own."""

import random

import pytest

from larkveil.kernel import bodies, checks, sse
from larkveil.kernel.hits import Hit
from larkveil.kernel.link import settle
from larkveil.kernel.pipeline import Detector, Entry, Leak, RestoreError, Session, leaks, restore, rewrite, union
from larkveil.kernel.terms import TermFinder
from larkveil.kernel.text import digits_of, normalized, one_spaced, same
from larkveil.plans.catalog import Settings, SettingsError, default_classes, layered
from larkveil.plans.relations import STREAM, STREAM_MAPPING

NAMES = {"word_lists": {"PERSON_FIRST_NAME": ["Anna", "Tom"], "PERSON_LAST_NAME": ["Keller", "Roth"], "CITY": ["Ulm"]}}


@pytest.fixture(scope="module")
def detector():
    return Detector(layered(NAMES))


def found(detector, text):
    return [(h.cls, text[h.start : h.end]) for h in detector.detect(text).hits]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("mail a.b@firma.de now", [("EMAIL", "a.b@firma.de")]),
        ("host 10.1.2.3 and 8.8.8.8", [("PRIVATE_IP", "10.1.2.3"), ("PUBLIC_IP", "8.8.8.8")]),
        ("see https://shop.example.com/api/x?sig=1&sv=2", [("SAS_TOKEN", "https://shop.example.com/api/x?sig=1&sv=2")]),
        ("postgres://u:p@db.local/main", [("DATABASE_CONNECTION_STRING", "postgres://u:p@db.local/main")]),
        ("Server=db1;Database=x;User Id=me;Password=pw", [("DATABASE_CONNECTION_STRING", "Server=db1;Database=x;User Id=me;Password=pw")]),
        ("Authorization: Bearer abcdefghijklmnopqrstuv", [("ACCESS_TOKEN", "abcdefghijklmnopqrstuv")]),
        ("kind: Secret\ndata:\n  a: eHh4\nother: 1", [("KUBERNETES_SECRET", "eHh4")]),
        ("Sehr geehrte Frau Dr. Keller", [("SALUTATION", "Frau"), ("ACADEMIC_TITLE", "Dr."), ("PERSON_LAST_NAME", "Keller")]),
        ("Anna Keller came", [("PERSON_FULL_NAME", "Anna Keller")]),
        ("Keller, Anna came", [("PERSON_FULL_NAME", "Keller, Anna")]),
        ("only Anna came", []),
        ("Kundennummer: K-4711", [("CUSTOMER_ID", "K-4711")]),
        ("customer no the", []),
        ("Lindenweg 5, 89073 Ulm", [("ADDRESS", "Lindenweg 5, 89073 Ulm")]),
        ("Diagnose: Asthma seit 2010. Mehr", [("HEALTH_INFORMATION", "Diagnose: Asthma seit 2010")]),
        ("born 31.12.1999", [("DATE_OF_BIRTH", "31.12.1999")]),
        ("on 31.12.1999", []),
        ("ISO-9001 and XY-9001", [("GENERIC_ID", "XY-9001")]),
        ("password: geheim12.", [("PASSWORD", "geheim12")]),
        ("folgt @some_one hier", [("SOCIAL_MEDIA_HANDLE", "@some_one")]),
        ("Muster GmbH liefert", [("ORGANIZATION_NAME", "Muster GmbH")]),
        ("aus Frankreich", [("COUNTRY", "Frankreich")]),
        ("", []),
    ],
)
def test_classes(detector, text, expected):
    assert found(detector, text) == expected


def test_word_must_stand_within_forty_characters(detector):
    assert found(detector, "born" + " " * 36 + "31.12.1999") == [("DATE_OF_BIRTH", "31.12.1999")]
    assert found(detector, "born" + " " * 41 + "31.12.1999") == []


def test_bare_name_joins_the_only_person(detector):
    r = detector.detect("Herr Tom Roth kam. Roth ging.")
    people = [h for h in r.hits if h.cls.startswith("PERSON")]
    assert len(people) == 2 and len({h.entity for h in people}) == 1 and all(h.attrs["gender"] == "male" for h in people)


def test_torn_gender():
    r = Detector(Settings()).detect("Frau Ida Roth und Herr Ida Roth")
    assert {h.attrs.get("gender_conflict") for h in r.hits if h.cls == "PERSON_FULL_NAME"} == {"true"}


def test_normalised_text_maps_back(detector):
    text = "Kundennummer: K­-47​11 Zoé"
    (h,) = detector.detect(text).hits
    assert text[h.start : h.end] == "K­-47​11"
    a = normalized("éx­ y")
    assert a.text == "éx y" and a.span(0, 1) == (0, 2)
    assert normalized("plain") is None and normalized("é") is None


def test_projections():
    assert one_spaced("a \n b").text == "a b" and digits_of("a1 b22").text == "122"
    assert same("  ＡB\tc ") == "ab c"


def brute_terms(text, terms):
    out, i = [], 0
    while i < len(text):
        best = 0
        if not (i and text[i - 1].isalnum()):
            for t in terms:
                e = i + len(t)
                if text[i:e].lower() == t.lower() and (e == len(text) or not text[e].isalnum()):
                    best = max(best, e)
        if best:
            out.append((i, best))
            i = best
        else:
            i += 1
    return out


def test_terms_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        terms = {"".join(rng.choice("ab ") for _ in range(rng.randint(1, 5))).strip() for _ in range(4)} - {""}
        text = "".join(rng.choice("abA .") for _ in range(40))
        assert [(s, e) for s, e, _ in TermFinder([(t, t) for t in terms]).find(text)] == brute_terms(text, terms)
    assert TermFinder([("Anna", "P")], ["P"]).find("Annas Annast") == [(0, 5, "P")]


def test_settled_findings_do_not_overlap_and_cover_what_was_covered():
    rng, settings = random.Random(5), Settings()
    names, stages = list(settings.classes), ("structured", "pattern", "dictionary", "context")
    for _ in range(300):
        hits = []
        for _ in range(rng.randint(0, 8)):
            s = rng.randint(0, 20)
            attrs = {"token": "<X_001>"} if rng.random() < 0.2 else {}
            hits.append(Hit(s, s + rng.randint(1, 10), rng.choice(names), rng.choice(stages), 0.9, attrs))
        covered = {i for h in hits for i in range(h.start, h.end)}
        out = settle(hits, settings)
        assert all(a.end <= b.start for a, b in zip(out, out[1:]))
        assert {i for h in out for i in range(h.start, h.end)} == covered


def test_rest_of_a_weaker_finding_stays():
    settings = Settings()
    out = settle([Hit(0, 10, "URL", "pattern", 0.9), Hit(4, 6, "PASSWORD", "pattern", 0.9)], settings)
    assert [(h.start, h.end, h.cls) for h in out] == [(0, 4, "URL"), (4, 6, "PASSWORD"), (6, 10, "URL")]


LETTER = "Sehr geehrte Frau Keller,\nIhre IBAN DE89 3704 0044 0532 0130 00, Mail keller@firma.de.\nGruss an Frau Keller und Herrn Roth."


def test_round_trip(detector):
    session = Session(detector)
    out, bad = session.pseudonymize(LETTER)
    assert bad == [] and "Keller" not in out and "<PERSON_FEMALE_001>" in out and "<PERSON_MALE_002>" in out
    assert restore(out, session.entries) == (LETTER, 5, [])


def test_session_goes_on(detector):
    s = Session(detector)
    first, _ = s.pseudonymize("Frau Keller, IBAN DE89 3704 0044 0532 0130 00")
    second, _ = s.pseudonymize("KELLER hat DE89370400440532013000 und Herr Roth")
    assert second == "<PERSON_FEMALE_001> hat <IBAN_001> und Herr <PERSON_MALE_002>"
    assert s.counters["PERSON"] == 2


def test_literal_tokens_are_reserved_and_unknown_ones_withhold(detector):
    r = detector.detect("Frau Keller")
    out, _ = rewrite("Frau Keller <PERSON_001>", detector.detect("Frau Keller <PERSON_001>"), detector.settings, {})
    assert out.startswith("Frau <PERSON_FEMALE_002>") and r.hits
    s = Session(detector)
    assert s.pseudonymize("Frau Keller <EMAIL_005>")[0] is None and s.entries == {} and s.counters == {}


def test_leaks(detector):
    entries = {"<PHONE_001>": Entry("PHONE", "0301234567"), "<P_001>": Entry("PERSON_LAST_NAME", "Roth")}
    kinds = {(x.kind, x.cls) for x in leaks("ruf 030 123 4567 an, ROTHS <Q_001>", entries, detector)}
    assert kinds == {("original_value", "PHONE"), ("original_value", "PERSON_LAST_NAME"), ("unknown_token", "")}
    assert leaks("ein <P_001>", entries, detector) == []
    assert leaks("an x@firma.de", {}, detector)[0] == Leak("residual_finding", "EMAIL", 3, 13)
    assert union([(0, 3), (2, 5), (5, 6)]) == [(0, 5), (5, 6)]


def test_restore_modes():
    entries = {"<P_001>": Entry("P", "Keller", ["Keller", "KELLER"])}
    assert restore("<P_001> <P_001> <P_001>", entries)[0] == "Keller KELLER Keller"
    assert restore("`P_001` '<p_001>' p_001 <Q_001>", entries, "lenient") == ("Keller KELLER p_001 <Q_001>", 2, ["<Q_001>"])
    with pytest.raises(RestoreError):
        restore("<Q_001>", entries)
    with pytest.raises(RestoreError):
        restore("", entries, "other")


def test_stream_at_every_cut():
    entries = {t: Entry("", v, f) for t, (v, f) in STREAM_MAPPING.items()}
    change = lambda t: restore(t, entries, "lenient")[0]
    whole = sse.StreamRestorer(change)
    expected = whole.feed(STREAM) + whole.finish()
    for i in range(len(STREAM)):
        m = sse.StreamRestorer(change)
        assert m.feed(STREAM[:i]) + sse.StreamRestorer(change, m.state()).feed(STREAM[i:]) == expected


def test_bodies():
    body = '{"messages":[{"role":"user","content":"hi"},{"role":"user","content":[{"type":"tool_use","input":{"a":["x",1]}}]}]}'
    assert bodies.rewrite_request(body, str.upper) == ('{"messages":[{"role":"user","content":"HI"},{"role":"user","content":[{"type":"tool_use","input":{"a":["X",1]}}]}]}', 2)
    assert bodies.rewrite_request("[1]", str.upper) is None
    once = bodies.rewrite_request(body, str, notice=True)[0]
    assert once.count(bodies.NOTICE_MARK) == 1 and bodies.rewrite_request(once, str, notice=True)[0] == once
    assert bodies.restore_response('{"content":[{"type":"text","text":"a"},{"type":"tool_use","input":"b"},{"type":"x","text":"c"}]}', str.upper) == '{"content":[{"type":"text","text":"A"},{"type":"tool_use","input":"B"},{"type":"x","text":"c"}]}'
    assert bodies.session_key({"X-Session-Key": " k "}, {}) == "k" and bodies.session_key({}, None) == "default"
    assert bodies.is_session_key("a.b-c") and not bodies.is_session_key("a/b")


def test_settings():
    classes = default_classes()
    assert len(classes) == 140 and sum(c.policy == "redact" for c in classes.values()) == 32
    s = layered({"classes": {"BADGE": {"category": "IDENTIFIER", "patterns": [r"\bB\d{4}\b"]}}}, {"classes": {"BADGE": {"policy": "redact"}, "FQDN": {"enabled": False}}, "dictionaries": {"CUSTOMER_NAME": ["Acme"]}})
    assert found(Detector(s), "B1234 shop.example.com Acmes") == [("BADGE", "B1234"), ("CUSTOMER_NAME", "Acmes")]
    assert s.fingerprint() != Settings().fingerprint() == layered({}).fingerprint()
    for bad in ({"nope": 1}, {"classes": {"X": {"category": "NO"}}}, {"min_confidence": 2}, {"restore": {"mode": "x"}}, {"classes": {"X": {"category": "URL", "patterns": ["("]}}}, {"dictionaries": {"NO": ["a"]}}):
        with pytest.raises(SettingsError):
            layered(bad)


def test_validators_disagree_with_changed_digits():
    assert checks.luhn("79927398713") and not any(checks.luhn(f"7992739871{d}") for d in "012456789")
    assert checks.iban("DE89370400440532013000") and not checks.iban("DE89370400440532013001")
    assert checks.ip_scope("fc00::1") == "private" and checks.ip_scope("2001:db8::1") == "public" and checks.ip_scope("x") is None


@pytest.mark.parametrize(
    "text, out",
    [
        ("Karte 4111111111111111 27.65.93.188 ab", "Karte <CREDIT_CARD_001> <PUBLIC_IP_001> ab"),
        ("27.65.93.188 4111111111111111 ab", "<PUBLIC_IP_001> <CREDIT_CARD_001>ab"),
        ("4111 1111 1111 1111 27.65.93.188, erst 4111111111111111, é​ 4111111111111111 27.65.93.188", "<CREDIT_CARD_001> <PUBLIC_IP_001>, erst <CREDIT_CARD_001>, é​ <CREDIT_CARD_001> <PUBLIC_IP_001>"),
    ],
)
def test_what_shows_once_its_neighbour_is_replaced(detector, text, out):
    s = Session(detector)
    assert s.pseudonymize(text) == (out, [])
    assert restore(out, s.entries)[0] == text
    assert s.pseudonymize(f"{text} und <EMAIL_005>")[0] is None  # other leaks still withhold a text


def test_a_text_that_stays_is_searched_once():
    class Counting(Detector):
        searched = 0

        def detect(self, *given):
            self.searched += 1
            return super().detect(*given)

    for text, n in (("nichts", 1), ("ein <EMAIL_005>", 1), ("an a@mail.example.com", 2), ("Karte 4111111111111111 27.65.93.188 ab", 4)):
        d = Counting(Settings())
        out, bad = Session(d).pseudonymize(text)
        assert d.searched == n and (out is None) == ("EMAIL_005" in text) == bool(bad)
