"""Personal data: the anchor parsers against the plain patterns."""

import random
import re

from cadastra.llm import pii

AUTOMATON = pii._automaton()


def brute(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 12 <= len(digits) <= 19 and sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for alphabet in ("a.@-1", "1.2 5", "+1 (2).-", "4 1-0", "a@.b+ 1é", "0123456789"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert [s for s in pii.find(text, AUTOMATON) if s[0] in pii.BASE] == brute(text), text
    for _ in range(3000):
        text = " ".join(rng.choice(["4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "x@y.z", "a.b@c-d.e.f", "+1 (555) 555-0100", "é", "+", "12", "1.2.3", "@"]) for _ in range(rng.randint(0, 8)))
        assert [s for s in pii.find(text, AUTOMATON) if s[0] in pii.BASE] == brute(text), text


def test_added_kinds():
    text = "IBAN GB82 WEST 1234 5698 7654 32 now, SSN: 078-05-1120; see ftp://joe:pw@host.org/x. Lives at 12 Elm Tree Street. account no 1234567. account of 12"
    found = {(k, text[a:b]) for k, a, b in pii.find(text, AUTOMATON) if k not in pii.BASE}
    assert found == {("account", "GB82 WEST 1234 5698 7654 32"), ("account", "078-05-1120"), ("login", "ftp://joe:pw@host.org/x"), ("address", "12 Elm Tree Street"), ("account", "1234567")}
    assert pii.masked("a x@y.z b", [("email", 2, 7)]) == "a [email] b"
    assert pii.masked("x 4111111111111111", [("card", 2, 18), ("account", 2, 18)]) == "x [card]"


def test_spellings():
    found = lambda text: [(k, text[a:b]) for k, a, b in pii.find(text, AUTOMATON) if k in ("account", "address")]
    for lead, number in (("Account Number: ", "12345678"), ("Passport No: ", "X1234567"), ("ACCOUNT NO ", "1234567"), ("Social Security Number: ", "123-45-6789"), ("SOCIAL SECURITY NO. ", "123-45-6789"),
                         ("social security ", "123-45-6789"), ("aCCount Nr. ", "1234567"), ("İ Passport Number ", "X1234567")):
        assert found(f"x {lead}{number} y") == [("account", number)]
    for place in ("12 Elm St", "7 Oak Tree Ave", "9 Long Rd", "1 Elm Blvd", "3 Hill Lane", "Hauptstraße 12", "Lindenweg 5a", "Berliner Str. 7", "12 rue de la Paix", "8 bis, avenue Victor Hugo", "Calle Mayor 12", "Avenida de América, 5"):
        assert found(f"x {place}, y") == [("address", place)], place
    for text in ("12 men stood still", "12 Elm streets", "the place Where 3", "auf dem weg 5", "in der straße 7", "une rue Longue", "calle sin nombre"):
        assert found(text) == [], text


def test_cues_of_four_languages_and_long_names():
    found = lambda text: [(k, text[a:b]) for k, a, b in pii.find(text, AUTOMATON) if k in ("account", "address")]
    for lead, number in (("Kontonummer: ", "12345678"), ("Konto-Nr. ", "12345678"), ("cuenta: ", "12345678901"), ("numéro de compte ", "12345678"), ("número de cuenta n.º ", "12345678"), ("SSN ", "123456789"),
                         ("passport ", "C01X00T47"), ("Reisepass Nr. ", "C01X00T47"), ("passeport n° ", "12AB34567"), ("Pasaporte: ", "XDB123456")):
        assert found(f"x {lead}{number} y") == [("account", number)], lead
    long = "Li" + "a" * 80
    for place in (f"12 {long} Street", "4 One Two Three Four Five Street", f"{long}straße 12", f"{long}-Berliner Platz 7"):
        assert found(f"x {place}, y") == [("address", place)], place
    for text in ("er kam auf das Konto der Firma", "sans compte 12", "passport CONTROL", "SSN 12345678", "SSN 123-456789", "la cuenta, por favor"):
        assert found(text) == [], text
    assert found("Street " * 20_000) == []


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a x@y.zz", 8, "s"), (2, None, None, None), (None, "", 0, "s"), (1, "a x@y.zz", 8, "s")], "doc_id bigint, text string, n_chars bigint, spans string")
    out = {(r.doc_id, r.n_email, r.spans) for r in pii.report(docs).collect()}
    assert out == {(1, 1, "email:2:8"), (2, 0, ""), (None, 0, "")}
    masked = sorted(map(tuple, pii.mask_texts(docs).collect()), key=str)
    assert masked == sorted([(1, "a [email]", 9, "s"), (1, "a [email]", 9, "s"), (2, None, None, None), (None, "", 0, "s")], key=str)
    assert pii.report(docs.limit(0)).count() == 0
