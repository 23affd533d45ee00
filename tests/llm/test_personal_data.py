"""Base spans against plain expressions, discovery on planted identifiers, edge cases."""

import hashlib
import random
import re

from leafgate.llm import pii
from tests.llm.conftest import rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    back = [int(c) for c in digits[::-1]]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def texts(n, longest, seed=5):
    rng = random.Random(seed)
    parts = ["a", "1", "22", "255", "256", "007", ".", "@", "_", "-", " ", "+", "(", "é", "4111111111111111", "b.c", "\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_base_spans_equal_the_plain_expressions():
    for t in texts(20_000, 25):
        assert pii.base_spans(t) == brute(t), t


def test_very_long_texts_are_read_whole_and_once():
    assert pii.base_spans("1.2.3." + "0" * 5000) == [(0, 1, 5006)]
    assert pii.base_spans("1.2.3." + "9" * 5000) == []
    for t in ("7" * 1_000_000, "a" * 1_000_000 + "1", "@" * 1_000_000, "a@" * 300_000, "1-" * 300_000, "+1" + "(" * 500_000, "x=" * 300_000 + "1234"):
        base = pii.base_spans(t + " z.9@x.org")
        assert base[-1] == (len(t) + 1, 0, len(t) + 10)
        for a, b in pii.candidates(t, [(a, b) for a, _, b in base]):
            pii.patterns(t, a, b)


def test_query_equals_brute_force(make):
    said = texts(200, 40)
    docs = make(*enumerate(said), (900, None), (901, ""), (None, "me@x.org"), (902, said[3]), (902, said[3]))
    out = pii.personal_data(docs).collect()
    assert len(out) == 205
    known = {**dict(enumerate(said)), 900: "", 901: "", None: "me@x.org", 902: said[3]}
    for r in out:
        base = brute(known[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(o == i for _, o, _ in base) for i in range(4)]
        line = ",".join(f"{pii.KINDS[o]}:{a}:{b}" for a, o, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


def planted():
    """Seeds in one context, identifiers without a form in the same one, and numbers elsewhere."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    line = lambda x: " ".join([*(word() for _ in range(12)), x, *(word() for _ in range(12))])
    docs, hidden, plain = [], set(), set()
    for i in range(40):
        docs.append((i, line(f"Call me on: +1 (555) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}")))
    for i in range(40, 60):
        own = f"ext{rng.randint(10_000, 99_999)}"
        hidden.add(own)
        docs.append((i, line(f"call me on: {own}")))
    for i in range(60, 160):
        own = str(rng.randint(100_000, 999_999))
        plain.add(own)
        docs.append((i, line(own)))
    return docs, hidden, plain


def test_contexts_of_seeds_discover_identifiers_without_a_form(make):
    docs, hidden, plain = planted()
    found = pii.discovered(pii.occurrences(make(*docs))).collect()
    right = {r["surface"] for r in found if r["kind"] == "phone"} & hidden
    assert right == hidden  # all of them
    assert {r["surface"] for r in found} - hidden == set()  # and nothing else: precision 1
    out = {r["doc_id"]: r for r in pii.personal_data(make(*docs)).collect()}
    for i, text in docs:
        own = [x for x in hidden if x in text]
        a = text.find(own[0]) if own else 0
        assert out[i]["spans"] == (f"phone:{a}:{a + len(own[0])}" if own else ",".join(f"phone:{a}:{b}" for a, _, b in pii.base_spans(text)))
        assert out[i]["n_discovered"] == len(own) and out[i]["n_phone"] == (i < 40)


def test_secrets_seed_their_own_kind(make):
    rng = random.Random(2)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    docs = [(i, f'so api_key = "{key(40)}" it is') for i in range(20)] + [(i, f"so API_KEY={key(17)}z it is") for i in range(20, 26)]
    docs += [(30, "1234567890" * 4), (31, "AKIA" + "A1" * 8)]
    out = {r["doc_id"]: r["spans"] for r in pii.personal_data(make(*docs)).collect()}
    for i, t in docs[:26]:
        a, b = re.search("[0-9a-fz]{18,}", t).span()
        assert out[i] == f"secret:{a}:{b}"
    assert out[30] == "" and out[31] == "secret:0:20"


def test_a_tie_of_two_kinds_goes_to_the_first(make):
    docs = []
    for i in range(30):
        docs += [(2 * i, f"reach us at {i}x@mail.org or so"), (2 * i + 1, f"dial the desk at +1 555 123 {4000 + i} or so")]
    docs.append((100, "us at a1234 then the desk at a1234 then"))
    found = pii.discovered(pii.occurrences(make(*docs)), min_score=0.1).where("surface = 'a1234'").collect()
    assert [r["kind"] for r in found] == ["email"]


def test_redacted_passes_columns_on_whatever_their_names(spark):
    docs = spark.createDataFrame([(1, "mail me@x.org now", 5, "k"), (2, None, 6, "k"), (2, "", 7, None)], "doc_id long, text string, spans long, `__key` string")
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    assert rows(out, *docs.columns) == [(1, "mail [EMAIL] now", 5, "k"), (2, "", 7, None), (2, None, 6, "k")]
    assert pii.redacted(docs.limit(0)).count() == 0 and pii.personal_data(docs.limit(0)).count() == 0
