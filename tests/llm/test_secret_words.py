import random

from loomspan.llm import secrets


def test_every_sensitive_word_counts():
    """A word within the candidate of an earlier one still announces what follows it."""
    for text in (
        "# auth settings for the billing service below\nclient_secret_value: Zk39qLw82TnXv71RpD0s",
        "token ---------------------------auth------------------------- Zk39qLw82TnXv71RpD0s",
    ):
        a = text.index("Zk39")
        assert (a, 3, a + 20) in secrets.novel_spans(text, []), text


def test_spans_of_one_run_do_not_overlap():
    text = "auth Zk39qLw82TnXv71RpD0stokenQm47sVb90KjYd62Wc3Hfx"
    spans = secrets.novel_spans(text, [])
    assert len(spans) == 1 and spans[0][2] == len(text)


def test_spans_equal_brute_force():
    """Every candidate near every sensitive word, each extended to the end of its run, and of overlapping ones the first."""
    rng = random.Random(4)
    parts = ["auth", "token", "secret", "pwd", " ", " ", "\n", "a_long_identifier_here", "-" * 20, "Zk39qLw82TnXv71RpD0s", "Qm47sVb90KjYd62Wc3Hf", "words in between"]
    some = 0
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        all_ = set()
        for m in secrets.SENSITIVE.finditer(text):
            for c in secrets.CANDIDATE.finditer(text, m.end()):
                if c.start() - m.end() <= secrets.NEAR and secrets.is_novel(text, *c.span()):
                    all_.add(c.span())
        out, end = [], 0
        for a, b in sorted(all_):
            if a >= end:
                out.append((a, 3, b))
                end = b
        assert secrets.novel_spans(text, []) == out, text
        some += len(out)
    assert some > 100


def test_keys_of_one_case_and_without_digits_are_measured():
    for key in ("QWKZJXVBPMTHRDGC", "kzqxwvjpbtmhrfgd", "KZQ2XWVJPBTMHRFG", "qkzxwvjpbt7mhrfg"):
        assert secrets.novel_spans(f"my bearer is {key} ok", []) == [(13, 3, 29)], key
    assert secrets.novel_spans("the secret ingredient is internationalisation yes", []) == []


CONTEXTS = ("my bearer is {} ok", "auth header {} was sent", "auth: {}", "the credential is {}", 'signing_key = "{}"\n', "export SERVICE_TOKEN={}\nexport PORT=80", "login with user bob and secret {} please", "private key\n{}\nend of it")
LONG = "The team agreed last week that the new client token would be {} until the end of the next month, and all were told."


def test_strings_are_found_whatever_stands_around_them():
    """Of random strings 90 of 100 at least, in each of ten contexts; README states the figures."""
    rng = random.Random(9)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = {"base32": (letters.upper() + "234567", 16), "letters and digits": (letters + digits, 16), "letters": (letters + letters.upper(), 24), "base64": (letters + letters.upper() + digits + "+/", 32), "both cases and digits": (letters + letters.upper() + digits, 16)}
    for name, (alphabet, n) in kinds.items():
        for shown in (*CONTEXTS, LONG, LONG.replace("client token", "password of the service")):
            found = 0
            for _ in range(100):
                key = "".join(rng.choice(alphabet) for _ in range(n))
                text = shown.format(key)
                sure = secrets.base_spans(text)
                hit = [*((a, b) for a, _, b in sure), *((a, b) for a, _, b in secrets.novel_spans(text, sure))]
                found += any(a <= text.index(key) and b >= text.index(key) + n for a, b in hit)
            assert found >= 90, (name, shown, found)


def test_words_are_left_alone():
    for word in ("internationalisation", "responsibilities", "telecommunications", "anticonstitutionnellement", "Unternehmensberatungen", "authentication", "Telecommunications"):
        for shown in (*CONTEXTS, LONG):
            text = shown.format(word)
            assert secrets.novel_spans(text, secrets.base_spans(text)) == [], (word, shown)


def test_sure_spans_are_not_reported_twice():
    text = "token=Zk39qLw82TnXv71RpD0s and auth Qm47sVb90KjYd62Wc3Hf"
    assert secrets.novel_spans(text, [(0, 0, 26)]) == [(36, 3, 56)]
    many = [(k * 30, 0, k * 30 + 26) for k in range(400)]
    text = "token=Zk39qLw82TnXv71RpD0s and" * 400
    assert secrets.novel_spans(text, many) == []
