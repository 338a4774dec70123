"""Surrogates against what is known of documents that are made here, and patterns on very long texts."""

import random
import re

from walkframe.llm import pii


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def valid_iban(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def entities(rng):
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda k=6: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    yield "email", f"{word(rng.choice((1, 5)))}@{rng.choice(('corp', 'mail', 'x'))}.{rng.choice(('com', 'co.uk'))}"
    yield "email", f"{word(2)}.{word(3)}@{word(3)}.org"
    yield "phone", f"+1 {n(3)} {n(4)}"
    yield "phone", f"({n(3)}) {n(3)}-{n(4)}"
    yield "ssn", f"{n(3)}-{n(2)}-{n(4)}"
    yield "card", " ".join(n(4) for _ in range(4))
    yield "card", "4111111111111111"
    yield "ip", ".".join(str(rng.randrange(1, 250)) for _ in range(4))
    yield "credential", f"AKIA{word(16).upper()}"
    yield "credential", "".join(rng.choice("0123456789abcdef") for _ in range(40))
    yield "iban", "DE89 3704 0044 0532 0130 00"
    yield "iban", f"GB{n(2)}ABCD{n(14)}"
    yield "person", f"{rng.choice(('Mr.', 'Mrs.'))} {word(5).title()} {word(4).title()}"
    yield "person", f"г-жа {rng.choice(('Анна', 'Ольга'))} Иванова"


def shape(x):
    return re.sub(r"\d", "0", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", x)))


def test_documents_made_here(spark):
    rng = random.Random(11)
    docs = [[e for e in entities(rng) if rng.random() < 0.5] for _ in range(150)]
    docs = [of * rng.choice((1, 1, 2)) for of in docs]
    rows = [(i, "start | " + " | ".join(e for _, e in of) + " | end") for i, of in enumerate(docs)]
    got = {r.doc_id: r for r in pii.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    new: dict[tuple[str, str], str] = {}
    for i, of in enumerate(docs):
        parts = got[i].text.split(" | ")
        assert parts[0] == "start" and parts[-1] == "end" and len(parts) == len(of) + 2 and got[i].n_entities == len(of)
        for (kind, old), made in zip(of, parts[1:-1]):
            assert new.setdefault((kind, old), made) == made  # the same everywhere
    occurring = {old for _, old in new}
    assert len(set(new.values())) == len(new) and not occurring & set(new.values())
    for (kind, old), made in new.items():
        if kind in ("ssn", "card", "phone", "credential", "iban"):
            assert shape(made) == shape(old)
        if kind == "card":
            assert luhn(made.replace(" ", "")) or not luhn(old.replace(" ", ""))
        if kind == "iban":
            assert made[:2] == old[:2] and valid_iban(made) == valid_iban(old)
        if kind == "credential":
            assert made.startswith("AKIA") == old.startswith("AKIA") and (old.startswith("AKIA") or re.fullmatch("[0-9a-f]+", made))
        if kind == "phone" and old.startswith("+1"):
            assert made.startswith("+1 ")
        if kind == "person":
            assert made.split()[0] == old.split()[0] and (re.search("[а-я]", made) is not None) == (re.search("[а-я]", old) is not None)
            assert made.split()[1].endswith(("na", "на") if old.split()[0] in ("Mrs.", "г-жа") else "n")
    host = lambda x: x.partition("@")[2]
    hosts = {(host(old), host(made)) for (kind, old), made in new.items() if kind == "email"}
    assert len(hosts) == len({a for a, _ in hosts}) == len({b for _, b in hosts})


def test_many_of_a_small_format(spark):
    numbers = [f"+1 {i // 10_000:03d} {i % 10_000:04d}" for i in range(30_000)]
    boxes = [f"{chr(97 + i)}@host{k}.com" for i in range(26) for k in range(40)] + [f"{chr(97 + i)}{chr(97 + k)}@h.com" for i in range(26) for k in range(26)]
    full = [f"+99912{i:02d}" for i in range(100)] + [f"{chr(97 + i)}@z.org" for i in range(26)]
    asked = set(numbers + boxes + full)
    made = pii.replacements(spark.createDataFrame([(x,) for x in asked], "entity string"), "k").collect()
    assert len(made) == len(asked) == len({r.replacement for r in made}) and not asked & {r.replacement for r in made}


UNITS = ["b.", "1 ", "1-", "+1.", "+1 (2) 33 ", "ABCD ", "DE12 3456 ", "10.", "10.1.1.", "Mr ", "Mr. A-", "a@b.", "a@", "sk-", "AKIA", "a1_", "0123456789abcdef", "@", "ABCDEF0123", "Ж.", "(123) "]


def test_a_million_characters_of_each_alphabet(spark):
    rows = [(i, "x a@" + u * (1_000_000 // len(u)) + "com end me@corp.org") for i, u in enumerate(UNITS)]
    got = pii.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), "k").selectExpr("n_entities", "left(text, 2) a", "instr(text, 'me@corp.org') b").collect()
    assert len(got) == len(UNITS) and all(r.n_entities >= 1 and r.a == "x " and r.b == 0 for r in got)


def test_key_of_the_session(spark):
    df = spark.createDataFrame([(1, "mail me@corp.org")], "doc_id long, text string")
    text = lambda **k: pii.with_surrogates(df, **k).first().text
    assert text() == text() and text(key="a") == text(key="a") != text(key="b")
    assert len(spark.conf.get(pii.KEY)) >= 32
