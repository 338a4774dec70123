"""Titles in a row and in capitals, apostrophes, later mentions of a name, and letter case of mail."""

import pytest

from walkframe.llm import pii


@pytest.fixture(scope="module")
def rewrite(spark):
    def run(*texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [(r.text, r.n_entities) for r in sorted(pii.with_surrogates(df, "k").collect())]

    return run


def test_titles(rewrite):
    texts = ["Herrn Dr. Müller kam", "so Mr Dr. Smith", "mit Frau Prof. Weiß da", "then MR. SMITH left", "for Mr. O'Brien only", "with Dr. Anna Smith here", "by Prof. Bob Jones now", "MRS ANNA O'BRIEN left"]
    heads = ["Herrn Dr. ", "so Mr Dr. ", "mit Frau Prof. ", "then MR. ", "for Mr. ", "with Dr. ", "by Prof. ", "MRS "]
    tails = [" kam", "", " da", " left", " only", " here", " now", " left"]
    for (got, n), text, head, tail in zip(rewrite(*texts), texts, heads, tails):
        assert n == 1 and got.startswith(head) and got.endswith(tail)
        old, new = (set(x[len(head) : len(x) - len(tail)].replace("-", " ").split()) for x in (text, got))
        assert not old & new and len(old) == len(new)
    upper = rewrite(texts[3], texts[7])
    assert upper[0][0][9:-5].isupper() and upper[1][0].isupper() is False and upper[1][0][4:-5].isupper()


def test_mentions(rewrite):
    text = "Mrs. Anna Smith came. Later Smith said no, and Anna Smith left. Anna stayed; Smithson too, smith not. See John.Doe@Corp.COM, Smith."
    (got, n), (alone, m) = rewrite(text, "Anna Smith, and Smith again")
    given, last = got.split()[1], got.split()[2]
    mail = got.split("See ")[1].split(", ")[0]
    assert got == f"Mrs. {given} {last} came. Later {last} said no, and {given} {last} left. Anna stayed; Smithson too, smith not. See {mail}, {last}."
    assert n == 6 and (alone, m) == ("Anna Smith, and Smith again", 0)  # nobody is found there
    box, host = mail.split("@")
    assert [c.isupper() for c in box[:8]] == [c.isupper() for c in "John.Doe"] and host != "Corp.COM"


def test_same_names_in_other_texts(rewrite):
    (a, _), (b, _) = rewrite("Mr. Bob Jones; Jones", "JONES and Ms. Jones, Jones")
    last = a.split()[2].rstrip(";")
    assert a.endswith(f"; {last}") and b == f"JONES and Ms. {last}, {last}"


def test_a_name_in_a_long_text(rewrite):
    (got, n), = rewrite("Mr. Smith. " + "Word Smith other " * 30_000)
    assert "Smith" not in got and n == 30_001
