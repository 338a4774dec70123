"""Phone numbers: what is shown is what was drawn and checked."""

import re

from walkframe.llm import pii


def shown(spark, numbers):
    df = spark.createDataFrame([(n,) for n in numbers], "entity string")
    return {r.entity: r.replacement for r in pii.replacements(df, "k").collect()}


def test_a_number_has_one_surrogate_in_all_layouts(spark):
    layouts = ["+1 017 555 7713", "+10175557713", "+1 (017) 555-7713", "+1.017.555.7713"], ["+44 20 7946 0958", "+442079460958"], ["+358 40 123 4567", "+358401234567"]
    got = shown(spark, sum(layouts, []))
    for code, same in zip(("1", "44", "358"), layouts):
        digits = {re.sub("[^0-9]", "", got[n]) for n in same}
        assert len(digits) == 1 and digits.pop().startswith(code)
        assert all(re.sub("[0-9]", "#", got[n]) == re.sub("[0-9]", "#", n) and got[n] != n for n in same)


def test_short_numbers_stay_distinct_as_shown(spark):
    numbers = [f"+1 {i % 10}{i // 10 % 10} {i // 100}{i % 7}" for i in range(900)]
    got = shown(spark, numbers)
    assert len(set(got.values())) == len(got) == len(set(numbers)) and not set(got.values()) & set(numbers)
