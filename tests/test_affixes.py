"""Affix rules: the tries against every rule tried on every stem."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from galvan.functions import affixes

AFF = """# comment
SET UTF-8
FLAG long
PFX p1 Y 2
PFX p1 0 m' [aeiou]
PFX p1 k c'h k[^h]
PFX p2 N 1
PFX p2 0 x .
SFX s1 Y 3
SFX s1 0 añ [^hz]
SFX s1 z sañ z
SFX s1 0 at [^z]h something
SFX s2 N 1
SFX s2 0 ed
"""


def test_parsing():
    rules, kind = affixes.parsed(AFF)
    assert kind == "long" and len(rules) == 7
    assert rules[1] == affixes.Affix(True, "p1", True, "k", "c'h", "k[^h]") and rules[5].condition == "[^z]h" and rules[6] == affixes.Affix(False, "s2", False, "", "ed", ".")
    t = affixes.tries(rules)
    assert t.forms("kaz", ["p1", "s1", "s2"]) == {"kaz", "kasañ", "kazed", "c'haz", "c'hasañ"}
    assert t.forms("ah", ["p2", "s1"]) == {"ah", "ahat", "xah"}
    assert ("kaz", ("p1", "s1")) in t.stems("c'hasañ") and ("kaz", ("s2",)) in t.stems("kazed")
    assert affixes.flags_of("p1s2", "long") == ["p1", "s2"] and affixes.flags_of("ab") == ["a", "b"] and affixes.flags_of("1,22", "num") == ["1", "22"]


LETTERS = st.sampled_from("abk")
WORDS = st.lists(LETTERS, min_size=1, max_size=5).map("".join)
CONDITIONS = st.sampled_from([".", "a", "[ab]", "[^a]", "b[^k]", ".a", "[^ab].", "k."])
RULES = st.lists(st.builds(affixes.Affix, st.booleans(), st.sampled_from("xyz"), st.booleans(), st.sampled_from(["", "", "a", "b", "ab"]), st.sampled_from(["", "a", "b", "ka", "bb"]), CONDITIONS), max_size=8).map(tuple)


@settings(deadline=None, max_examples=300)
@given(RULES, st.lists(st.tuples(WORDS, st.lists(st.sampled_from("xyz"), max_size=3)), min_size=1, max_size=4), WORDS)
def test_stems_are_those_that_give_the_form(rules, stems, word):
    t = affixes.Tries(rules)
    for stem, flags in stems:
        forms = {stem}
        for s in (None, *[r for r in rules if not r.prefix and r.flag in flags]):
            middle = stem if s is None else s.applied(stem)
            if middle is None:
                continue
            for p in (None, *[r for r in rules if r.prefix and r.flag in flags]):
                if p is not None and s is not None and not (p.cross and s.cross):
                    continue
                form = middle if p is None else p.applied(middle)
                if form is not None:
                    forms.add(form)
        assert t.forms(stem, flags) == forms
        for form in {*forms, word}:
            assert (form in forms) == any(s == stem and set(used) <= set(flags) for s, used in t.stems(form))


def test_speller_and_expansion(spark):
    rules, kind = affixes.parsed(AFF)
    dic = affixes.dictionary(spark.createDataFrame([("3",), ("kaz/p1s1s2",), ("ah/s1",), ("plain",), ("kaz/p2",), ("",)], "value string"), kind)
    assert sorted((r.stem, tuple(r.flags)) for r in dic.collect()) == [("ah", ("s1",)), ("kaz", ("p1", "s1", "s2")), ("kaz", ("p2",)), ("plain", ())]
    forms = {r.form for r in affixes.expanded(dic, rules).collect()}
    assert forms == {"kaz", "kasañ", "kazed", "c'haz", "c'hasañ", "xkaz", "ah", "ahat", "plain"}
    words = [*sorted(forms), "xkazed", "c'hazed", "other", "", None, "kaz"]
    got = affixes.known(spark.createDataFrame([(w, 1) for w in words], "word string, known_before int"), dic, rules).collect()
    assert len(got) == len(words) and all(r.known == (r.word in forms) for r in got)


def test_many_rules_on_many_words(spark):
    r = random.Random(1)
    ends = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(3000)]
    rules = tuple(affixes.Affix(False, "s", True, "", e, ".") for e in sorted(set(ends)))
    stems = spark.createDataFrame([(f"w{i}", ["s"]) for i in range(2000)], "stem string, flags array<string>")
    words = spark.createDataFrame([(f"w{i}{e}",) for i, e in enumerate(ends[:2000])], "word string")
    assert affixes.known(words, stems, rules).filter("known").count() == 2000
