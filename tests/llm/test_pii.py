"""Surrogates: nothing found is left, distinct stays distinct, the same stays the same, the rest of a text is untouched."""

import re

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import pii


def told(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["text"], r["n_entities"]) for r in pii.replace(docs, key).orderBy("doc_id").collect()]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10


FORMATS = [
    ("write to jane.doe+x@Mail.example.com, please", r"write to [a-z0-9]+\.\d+@mail\.example\.org, please"),
    ("JANE@EXAMPLE.COM!!", r"[A-Z0-9]+\.\d+@MAIL\.EXAMPLE\.ORG!!"),
    ("call +1 (017) 555-7713%%%", r"call \+1 \(\d{3}\) \d{3}-\d{4}%%%"),
    ("(212) 555-0100 or 212-555-0100.", r"(\(\d{3}\) \d{3}-\d{4}) or \d{3}-\d{3}-\d{4}\."),
    ("4845168114407329", r"\d{16}"), ("4845-1681-1440-7329,", r"\d{4}-\d{4}-\d{4}-\d{4},"), ("3782 822463 10005", r"\d{4} \d{6} \d{5}"),
    ("at 1.2.3.4 now", r"at \d{1,3}(\.\d{1,3}){3} now"), ("from 97.51.17.173!!", r"from \d{1,3}(\.\d{1,3}){3}!!"), ("123-45-6789", r"\d{3}-\d{2}-\d{4}"),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', r'token = "[0-9a-f]{40}"'),
    ("04DBEBAB91AB85687D33EEAAF9AC699E1188F962", "[0-9A-F]{40}"),
    ("Dear Mr. John Smith,", r"Dear Mr\. [A-Z][a-z]+ [A-Z][a-z]+,"), ("Frau Müller.", r"Frau [A-Z][a-z]+\."), ("Господин Иван Петров", "Господин [А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+"),
]


@pytest.fixture(scope="module")
def formats(spark):
    return told(spark, [t for t, _ in FORMATS])


@pytest.mark.parametrize("i", range(len(FORMATS)))
def test_formats(formats, i):
    (text, pattern), (new, n) = FORMATS[i], formats[i]
    assert re.fullmatch(pattern, new) and new != text and n >= 1
    if "4845" in text or "3782" in text:
        a, b = (re.sub(r"\D", "", t) for t in (text, new))
        assert luhn(a) == luhn(b)


def test_every_pattern_passes_the_first_look(spark):
    """The shortest forms and those without three digits in a row, each as a text of its own."""
    texts = [
        "a@b.cc", "ab" * 16, "AB" * 16, "a1b2c3d4" * 5, "1.2.3.4", "4" * 13, "4845 1681 1440 7329", "3782-822463-10005",
        "+33 6 12 34 56 78", "+45 12 34 56 78", "+47 22 33 44 55", "+33-6-12-34-56-78", "+1 22 33", "+1 2 34 56",
        "(212) 555-0100", "212-555-0100", "123-45-6789", "Mr Xu", "Dr. Xu",
    ]
    for text, (new, n) in zip(texts, told(spark, texts)):
        found = re.search(r"\+1 22 33", text) is None
        assert n == found and (new != text) == found, text


NAMED = [
    "Mr O'Brien", "Herr Müller-Lüdenscheidt", "Mr Ronald McDonald", "Madame Marie Curie-Joliot", "Dr J. Smith", "Dr  Jane   Smith",
    "Mr John Ronald Reuel Tolkien", "Frau Prof. Dr. Weber", "Herr Ludwig van Beethoven", "Monsieur d'Artagnan", "Mr Xu", "Mr O’Neill-O’Hara",
]


def test_nothing_of_a_name_is_left(spark):
    new = told(spark, [f"from {t}, {t}'s" for t in NAMED])
    for old, (text, n) in zip(NAMED, new):
        words = [w for w in re.findall(r"[^\W\d_]{3,}", old) if w not in ("Herr", "Madame", "Monsieur", "Frau", "Prof", "van")]
        assert n == 2 and not any(w in text for w in words), (old, text)
        first, second = re.fullmatch(r"from (.*), (.*)'s", text).groups()
        assert first == second
    assert len({t for t, _ in new}) == len(NAMED)


def test_gender_of_given_names(spark):
    new = told(spark, ["Mr Tom Hill", "Mrs Ann Hill", "Dr. Kim Hill", "Госпожа Анна Каренина"])
    given = [t.split()[1] for t, _ in new]
    for name, (script, gender) in zip(given, [("latin", "m"), ("latin", "f"), ("latin", "n"), ("cyrillic", "f")]):
        assert name in pii.GIVEN[script][gender].split()


def test_clean_texts_and_awkward_rows(spark, awkward):
    clean = ["Version 2.0 of 1999, 3.14 and 12-34.", "CC BY-NC 4.0", "at 10:30 on 2024-01-31", "a@b", "#100 000", "The Mrs. and the mister", "1.2.3", "", None]
    assert told(spark, clean) == [(t, 0) for t in clean]
    got = pii.replace(awkward, "k")
    assert got.columns == [*awkward.columns, "n_entities"]
    assert sorted(map(repr, got.drop("n_entities").collect())) == sorted(map(repr, awkward.collect()))
    assert pii.replace(awkward.limit(0), "k").count() == 0


def test_coreference_distinctness_and_the_key(spark):
    texts = [f"+1 (017) 555-{i:04d} and a{i}@mail.example.com, 10.0.{i // 200}.{i % 200}, {4000000000000000 + i}" for i in range(600)]
    texts += ["+1 017 555 0003 A3@MAIL.EXAMPLE.COM"]
    new = [t for t, _ in told(spark, texts)]
    found = [re.findall(r"\S+@\S+(?=,)|\+1 \(\d+\) \d+-\d+|\d+\.\d+\.\d+\.\d+|\d{16}", t) for t in new[:600]]
    flat = [x for f in found for x in f]
    assert all(len(f) == 4 for f in found) and len(set(flat)) == len(flat)
    olds = {x for t in texts for x in t.replace(",", "").split()}
    assert not olds & {x for x in flat}
    phone, mail = found[3][0], found[3][1]
    assert re.sub(r"\D", "", new[600]).startswith(re.sub(r"\D", "", phone))
    assert mail.upper() in new[600]
    assert [t for t, _ in told(spark, texts)] == new
    assert [t for t, _ in told(spark, texts, "another key")] != new


def test_collisions_get_another_try(spark, monkeypatch):
    """With few names to draw from, distinct people still get distinct names, by either way of handing them out."""
    monkeypatch.setattr(pii, "NAME_SYLLABLES", 1)
    texts = [f"Mr {a}{b}" for a in ("Ab", "Ba", "Ce", "Do", "Eg") for b in ("an", "ek", "il", "os", "um", "yr", "ta", "ne")] * 2
    first = [t for t, _ in told(spark, texts)]
    # Of a one-word name only the family name is shown; it is the full names that differ.
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    again = pii.retries(docs, "text", "k")
    assert again.count() > 0
    made = again.select(pii.surrogate(F.col("canon"), F.col("tries"), "k").alias("m"))
    assert made.distinct().count() == again.count()
    monkeypatch.setattr(pii, "FEW", 0)
    assert [t for t, _ in told(spark, texts)] == first


def test_one_word_names_are_compared_as_written(spark, monkeypatch):
    monkeypatch.setattr(pii, "NAME_SYLLABLES", 1)
    texts = [f"Mr {a}{b}{c}" for a in ("Ab", "Ba", "Ce", "Do", "Eg") for b in ("an", "ek", "il", "os") for c in ("ta", "ne", "ru")]
    new = [t for t, _ in told(spark, texts)]
    assert len(set(new)) == len(texts)


def test_names_are_the_same_under_any_title_and_without(spark):
    texts = ["Mrs Anna Weber came. Mrs Weber and Anna Weber, that is Weber's Anna.", "Dr Anna Weber", "Dr. Weber", "Ms  Anna  Weber",
             "Mr Anton Weber and Mr Anton Maier", "Weber and Anna have no title here"]
    new = told(spark, texts)
    full, given, family = re.match(r"Mrs ((\S+) (\S+)) came", new[0][0]).groups()
    assert new[0] == (f"Mrs {full} came. Mrs {family} and {full}, that is {family}'s {given}.", 6)
    assert new[1][0].endswith(f" {family}") and new[2][0] == f"Dr. {family}" and new[3][0] == f"Ms  {given}  {family}"
    other, same, another = re.fullmatch(r"Mr (\S+) (\S+) and Mr \1 (\S+)", new[4][0]).groups()
    assert same == family != another and other != given
    assert new[5] == (texts[5], 0)


def test_many_given_names_stay_distinct(spark, monkeypatch):
    texts = [f"Mr {a}{b} Weber" for a in ("Ab", "Ba", "Ce", "Do", "Eg") for b in ("an", "ek", "il", "os", "um", "yr", "ta", "ne")]
    new = [t for t, _ in told(spark, texts)]
    assert len(set(new)) == len(texts) and len({t.split()[2] for t in new}) == 1
    monkeypatch.setattr(pii, "FEW", 0)
    assert [t for t, _ in told(spark, texts)] == new


def test_what_is_found_in_the_given_documents_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    old = {r["doc_id"]: r["text"] for r in docs.collect()}
    new = pii.replace(docs, "k").collect()
    plain = re.compile(r"[\w.+-]+@[\w.-]+\.\w+|(?<!\d)\d{16}(?!\d)|\+\d \(\d{3}\) \d{3}-\d{4}|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)|\b[0-9a-f]{40}\b|\b[0-9A-F]{40}\b")
    originals = {m for t in old.values() for m in plain.findall(t or "")}
    assert len(originals) > 50
    for r in new:
        assert not originals & set(plain.findall(r["text"] or ""))
        assert plain.sub("", r["text"]) == plain.sub("", old[r["doc_id"]])
        assert r["n_entities"] == len(plain.findall(old[r["doc_id"]]))


MILLION = 1_000_000
#: Each of these, or a few, is an entity: there are a fiftieth as many.
DENSE = ("a@b.cc ", "1.2.3.4 ", "Mr Abcd, ", "4845 ", "Mr ", "a@", "22 ", "+1", "Mr. ", "Dr. ")
#: The inner part of each repetition, behind what leads into it.
REPEATED = [
    ("", "a", ""), ("", "a", "@x.com"), ("a@", "b.", "com"), ("a@", "b", ".com"), ("", "a@", ""), ("a@b.", "c", ""), ("a@b", "-", ".com"), ("", "a@b.cc ", ""),
    ("", "0", ""), ("", "ab12", "z"), ("", "ab12", ""), ("", "AB", "."), ("", "1.", "1"), ("", "1.2.3.4 ", ""), ("", "4845 ", ""), ("+1 ", "22 ", ""), ("", "+1", ""),
    ("", "123-45-", ""), ("(212) ", "555-", ""), ("", "Mr ", "Smith"), ("Mr ", "van ", "Dam"), ("Mr ", "Abcd ", ""), ("Mr A", "b", ""), ("Mr Ab", "-Ab", ""),
    ("Mr ", "A.", "Smith"), ("Mr ", "A.-", ""), ("Mr ", "A ", "Smith"), ("Mr", " ", "Smith"), ("Mr ", "Ab’", "x"), ("Mr. ", "Dr. ", "X"), ("", "Mr Abcd, ", ""),
    ("Mr \U00010400\U00010428", "a\U00010428", ""),
]


def test_a_million_repetitions(spark):
    """No pattern goes deep or takes the square of a text's length; the text around what is found stays."""
    cases = [(i, b, x, a, MILLION // (50 if x in DENSE else 1)) for i, (b, x, a) in enumerate(REPEATED)]
    docs = spark.createDataFrame(cases, "doc_id long, b string, x string, a string, n int").repartitionByRange(len(cases), "doc_id")
    docs = docs.select("doc_id", F.concat("b", F.expr("repeat(x, n)"), "a", F.lit(" end Mr Xu")).alias("text"))
    new = pii.replace(docs, "k").select("doc_id", "n_entities", F.substring("text", -40, 40).alias("end")).collect()
    assert len(new) == len(cases)
    for r in new:
        assert r["n_entities"] >= 1 and " end Mr " in r["end"] and not r["end"].endswith(" Xu"), REPEATED[r["doc_id"]]


def test_bounds_of_names_and_hosts(spark):
    words = " ".join(["Aa"] * 8)
    new = told(spark, [f"Mr {words} Bb Cc", "a@" + "b." * 126 + "com", "a@" + "b." * 127 + "com", "a@" + "y" * 64 + ".com", "x" * 300 + "@mail.com"])
    assert new[0][0].endswith(" Bb Cc") and "Aa" not in new[0][0] and new[0][1] == 1
    assert [n for _, n in new[1:]] == [1, 0, 0, 1] and "xxx" not in new[4][0]


def test_an_email_right_behind_another_entity(spark):
    (new, n), = told(spark, ["+33 6 12 34 56 78abc@x.com and a@b.com..or"])
    assert n == 3 and "abc" not in new and new.endswith("..or")


def test_a_crowded_set_of_numbers(spark):
    """Three fifths of all numbers of five digits: distinct surrogates, and an end."""
    docs = spark.range(60_000).select(F.col("id"), F.format_string("+1 %d %02d %02d", F.floor(F.col("id") / 10000), F.floor(F.col("id") / 100) % 100, F.col("id") % 100).alias("text"))
    docs = docs.unionByName(spark.range(3).select(F.lit(-1).alias("id"), F.format_string("+1 (017) 555-771%d", "id").alias("text")))
    known = docs.select(F.explode(pii.canons(pii.found_in(F.col("text")))).alias("canon"))
    assert pii.crowded(known) == ["phone/+1/7"]
    new = pii.replace(docs, "k").select("text").distinct()
    assert new.count() == 60_003
    assert new.filter(F.col("text").rlike(r"^\+1 [0-9] [0-9]{2} [0-9]{2}$")).count() == 60_000


def test_main_path_is_native(documents):
    plan = pii.replace(documents, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
