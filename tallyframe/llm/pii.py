"""Personal data replaced by surrogates: keyed, of the same type and format, distinct for distinct values.

Entities are found by one pattern and replaced in place by expressions, without
moving a text. Numbers go through a keyed permutation of numbers of the same
length, so distinct ones stay distinct; other surrogates are drawn by a keyed hash.
Beside that the distinct entities are gathered and their surrogates compared with each
other and with all originals: the few that collide get another try, and the list of
those is all that the replacement needs to know of the rest of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.roles import quoted
from .common import joined, stored

#: Titles by gender of who follows them; a doctor may be either.
TITLES = {
    "m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Госпожа"),
    "n": ("Dr", "Prof", "Доктор"),
}
GIVEN = {
    "latin": {
        "m": "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Leo Martin Niko Oscar Paul",
        "f": "Ada Berta Clara Diana Emma Flora Greta Hanna Iris Julia Karla Laura Maria Nina Olga Paula",
        "n": "Alex Andrea Billie Charlie Dominique Eli Frankie Jamie Kim Luca Mika Noa Robin Sacha Toni Yuri",
    },
    "cyrillic": {
        "m": "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Марк Никита Олег Павел Роман Юрий",
        "f": "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса Юлия",
        "n": "Валя Женя Саша Паша Шура Слава Тоня Люба Миша Гриша Лёня Петя Ваня Даня Костя Надя",
    },
}
SYLLABLES = {
    "latin": "bar ben dal den far fel gar gen hal hen kar kel lan len mar mel nar nel por pel ran ros sal sen tar tel van ver wal wen zan zel",
    "cyrillic": "бар бел вар вел гор гал дар дел жар жел зор зел кар кел лар лен мар мел нор нел пар пел рос рел сар сел тар тел фар фел хор хел",
}
#: Syllables of a family name, capital first: the collision checks take care of the rest.
NAME_SYLLABLES = 5

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Java's matcher goes one call deeper with each turn of a repeated group, unless the group is possessive (+ at its end):
# every repetition here is one of those, of a class of characters, or has a small bound.
#: Parts of a name: words with inner capitals, hyphens and apostrophes, but without a genitive's; initials; what stands before a word.
_WORD = r"(?:\p{Ll}{1,2}['’])?\p{Lu}(?:[\p{L}\p{M}]+|(?=['’-]\p{L}{2}))(?:(?!['’]s(?!\p{L}))['’-][\p{L}\p{M}]+)*+"
_INITIAL = r"(?:\p{Lu}\.-?)++|\p{Lu}(?=\h+\p{Lu}\p{L})"
_BEFORE = r"(?:(?:van|von|vom|de|der|den|del|della|di|da|do|dos|das|du|la|las|le|los|el|al|bin|ibn|ter|ten|zu|zum|zur)\h++)*+"
_PART = rf"{_BEFORE}(?:{_WORD}|{_INITIAL})"
_TITLES = "(?:(?:%s)\\.?\\h++){1,5}" % "|".join(t for g in TITLES.values() for t in g)
#: Words in a name, and labels in a host name before the last: what goes beyond isn't part of it.
NAME_WORDS, LABELS = 8, 126
#: What is looked for, in this order at each place. An email begins where no earlier character could be part of it, or behind
#: another entity, so that each run of such characters is looked at once.
PATTERNS = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._+-]))[A-Za-z0-9._+-]++@(?:[A-Za-z0-9-]{{1,63}}\.){{1,{LABELS}}}[A-Za-z]{{2,63}}",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": rf"(?<!\p{{L}}){_TITLES}{_PART}(?:\h++(?!{_TITLES}){_PART}){{0,{NAME_WORDS - 1}}}",
}
# Back references are counted anew in the whole, so separators are spelled out there.
ANY = "|".join(
    f"(?:{p})" for p in (
        PATTERNS["email"], PATTERNS["secret"], PATTERNS["ip"],
        r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}"
        r"|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])",
        PATTERNS["phone"], PATTERNS["id"], PATTERNS["name"],
    )
)
#: Every entity has one of these, which is quicker to see: the first character rules out most places.
_ALL_TITLES = [t for g in TITLES.values() for t in g]
HINT = "[0-9@+%s](?:(?<=@)|(?<=\\+)[0-9]|(?<=[0-9])(?:[0-9]{2}|[0-9]?\\.[0-9])|%s)" % (
    "".join(sorted({t[0] for t in _ALL_TITLES})), "|".join(f"(?<={t[0]}){t[1:]}[.\\h]" for t in _ALL_TITLES),
)
#: But a secret, which may have no digits.
SECRET_HINT = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32}|[0-9A-F]{32})"
#: Values with another try that are looked up within the expression; with more, texts are joined with theirs.
FEW = 500
#: A set of numbers is crowded if more than one in so many of it is an original.
CROWDED = 10


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def kind_of(value: Column) -> Column:
    """The type of a found value, from what it is made of."""
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), "secret")
        .when(value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "ip")
        .when(value.rlike(r"^(?:[0-9][ -]?){13,19}$"), "card")
        .when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "id")
        .when(value.rlike(r"^[+(0-9]"), "phone")
        .otherwise("name")
    )


TITLE = f"^{_TITLES}"


def _gender(value: Column) -> Column:
    """Of the first title that has one."""
    titles = F.split(F.regexp_extract(value, TITLE, 0), r"\.?\h+")
    m, f = (F.arrays_overlap(titles, F.array(*[F.lit(t) for t in TITLES[g]])) for g in "mf")
    return F.when(m, "m").when(f, "f").otherwise("n")


def _words(value: Column) -> Column:
    """The words of a name behind its titles as an array of (word, canon): the last one is the family name, the others are given names."""

    def of(s: Column) -> Column:
        def entry(word: Column, i: Column) -> Column:
            script = F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
            role = F.when(i == F.size(s["words"]) - 1, "name:").otherwise(F.concat(F.lit("given:"), s["gender"], F.lit("/")))
            return F.struct(word.alias("word"), F.concat(role, script, F.lit("/"), F.lower(word)).alias("canon"))

        return F.transform(s["words"], entry)

    words = F.regexp_extract_all(F.regexp_replace(value, TITLE, ""), F.lit(f"{_WORD}|{_INITIAL}"), F.lit(0))
    return let(F.struct(words.alias("words"), _gender(value).alias("gender")), of)


def canonical(value: Column) -> Column:
    """What spellings of one entity that isn't a name have in common, behind its type."""

    def of(kind: Column) -> Column:
        same = F.when(kind.isin("email", "secret"), F.lower(value)).when(kind == "ip", value)
        return F.concat(kind, F.lit(":"), same.otherwise(F.regexp_replace(value, "[^0-9+]", "")))

    return let(kind_of(value), of)


# --- surrogates ------------------------------------------------------------------------------

def _number(key: str, *parts: Column) -> Column:
    """A number of 60 bits that can't be foretold without the key."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _permuted(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tweak: Column) -> Column:
    """A struct (a, b): a keyed permutation of the pairs below the two sizes; four Feistel rounds."""

    def turn(s: Column, r: Column) -> Column:
        mixed = F.pmod(s["a"] + F.pmod(_number(key, tweak, r.cast("string"), s["b"].cast("string")), s["m"]), s["m"])
        return F.struct(s["b"].alias("a"), mixed.alias("b"), s["n"].alias("m"), s["m"].alias("n"))

    start = F.struct(a.alias("a"), b.alias("b"), size_a.alias("m"), size_b.alias("n"))
    return F.aggregate(F.array(*[F.lit(r) for r in range(4)]), start, turn)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _digits(digits: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the strings of as many digits."""

    def whole(s: Column) -> Column:
        d, left, right = s["d"], s["left"], s["right"]
        a, b = F.concat(F.lit("0"), F.substring(d, F.lit(1), left)).cast("long"), F.substring(d, left + 1, right).cast("long")
        p = _permuted(a, b, _power(left), _power(right), key, F.concat_ws("/", tweak, F.length(d).cast("string")))
        return let(p, lambda q: F.concat(F.lpad(q["a"].cast("string"), left, "0"), F.lpad(q["b"].cast("string"), right, "0")))

    half = F.floor(F.length(digits) / 2).cast("int")
    return let(F.struct(digits.alias("d"), half.alias("left"), (F.length(digits) - half).alias("right")), whole)


def _luhn(d: Column) -> Column:
    """The check sum of a number's digits."""

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return let(x, lambda v: total + v - F.when(v > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)


def _name(kind: Column, same: Column, more: Column, tries: Column) -> Column:
    """Another family name, or another given name of the gender; longer ones with the tries, so that there are always enough."""

    listed, start = F.lit(""), F.split_part(same, F.lit("/"), F.lit(-1))
    for s in GIVEN:
        for g, names in GIVEN[s].items():
            listed = F.when((kind == "given") & same.startswith(f"{g}/{s}/"), names).otherwise(listed)
        listed = F.when((kind == "name") & same.startswith(f"{s}/"), SYLLABLES[s]).otherwise(listed)
    size = F.when(kind == "given", tries + 1).otherwise(F.lit(NAME_SYLLABLES) + F.floor(tries / 2).cast("int"))

    def drawn(words: Column) -> Column:
        def pick(i: Column) -> Column:
            return F.element_at(words, (F.pmod(F.call_function("shiftright", more, 5 * i), F.size(words)) + 1).cast("int"))

        return F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: pick(i - 1)), "-")

    made = F.lower(let(F.split(listed, " "), drawn))
    before = F.substring(same, F.lit(1), F.length(same) - F.length(start))
    return F.concat(before, F.when(kind == "given", made).otherwise(F.replace(made, F.lit("-"), F.lit(""))))


def surrogate(canon: Column, tries: Column, key: str) -> Column:
    """The canonical form that stands for another; ``tries`` counts from 0."""

    def of(s: Column) -> Column:
        kind, same, tweak, n, more = (s[c] for c in ("kind", "same", "tweak", "n", "more"))
        mailbox = F.concat(F.lower(F.conv(n.cast("string"), 10, 36)), F.lit("."), F.pmod(more, F.lit(100)).cast("string"), F.lit("@mail.example.org"))
        stream = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(i)), tweak, same), 256) for i in range(2)])
        secret = F.substring(F.repeat(stream, F.ceil(F.length(same) / 128).cast("int")), F.lit(1), F.length(same))
        octets = [F.split_part(same, F.lit("."), F.lit(i)).cast("long") for i in range(1, 5)]
        two = F.lit(1 << 16).cast("long")
        moved = _permuted(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], two, two, key, tweak)
        ip = let(moved, lambda p: F.concat_ws(".", *[x.cast("string") for h in ("a", "b") for x in (F.shiftright(p[h], 8), F.pmod(p[h], F.lit(256)))]))
        # The last digit of a card keeps the check sum right, or as wrong as it was.
        head = _digits(F.substring(same, F.lit(1), F.length(same) - 1), key, tweak)
        card = let(head, lambda h: F.concat(h, F.pmod(_luhn(same) - _luhn(F.concat(h, F.lit("0"))), F.lit(10)).cast("string")))
        # A country's first digit stays.
        lead = F.when(same.startswith("+"), 2).otherwise(0)
        number = F.concat(F.substring(same, F.lit(1), lead), _digits(F.substring(same, lead + 1, F.length(same)), key, tweak))
        made = F.when(kind == "email", mailbox).when(kind == "secret", secret).when(kind == "ip", ip).when(kind == "card", card)
        return F.concat(kind, F.lit(":"), made.when(kind.isin("name", "given"), _name(kind, same, more, tries)).otherwise(number))

    def drawn(s: Column) -> Column:
        n, more = _number(key, s["tweak"], s["same"]), _number(key, F.lit("more"), s["tweak"], s["same"])
        return let(F.struct(s["kind"].alias("kind"), s["same"].alias("same"), s["tweak"].alias("tweak"), n.alias("n"), more.alias("more")), of)

    kind, same = F.split_part(canon, F.lit(":"), F.lit(1)), F.regexp_replace(canon, "^[a-z]+:", "")
    return let(F.struct(kind.alias("kind"), same.alias("same"), F.concat(kind, tries.cast("string")).alias("tweak")), drawn)


def _in_format(value: Column, made: Column) -> Column:
    """A surrogate's canonical form written the way ``value`` is."""

    def of(s: Column) -> Column:
        kind, same, digits = s["kind"], s["same"], s["digits"]

        def fill(done: Column, c: Column) -> Column:
            put = c.rlike("[0-9]")
            out = F.concat(done["out"], F.when(put, F.substring(digits, done["i"], F.lit(1))).otherwise(c))
            return F.struct(out.alias("out"), (done["i"] + put.cast("int")).alias("i"))

        filled = F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), fill, lambda d: d["out"])
        named = F.regexp_replace(F.initcap(F.replace(F.element_at(F.split(same, "/"), -1), F.lit("-"), F.lit(" "))), " ", "-")
        loud = (value == F.upper(value)) & (value != F.lower(value))
        text = F.when(kind.isin("email", "secret"), F.when(loud, F.upper(same)).otherwise(same))
        return text.when(kind == "ip", same).when(kind.isin("name", "given"), named).otherwise(filled)

    kind, same = F.split_part(made, F.lit(":"), F.lit(1)), F.regexp_replace(made, "^[a-z]+:", "")
    return let(F.struct(kind.alias("kind"), same.alias("same"), F.regexp_replace(same, "[^0-9]", "").alias("digits")), of)


# --- collisions ------------------------------------------------------------------------------

def found_in(text: Column) -> Column:
    """All entities of a text in order, as a struct: ``items`` (value, and words with their canonical forms), and
    ``more``, the pattern of names and their words that are looked for beside ``ANY``.

    Words of names with a title are also found alone in the same text. No items for a missing text.
    """
    words = "array<struct<word: string, canon: string>>"

    def of(first: Column) -> Column:
        known = F.flatten(F.transform(F.array_distinct(F.filter(first, lambda v: v.rlike(TITLE))), _words))
        return let(known, lambda k: let(F.struct(first.alias("first"), k.alias("known"), bare(k).alias("more")), items))

    def bare(known: Column) -> Column:
        # Of two words of which one begins the other, the longer one comes first.
        listed = F.sort_array(F.array_distinct(F.filter(known["word"], lambda w: w.rlike(rf"^{_WORD}$"))), asc=False)
        pattern = F.concat(F.lit(r"|(?<![\p{L}\p{M}])(?:"), F.array_join(listed, "|"), F.lit(r")(?![\p{L}\p{M}])"))
        return F.when(F.size(listed) > 0, pattern).otherwise("")

    def items(s: Column) -> Column:
        def item(v: Column) -> Column:
            alone = F.filter(s["known"], lambda k: k["word"] == v)
            other = F.array(F.struct(v.alias("word"), canonical(v).alias("canon")))
            of = F.when(v.rlike(TITLE), _words(v)).when(F.size(alone) > 0, F.slice(alone, 1, 1)).otherwise(other)
            return F.struct(v.alias("value"), of.cast(words).alias("words"))

        every = F.when(s["more"] == "", s["first"]).otherwise(F.regexp_extract_all(text, F.concat(F.lit(ANY), s["more"]), F.lit(0)))
        return F.struct(F.transform(every, item).alias("items"), s["more"].alias("more"))

    none = F.array().cast("array<string>")
    first = F.coalesce(F.when(text.rlike(HINT) | text.rlike(SECRET_HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none), none)
    return let(first, of)


def canons(found: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(found["items"], lambda i: i["words"]["canon"])))


def _space(canon: Column) -> tuple[Column, Column]:
    """The name of the set that a number's surrogate comes from, null for what isn't a number, and the size of the set.

    A permutation keeps its type, its length and the first digit of a country.
    """
    kind, same = F.split_part(canon, F.lit(":"), F.lit(1)), F.regexp_replace(canon, "^[a-z]+:", "")
    lead = F.when(same.startswith("+"), F.substring(same, 1, 2)).otherwise("")
    free = F.length(same) - F.when(kind == "card", 1).otherwise(F.length(lead))
    name = F.when(kind == "ip", "ip").when(kind.isin("card", "phone", "id"), F.concat_ws("/", kind, lead, F.length(same).cast("string")))
    return name, F.when(kind == "ip", F.lit(2.0**32)).otherwise(F.pow(F.lit(10.0), free))


def crowded(known: DataFrame) -> list[str]:
    """The sets of numbers of which ``known`` (canon) holds more than one in ``CROWDED``; a type, a length and a digit each, so a few hundred at most."""
    name, size = _space(F.col("canon"))
    full = known.groupBy(name.alias("space")).agg(F.count("*").alias("n"), F.max(size).alias("size"))
    return [r["space"] for r in full.filter(f"space is not null and n * {CROWDED} > size").collect()]


def retries(docs: DataFrame, text_col: str, key: str) -> DataFrame:
    """(canon, tries) of the entities whose first surrogate isn't theirs alone, or is an entity itself; a table.

    Values are compared as written out, that is by canonical form. Of several with
    one surrogate the least keeps it. Numbers of a set of which they fill more than one in ``CROWDED`` keep their
    first surrogate: these are distinct, as they come from a permutation of the set, but some
    are other originals, which can't be helped where there is little else. Elsewhere each round leaves
    a fifth or less of the collisions; names and mailboxes draw from sets that grow or are vast.
    """
    values = docs.select(F.explode(canons(found_in(quoted(text_col).cast("string")))).alias("canon"))
    known = stored(values.distinct(), "pii-entities")
    full = crowded(known)
    if full:
        known = stored(known.filter(~F.coalesce(_space(F.col("canon"))[0].isin(full), F.lit(False))), "pii-entities")
    made = stored(known.select("canon", surrogate(F.col("canon"), F.lit(0), key).alias("made"), F.lit(0).alias("tries")), "pii-surrogates")
    while True:
        shared = made.groupBy("made").agg(F.min("canon").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        shared = made.join(shared, "made").filter("canon != first").select("canon")
        real = made.join(known.select(F.col("canon").alias("made")), "made", "left_semi").select("canon")
        bad = stored(shared.unionByName(real).distinct(), "pii-collisions")
        if bad.isEmpty():
            return stored(made.filter("tries > 0").select("canon", "tries"), "pii-retries")
        again = made.join(bad, "canon", "left_semi").select("canon", (F.col("tries") + 1).alias("tries"))
        again = again.select("canon", surrogate(F.col("canon"), F.col("tries"), key).alias("made"), "tries")
        made = stored(made.join(bad, "canon", "left_anti").unionByName(again), "pii-surrogates")


def _rewritten(text: Column, key: str, tries_of: Callable[[Column], Column]) -> Column:
    """``text`` with what is in the column _found replaced."""

    def word(w: Column) -> Column:
        return let(surrogate(w["canon"], tries_of(w["canon"]), key), lambda m: _in_format(w["word"], m))

    def replaced(item: Column) -> Column:
        # Titles and what stands before and between the words of a name stay.
        head = F.regexp_extract(item["value"], TITLE, 0)
        rest = F.substring(item["value"], F.length(head) + 1, F.length(item["value"]))
        gaps = F.split(rest, f"{_WORD}|{_INITIAL}", -1)
        name = F.array_join(F.zip_with(gaps, F.array_append(F.transform(item["words"], word), F.lit("")), lambda g, m: F.concat(g, m)), "")
        return F.when(head == "", word(item["words"][0])).otherwise(F.concat(head, name))

    between = F.split(text, F.concat(F.lit(ANY), F.col("_found.more")), -1)
    put = F.array_append(F.transform("_found.items", replaced), F.lit(""))
    return F.when(F.size("_found.items") > 0, F.array_join(F.zip_with(between, put, lambda g, m: F.concat(g, m)), "")).otherwise(text)


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the entities of the text replaced; ``n_entities`` says how many.

    The same entity gets the same surrogate wherever it is, distinct ones distinct
    surrogates, and none gets one that is an entity of ``docs``, but for numbers so short that ``docs`` hold a tenth of
    all there are (see ``retries``). Titles keep their
    gender and names their script and number of words; numbers keep their length,
    separators and check sum. Family and given names are entities of their own, so people keep theirs
    under any title, and the words of a titled name are replaced wherever they are alone in the same text; but
    a given name gets one surrogate per gender of the titles, and the last word counts as the family name. Names have up to five titles
    and eight words, hosts up to 126 labels of 63 characters; what goes beyond stays as it is. Texts may be of any length: time grows
    with it, and with the distinct titled names of a text times its entities. A missing text stays missing. Rows, also repeated ones, and other columns stay as
    they are; an n_entities of ``docs`` gives way. No rows in, no rows out.
    """
    text = quoted(text_col).cast("string")
    name = docs.select(quoted(text_col)).columns[0]
    others = [c for c in docs.columns if c.lower() not in ("n_entities", "_found")]
    again = retries(docs, text_col, key)
    docs = docs.withColumn("_found", found_in(text))
    count = F.size("_found.items").cast("long").alias("n_entities")
    if again.limit(FEW + 1).count() <= FEW:
        tries = {r["canon"]: r["tries"] for r in again.collect()}  # at most FEW

        def tries_of(canon: Column) -> Column:
            if not tries:
                return F.lit(0)
            return F.coalesce(F.create_map(*[F.lit(x) for p in sorted(tries.items()) for x in p])[canon], F.lit(0))

        new = _rewritten(text, key, tries_of)
        return docs.select(*[new.alias(name) if c == name else quoted(c) for c in others], count)
    # Rows with such an entity get theirs as a map.
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "pii-rows")
    each = rows.select("_row", F.explode(canons(F.col("_found"))).alias("canon"))
    maps = joined(each, again, "canon").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("canon", "tries"))).alias("_tries"))
    rows = rows.join(stored(maps, "pii-maps"), "_row", "left")
    new = _rewritten(text, key, lambda canon: F.coalesce(F.col("_tries")[canon], F.lit(0)))
    return rows.select(*[new.alias(name) if c == name else quoted(c) for c in others], count)
