"""SimHash near-dedup against a comparison of all pairs."""

import random
from itertools import combinations

import pytest
import xxhash

from tallyframe.llm import simhash
from tallyframe.llm.common import stored


def plain_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    group = list(range(len(prints)))
    for i, j in combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= radius and group[i] != group[j]:
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    return group


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    group = plain_components(prints)
    ids = {}
    for g, (i, _) in zip(group, rows):
        ids.setdefault(g, []).append(i)
    least = {g: min((i for i in v if i is not None), default=None) for g, v in ids.items()}
    return sorted(((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, group)), key=repr)


def check(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_given_documents(documents):
    check(documents)


def test_awkward_rows(awkward):
    check(awkward)


def test_no_rows(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.one_of_each(nothing).count() == 0


@pytest.mark.parametrize("parts", [2, 4, 8])
def test_links_of_dense_groups_and_of_cut_tiles(spark, monkeypatch, parts):
    """Many fingerprints near each other, chains, and cells of many tiles: the same groups as by all pairs, few links."""
    monkeypatch.setattr(simhash, "TILE", 16)
    draw = random.Random(5)
    centres = [draw.getrandbits(64) for _ in range(6)]
    prints = set(centres)
    for c in centres:
        for _ in range(60):
            p = c
            for b in draw.sample(range(64), draw.randint(1, 4)):
                p ^= 1 << b
            prints.add(p)
        p = c
        for b in range(0, 30, 2):  # a chain
            p ^= 3 << b
            prints.add(p)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    classes = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = stored(simhash.links(classes, 3, parts), "links")
    assert found.count() < 130 * len(prints)
    named = {r["node"]: r["root"] for r in simhash.components(found).collect()}
    group = plain_components([p % (1 << 64) for p in prints])
    least = {g: min(p for p, h in zip(prints, group) if h == g) for g in group}
    assert {p: named.get(p, p) for p in prints} == {p: least[g] for p, g in zip(prints, group)}


def test_steps_and_parts():
    assert [len(simhash._steps(p, 3, 64 // p + 7)) for p in (1, 4, 8)] == [7, 129, 833]
    assert [simhash.parts_for(n) for n in (0, 50_000_000, 50_000_001, 10**10)] == [4, 4, 8, 16]
    assert 11**16 < 2**63  # the largest cell number of sixteen parts


def test_one_of_each_group_stays(awkward, documents):
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    # 1 and 2 are copies, 9 is there twice, and no word at all makes one group: 3, 4, 5 and the row without anything.
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [1, 3, 6, 7, 8, 9, 10, 11]
    assert [r["text"] for r in kept.filter("doc_id is null").collect()] == ["No id but a text of some words here."]
    everything = simhash.near_duplicates(documents)
    assert sorted(r[0] for r in simhash.one_of_each(documents).select("doc_id").collect()) == sorted(
        r[0] for r in everything.select("component_id").distinct().collect()
    )


def test_rows_of_one_id(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "e f g h i"), (2, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    kept = sorted(map(tuple, simhash.one_of_each(docs).collect()))
    assert kept == [(1, "a b c d"), (1, "e f g h i")]


def test_no_pairs_in_the_plan(documents):
    plan = simhash.near_duplicates(documents)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
