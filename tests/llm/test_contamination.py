"""Benchmark passages against a scan of whole texts: random edits, excerpts, repeats, short items."""

import random

import numpy as np

from discloq.llm import contamination as c


def distance(item: bytes, text: bytes) -> int:
    """Least edits of the item in any stretch of the text, by the plain recurrence."""
    b = np.frombuffer(text, np.uint8)
    row = np.zeros(len(b) + 1, int)
    for i, x in enumerate(item):
        new = np.minimum(row[:-1] + (b != x), row[1:] + 1)
        steps = np.arange(len(b) + 1)
        row = np.minimum.accumulate(np.concatenate([[i + 1], new]) - steps) + steps
    return int(row.min())


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def edited(rng, text, k):
    text = list(text)
    for _ in range(k):
        at = rng.randrange(1, len(text) - 1)
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = "z"
        elif kind == 1:
            del text[at]
        else:
            text.insert(at, "y")
    return "".join(text)


def test_random_edits():
    rng = random.Random(3)
    items = [(i, words(rng, rng.choice([3, 5, 12, 20]))) for i in range(40)]
    index = c.Index.of(items)
    for _ in range(150):
        _, item = rng.choice(items)
        text = words(rng, 15) + " " + edited(rng, item, rng.randrange(0, 9)) + " " + words(rng, 15)
        found = {r[1]: r[2] for r in index.scan([text])}
        for k, other in items:
            if len(other) <= c.PASSAGE and len(other) >= 2 * c.Q:
                least = distance(c.normal(other)[0].tobytes(), c.normal(text)[0].tobytes())
                assert (k in found) == (least <= c.budget(len(c.normal(other)[0]))) and found.get(k, least) == least, (other, text)


def test_every_copy_is_found():
    rng = random.Random(4)
    item, short, tiny = words(rng, 15), "alpha beta 77", "Yes, 42"
    index = c.Index.of([(1, item), (2, short), (3, tiny), (4, tiny), (5, "?! .")])
    text = f"{words(rng, 5)} {item} {words(rng, 9)} {edited(rng, item, 2)}. {item} {item}; alphabeta 77 alpha  beta, 77! yes 42 yes 421 alpha beta 777 yes -- 42"
    got = index.scan(["", text, "yes 42", None or ""])
    spans = [(i, e, text.encode()[s:t].decode()) for k, i, e, s, t in got if k == 1]
    assert [x for i, e, x in spans if i == 1 and e == 0] == [item] * 3 and sum(i == 1 for i, _, _ in spans) == 4
    assert [x for i, _, x in spans if i == 2] == ["alpha  beta, 77"]
    assert [x for i, _, x in spans if i == 3] == ["yes 42", "yes -- 42"] == [x for i, _, x in spans if i == 4]
    assert [(i, s, t) for k, i, _, s, t in got if k == 2] == [(3, 0, 6), (4, 0, 6)]


def test_excerpts_of_long_items():
    rng = random.Random(5)
    for _ in range(60):
        item = words(rng, 150)
        a = rng.randrange(len(item) - c.PASSAGE - c.STEP)
        size = rng.randrange(c.PASSAGE + c.STEP, len(item) - a + 1)
        excerpt = item[a : a + size]
        text = f"{words(rng, 30)} qq{excerpt}qq {words(rng, 30)}"
        got = c.Index.of([(7, item)]).scan([text])
        assert len(got) == 1 and got[0][1] == 7
        inside = text.encode()[got[0][3] : got[0][4]].decode()
        assert inside in text and len(inside) >= c.PASSAGE and len(set(inside.split()) & set(excerpt.split())) > 5
        assert c.Index.of([(7, item)]).scan([f"{words(rng, 30)} {item[a : a + 60]} {words(rng, 30)}"]) == []
    whole = c.Index.of([(7, item)]).scan([f"{words(rng, 9)} {item} {words(rng, 9)} {item[:300]}"])
    assert [r[2] for r in whole] == [0, 0] and whole[0][4] - whole[0][3] == len(item)


def test_very_long_text_and_repeated_rows(spark):
    rng = random.Random(6)
    item = words(rng, 20)
    long = words(rng, 200_000) + " " + item
    rows = [(1, long), (2, item), (2, item), (None, None), (3, "")]
    got = c.find_passages(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["edits"]) for r in got) == [(1, 0), (2, 0), (2, 0)]
