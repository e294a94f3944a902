import random
from collections import Counter

import pytest

from loomline.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string"


def shingles(words, size):
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(docs, items):
    out = set()
    for d, text, _ in docs:
        words = (text or "").lower().split()
        for i, item in items:
            own = (item or "").lower().split()
            if not own:
                continue
            size = min(5, len(own))
            want = shingles(own, size)
            n = min(len(own), len(words))
            for at in range(len(words) - n + 1) if n >= size else ():
                have = shingles(words[at : at + n], size)
                both = sum((want & have).values())
                if both >= 0.8 * (sum(want.values()) + sum(have.values()) - both):
                    out.add((d, i))
    return out


def cases():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(15, 60)))) for i in range(30)] + [(100, "only three words"), (101, ""), (102, None), (103, "a b a b a b a b a b a b"), (0, "another text of the same item id that is long")]
    docs = []
    for d in range(120):
        words = say(rng.randint(0, 300))
        if d % 2:
            own = items[rng.randrange(30)][1].split()
            for _ in range(d % 3):
                own[rng.choice((0, len(own) - 1, rng.randrange(len(own))))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = own
        docs.append((d, " ".join(words).upper() if d % 5 == 0 else " ".join(words), "x"))
    docs += [(200, None, "x"), (201, "", "x"), (202, "has only three words in it", "x"), (203, items[3][1].rsplit(" ", 1)[0], "x"), (204, "a b " * 40, "x"), (None, items[4][1], "x"), (1, docs[1][1], "x"), (205, "w1 " * 4000 + items[6][1], "x")]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_against_brute_force(spark, block_bytes):
    docs, items = cases()
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, i, block_bytes).collect()}
    want = brute(docs, items)
    assert found == want and len(want) > 40
    left = decontaminate.clean(d, i, block_bytes)
    assert left.columns == d.columns
    bad = {x for x, _ in want}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(x) for x, *_ in docs if x not in bad)


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontaminate.contaminated(d, i).count() == 0
    assert decontaminate.clean(spark.createDataFrame([(1, "a", "b")], DOCS), i).count() == 1


def test_hamming_blocks_find_all_within_the_radius():
    rng = random.Random(1)
    items = decontaminate.Items(5, [[f"a{i}-{j}".encode() for j in range(20)] for i in range(200)], list(range(200)))
    for i in range(0, 200, 7):
        bits = int(items.prints[i])
        for b in rng.sample(range(64), decontaminate.RADIUS):
            bits ^= 1 << b
        import numpy as np

        assert i in items.candidates(np.frombuffer(bits.to_bytes(8, "big"), np.uint8), 16)
