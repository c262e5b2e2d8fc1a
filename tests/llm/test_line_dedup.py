"""Line dedup against aligning every document with every earlier one."""

import random

from auditloom.llm import op05_line_dedup as lines


def brute(docs: dict[int, list[str]], least: int) -> dict[int, list[int]]:
    holders: dict[str, set[int]] = {}
    for d, ls in docs.items():
        for x in ls:
            holders.setdefault(x, set()).add(d)
    shared = {d: [(k, x) for k, x in enumerate(ls) if len(holders[x]) > 1] for d, ls in docs.items()}
    gone = {}
    for d, b in shared.items():
        lost = set()
        for e in sorted(x for x in docs if x < d):
            a = shared[e]
            met = lines.patience([x for _, x in a], [x for _, x in b])
            for lo, hi in lines.blocks(met, [k for k, _ in a], [k for k, _ in b], [len(x.split()) for _, x in b], least):
                lost |= set(range(lo, hi + 1))
        gone[d] = sorted(lost)
    return gone


def check(spark, docs, least=lines.MIN_WORDS):
    df = spark.createDataFrame([(d, "\n".join(ls)) for d, ls in docs.items()], "doc_id long, text string")
    got = {r["i"]: sorted(r["gone"]) for r in lines.deletions(df, least).collect()}
    want = brute(docs, least)
    assert {d: got.get(d, []) for d in docs} == want
    return want


def line(name: str, n: int) -> str:
    return " ".join(f"{name}{i}" for i in range(n))


def test_lines_with_different_first_holders(spark):
    passage = [line(f"p{k}x", 10) for k in range(6)]
    docs = {k + 1: [passage[k], line(f"own{k}x", 3)] for k in range(6)} | {7: passage, 8: ["own", *passage]}
    assert check(spark, docs)[8] == [1, 2, 3, 4, 5, 6]


def test_end_of_a_block(spark):
    a, b, c = line("a", 10), line("b", 10), line("c", 3)
    assert check(spark, {1: [a, b], 2: [a, b, c], 3: [c, a, b, c]})[3] == [1, 2, 3]


def test_first_holder_in_another_order(spark):
    x, y, z = line("x", 25), [line(f"y{k}x", 10) for k in range(4)], line("z", 25)
    assert check(spark, {1: [x, *y], 2: [x, *y], 3: [x, *y, z], 4: [z, x], 5: [*y, x, z]})[5] == [0, 1, 2, 3, 4, 5]


def test_random_documents(spark):
    rng = random.Random(5)
    pool = [line(f"l{k}x", rng.choice([2, 5, 9, 12, 25])) for k in range(14)]
    docs = {}
    for d in range(60):
        at = rng.randrange(len(pool) - 4)
        ls = pool[at : at + rng.randint(1, 4)] + rng.sample(pool, rng.randint(0, 3))
        docs[d] = ls + [line(f"own{d}x", 4)] if d % 2 else ls[::-1] + ls
    assert any(check(spark, docs).values())
