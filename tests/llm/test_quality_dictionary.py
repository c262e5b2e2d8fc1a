"""The quality dictionaries hold pieces of whole texts, not only their beginnings."""

import numpy as np

from auditloom.llm import op08_quality as quality


def test_what_comes_late_is_learned():
    rng = np.random.default_rng(3)
    plain = [f"plain{i}" for i in range(300)]
    marks = {y: [f"{'good' if y else 'bad'}{i}x{i * i}" for i in range(60)] for y in (0, 1)}
    text = lambda y: " ".join([*rng.choice(plain, 300), *rng.choice(marks[y], 150)])
    rows = [(text(i % 2), i % 2) for i in range(180)]
    s = quality.Scorer(quality.fit(rows, dict_bytes=20_000))
    for _ in range(10):
        assert s.score(text(1)) > 0.7 > 0.3 > s.score(text(0))


def test_dictionary_is_bounded_and_spread():
    texts = [bytes([65 + i % 26]) * n for i, n in enumerate([0, 10, 300, 5000, 20_000] * 8)]
    texts = [t for t in texts if t]
    assert quality._dictionary(texts, 1 << 20) == b"\n".join(texts)
    assert quality._dictionary([], 100) == b""
    for size in (5000, 60_000):
        assert size // 2 < len(quality._dictionary(texts, size)) <= size
    one = b"".join(b"%06d" % i for i in range(10_000))
    got = [int(x[6:12]) // 100 for x in quality._dictionary([one] * 30, 9000).split(b"\n")]
    assert min(got) < 10 and max(got) >= 90
