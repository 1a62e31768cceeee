"""What is new in texts, found within a row: against all pairs of pieces, with several old texts, and without tables of pieces."""

import random
import re

from loomnote.operators import distill


def words(part):
    norm = re.sub(r"\s+", " ", re.sub(r"[`*_~\[\]()#>:.-]+", " ", part)).strip().lower()
    return norm, {w for w in norm.split(" ") if len(w) > 2}


def parts(text):
    blocks = [b.strip() for b in re.split(r"\n\s*\n", text) if b.strip()]
    return [(k, [(True, b), *((False, x.strip()) for x in b.split("\n"))]) for k, b in enumerate(blocks)]


def test_equals_all_pairs_and_writes_nothing(spark, monkeypatch):
    monkeypatch.setattr(distill, "written", lambda *a: 1 / 0)
    r = random.Random(3)
    text = lambda: "\n\n".join("\n".join(" ".join(r.choice("alpha beta gamma delta eps zeta of 10 20".split()) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 4)))
    new = [(i, text()) for i in range(40)] + [(98, None), (99, "all of it is new")]
    old = [(i, text()) for i in range(40) for _ in range(i % 3)] + [(7, None), (500, "x")]
    want = {}
    for key, body in new:
        olds = [words(p) + (w,) for k, o in old if k == key and o for w, p in [*((True, b.strip()) for b in re.split(r"\n\s*\n", o) if b.strip()), *((False, x.strip()) for x in o.split("\n"))]]
        fresh = lambda head, p: words(p)[1] and not any((n == words(p)[0] and w == head) or 100 * len(s & words(p)[1]) >= 80 * len(words(p)[1]) for n, s, w in olds if n)  # noqa: B023, E731
        blocks = [[p for head, p in ps[1:] if fresh(head, p)] for _, ps in parts(body or "") if fresh(*ps[0])]
        if any(blocks):
            want[key] = "\n\n".join("\n".join(b) for b in blocks if b)
    got = distill.net_new(spark.createDataFrame(new, "key int, body string"), spark.createDataFrame(old, "key int, body string"), "key")
    assert len(want) > 5 and {x["key"]: x["fresh"] for x in got.collect()} == want
