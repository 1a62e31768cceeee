"""Queries that SQL cannot express, against plain versions of themselves over the same tables."""

import random
from collections import Counter

from loomnote.operators import curation, distill, graph, order, resolve
from loomnote.plans import curation as plans
from loomnote.plans import graphs

from .conftest import SF


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_procedure_clusters(spark):
    rows = [r for r in plans.procedure_items(spark, SF).collect() if len(r["commands"]) >= 3]
    first: dict = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        first.setdefault(frozenset(r["commands"]), r["id"])
    clusters: list = []
    for signature in sorted(first, key=first.get):
        home = next((c for c in clusters if any(jaccard(signature, m) >= 0.4 for m in c)), None)
        home.append(signature) if home is not None else clusters.append([signature])
    want = set()
    for c in clusters:
        members = [r for r in rows if frozenset(r["commands"]) in c]
        if len(members) >= 3 and len({r["session"] for r in members}) >= 2 and any(r["ok"] for r in members):
            want |= {(first[c[0]], r["id"]) for r in members}
    assert want and {(r["cluster"], r["id"]) for r in plans.procedure_clusters(spark, SF).collect()} == want


def test_thread_clusters(spark):
    groups: dict = {}
    for r in plans.thread_items(spark, SF).collect():
        groups.setdefault(r["group"], []).append((r["day"], r["id"], frozenset(r["entities"])))
    want = set()
    for g, items in groups.items():
        runs = [[x] for x in sorted(items, key=lambda x: x[:2])]
        changed = True
        while changed:
            changed, out, k = False, [], 0
            while k < len(runs):
                if k + 1 < len(runs):
                    a, b = (frozenset().union(*[x[2] for x in r]) for r in runs[k : k + 2])
                    if a and b and jaccard(a, b) >= 0.5 and (runs[k + 1][0][0] - runs[k][-1][0]).days <= 7:
                        out.append(runs[k] + runs[k + 1])
                        k, changed = k + 2, True
                        continue
                out.append(runs[k])
                k += 1
            runs = out
        for r in runs:
            for s in range(0, len(r), 30):
                if len(r[s : s + 30]) >= 3:
                    want |= {(g, r[s][1], x[1]) for x in r[s : s + 30]}
    assert want and {(r["group"], r["cluster"], r["id"]) for r in plans.thread_clusters(spark, SF).collect()} == want


def plain_communities(edges, rounds=20):
    near: dict = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    label = {n: n for n in near}
    for _ in range(rounds):
        before = dict(label)
        for n in sorted(near):
            count = Counter(label[m] for m in near[n])
            label[n] = min(x for x, c in count.items() if c == max(count.values()))
        if label == before:
            break
    want: dict = {}
    for x in set(label.values()):
        members = [n for n in label if label[n] == x]
        if len(members) >= 2:
            want |= dict.fromkeys(members, min(members))
    return want


def test_communities(spark):
    want = plain_communities([tuple(r) for r in graphs.page_links(spark, SF).collect()])
    assert len(set(want.values())) > 5 and {r["path"]: r["community"] for r in graphs.communities(spark, SF).collect()} == want


def test_communities_of_one_component(spark):
    rng = random.Random(3)
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(18)] + [(f"n{rng.randrange(19):02}", f"n{rng.randrange(19):02}") for _ in range(14)]
    for rounds in (1, 20):
        got = graph.communities(spark.createDataFrame(edges, "from_path string, to_path string"), rounds).collect()
        assert {r["path"]: r["community"] for r in got} == plain_communities(edges, rounds)
    assert graph.communities(spark.createDataFrame([], "from_path string, to_path string")).count() == 0


def test_falling_least_and_first_heads(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)} | {(i, i + 1) for i in range(60, 72)}
    df = spark.createDataFrame(sorted(pairs), "low long, high long")
    root, head = {}, {}
    for n in sorted({x for p in pairs for x in p}):
        root[n] = min([n, *[root[a] for a, b in pairs if b == n]])
        head[n] = min((a for a, b in pairs if b == n and head[a] == a), default=n)
    assert {r["node"]: r["root"] for r in graph.falling_least(df).collect()} == {n: r for n, r in root.items() if r != n}
    assert {r["id"]: r["head"] for r in graph.first_heads(df).collect()} == head
    assert graph.falling_least(df.limit(0)).count() == 0 == graph.first_heads(df.limit(0)).count()


def test_facts_merge_equals_the_sequential_one(spark):
    rng = random.Random(6)
    kinds = "session long, seq long, title string, importance long, facts array<string>, type string, narrative string, extra string"
    facts = [(s, i, rng.choice([" ".join(rng.sample("abcdefg", rng.randrange(0, 6))), None]) if i % 9 == 0 else " ".join(rng.sample("abcdefg", rng.randrange(1, 6))), rng.randrange(9), [f"f{rng.randrange(5)}"], rng.choice(["fact", "rule", None]), f"n{rng.randrange(3)}", "x") for s in (1, 2, None) for i in range(30)]
    want = []
    for s in (1, 2, None):
        heads: list = []
        for _, seq, title, importance, own, kind, told, _ in [f for f in facts if f[0] == s]:
            words = set((title or "").split())
            head = next((h for h in heads if words and h["words"] and jaccard(words, h["words"]) >= 0.5), None)
            if head is None:
                head = {"words": words, "row": [s, seq, title, 0, importance, [], kind, []]}
                heads.append(head)
            row = head["row"]
            row[3:5] = [row[3] + 1, max(row[4], importance)]
            row[5] += [x for x in own if x not in row[5]]
            row[6] = kind if row[6] in (None, "fact") and kind not in (None, "fact") else row[6] or kind
            row[7] += [told] * (told not in row[7])
        want += [(*h["row"][:5], tuple(h["row"][5]), h["row"][6], "\n".join(h["row"][7])) for h in heads]
    got = distill.merge_facts(spark.createDataFrame(facts, kinds), 0.5).collect()
    assert sorted(((r["session"], r["seq"], r["title"], r["members"], r["importance"], tuple(r["facts"]), r["type"], r["narrative"]) for r in got), key=str) == sorted(want, key=str)


def test_ranks_and_sums_by_ranges(spark):
    rows = [(g, i, (i * 7919) % 1000, i % 5) for g in ("a", "b", None) for i in range(700 if g == "a" else 40)]
    df = spark.createDataFrame(rows, "g string, id long, x long, size long")
    got = {(r["g"], r["id"]): (r["rank"], r["upto"]) for r in order.running(df, ["g"], ["x", "id"], rank="1L", upto="size").collect()}
    for g in ("a", "b", None):
        own, total = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])), 0
        for n, r in enumerate(own, 1):
            total += r[3]
            assert got[g, r[1]] == (n, total)
    assert order.rank(df.limit(0), ["g"], ["x"]).count() == 0
    assert sorted(r["rank"] for r in order.rank(df, [], ["x", "g", "id"]).collect()) == list(range(1, 781))


def test_similar_sets(spark):
    import random

    rng = random.Random(5)
    sets = {i: frozenset(rng.sample("abcdefghijklmnop", rng.randrange(1, 8))) for i in range(120)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, items array<string>")
    for like in (0.1, 0.4, 0.75, 1.0):
        want = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= like}
        assert {(r["left_id"], r["right_id"]) for r in resolve.similar_sets(df, like).collect()} == want


def test_batches_are_those_of_plain_packing(spark):
    rows = [("k", i, 1 + i * 37 % 90) for i in range(500)]
    got = {r["id"]: r["batch"] for r in curation.batches(spark.createDataFrame(rows, "kind string, id long, tokens long"), 7, 200, share=128).collect()}
    n = docs = tokens = 0
    for place, (_, i, t) in enumerate(rows):
        if place % 128 == 0:
            n, docs, tokens = 0, 0, 0
        elif docs >= 7 or tokens + t > 200:
            n, docs, tokens = n + 1, 0, 0
        docs, tokens = docs + 1, tokens + t
        assert got[i] == f"{place // 128}-{n}"


def test_components_of_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0
