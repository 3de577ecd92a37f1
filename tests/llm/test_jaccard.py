import random

from wayloom.llm import jaccard as op


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[find(i)] = min(key, low.get(find(i), key))
    return sorted(str((key, len(sets[i]), low.get(find(i)) if sets[i] else key)) for i, (key, _) in enumerate(rows))


def found(docs):
    return sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in op.near_duplicates(docs).collect())


def test_near_copies_chains_and_common_passages(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    common = [rng.choice(words) for _ in range(40)]
    rows = []
    for base in range(4):
        text = [rng.choice(words) for _ in range(rng.choice((12, 60, 200)))]
        chain = list(text)
        for _ in range(30):
            edited = list(text)
            for _ in range(rng.randrange(3)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            rows.append(edited)
        for _ in range(12):  # each a little further from the first
            chain[rng.randrange(len(chain))] = rng.choice(words)
            rows.append(list(chain))
    for _ in range(60):
        own = [rng.choice(words) for _ in range(rng.randrange(1, 30))]
        rows.append(own[: len(own) // 2] + common + own[len(own) // 2 :])
    rows += [["a"], ["a"], ["a", "b"], ["A", "B"], ["a", "b", "c"]]
    rng.shuffle(rows)
    data = [(i, " ".join(r)) for i, r in enumerate(rows)]
    assert found(spark.createDataFrame(data, "doc_id long, text string")) == brute(data)


def test_hard_rows(hard_docs):
    assert found(hard_docs) == brute([(r["doc_id"], r["text"]) for r in hard_docs.collect()])
    kept = op.drop_near_duplicates(hard_docs)
    assert kept.columns == hard_docs.columns
    assert sorted(str(r["text"])[:20] for r in kept.collect()) == sorted(
        ["None", "", "   \n\n ", "One two three four five"[:20], "another text under t", "a text without an id", ("x " * 60_000)[:20], "é" * 20, "Word"]
    )
    assert found(hard_docs.limit(0)) == [] and op.drop_near_duplicates(hard_docs.limit(0)).count() == 0


def test_sizes_and_thresholds_match_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for n in (6, 30, 90):
        text = [rng.choice(words) for _ in range(n)]
        for _ in range(40):
            edited = list(text)
            for _ in range(rng.randrange(4)):
                edited[rng.randrange(n)] = rng.choice(words)
            rows.append(edited + [rng.choice(words) for _ in range(rng.randrange(n // 3))])
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    for size, percent in ((5, 80), (2, 60)):
        sets = [{tuple(r[i : i + size]) for i in range(max(1, len(r) - size + 1))} for r in rows]
        low = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if low[i] != low[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    low = [min(low[i], low[j]) if x in (low[i], low[j]) else x for x in low]
        got = {r["doc_id"]: r["component_id"] for r in op.near_duplicates(docs, percent=percent, size=size).collect()}
        assert [got[i] for i in range(len(rows))] == low and len(set(low)) < len(rows)
