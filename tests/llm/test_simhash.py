import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as C
from blockflow.llm import simhash as S
from tests.llm.cases import SCHEMA, edge_texts, prose, rows


def brute_fp(text, k=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_query_matches_brute_force(spark):
    base = prose(5, 300)
    near = [re.sub(r"^(\S+)", f"w{k}", base, count=1) for k in range(5)] + [base + f" extra{k}" for k in range(5)]
    texts = edge_texts() + near + [prose(k, 150) for k in range(20, 40)]
    out = {r.doc_id: r for r in S.near_duplicates(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    fps = [brute_fp(t) for t in texts]
    assert [out[i].fp & (2**64 - 1) for i in range(len(texts))] == fps
    assert [out[i].component_id for i in range(len(texts))] == brute_components(fps)


def links_of(spark, fps, bits=4):
    codes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    got = {r.node: r.root for r in S.components(S.links(codes, bits)).collect()}
    return [got.get(i, i) for i in range(len(fps))]


def clusters(seed, n, far=12):
    r = random.Random(seed)
    out = set()
    for _ in range(n // 60):
        c = r.getrandbits(64)
        for _ in range(40):
            x = c
            for _ in range(r.randint(0, far)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    while len(out) < n:
        out.add(r.getrandbits(64))
    out = list(out)
    r.shuffle(out)
    return out


def test_links_on_clusters(spark):
    fps = clusters(3, 700)
    assert links_of(spark, fps) == brute_components(fps)


def test_hot_nodes_are_split_exactly(spark, monkeypatch):
    monkeypatch.setattr(S, "NODE", 64)
    r = random.Random(9)
    center = r.getrandbits(64)
    fps = {center}
    while len(fps) < 400:  # one dense ball: every top-level node is hot
        x = center
        for _ in range(r.randint(1, 9)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    fps = list(fps)
    assert links_of(spark, fps) == brute_components(fps)


def test_index_prunes_only_far_pairs():
    fps = np.array(sorted(clusters(4, 900), key=lambda x: x), np.uint64)
    node = np.zeros(len(fps), np.int64)
    got = {(int(a), int(b)) for i, j in S.linked(node, fps, 4) for a, b in zip(i, j)}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    assert got == want


def test_gray_rank(spark):
    g = [(i ^ i >> 1, i) for i in range(64)]
    out = spark.createDataFrame(g, "code long, rank long").select("rank", S.gray_rank(F.col("code")).alias("r")).collect()
    assert all(x.r == x["rank"] for x in out)


def test_empty_nulls_and_clashes(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "a b", "z", 1), (3, "a b", "z", 2), (3, "a b", "z", 3)], "doc_id long, text string, fp string, node int")
    assert sorted(str(r.component_id) for r in S.near_duplicates(df).collect()) == ["3", "3", "3"]


def test_rows_without_an_id_carry_links_and_repeated_ids_do_not(spark):
    r = random.Random(5)
    fps = [0x0F, 0, 0xF00, *(x - (1 << 64) if x >> 63 else x for x in clusters(6, 60))]
    given = [(1, fps[0]), (None, fps[1]), (2, fps[2]), (None, fps[1]), (5, fps[20]), (5, fps[21])]
    given += [(r.choice([None, r.randrange(40)]), f) for f in fps[3:] for _ in range(r.randint(1, 2))]
    root = list(range(len(given)))
    for i, (_, a) in enumerate(given):
        for j, (_, b) in enumerate(given):
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    want = []
    for (i, f), g in zip(given, root):
        ids = [k for (k, _), x in zip(given, root) if x == g and k is not None]
        want.append((i, f, min(ids, default=None)))
    got = [tuple(x) for x in S.grouped(spark.createDataFrame(given, "doc_id long, fp long")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_copies_by_checked_links(spark):
    r = random.Random(2)
    texts, group = [], []
    for g in range(6):
        words = prose(100 + g, 260).split()
        for _ in range(5):
            w = list(words)
            for _ in range(3):  # three edits: similarity about 0.89
                w[r.randrange(len(w))] = f"edit{r.randrange(999)}"
            texts.append(" ".join(w))
            group.append(g)
    texts += [prose(200 + k, 200) for k in range(12)] + [None, "", "short one", texts[0]]
    group += list(range(10, 22)) + [30, 30, 31, 0]
    out = {x.doc_id: x.component_id for x in S.near_copies(spark.createDataFrame(rows(texts), SCHEMA), least=0.7).collect()}
    assert len(out) == len(texts)
    assert [out[i] for i in range(len(texts))] == [group.index(g) for g in group]


def test_sketch_estimates_similarity():
    a = prose(7, 400).split()
    b = a[:200] + prose(8, 400).split()[200:]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    true = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    s = [np.frombuffer(S.sketch_of(" ".join(x)), np.uint8)[None] for x in (a, b)]
    assert abs(S.similarity(*s)[0] - true) < 0.2


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_copies_find_replaced_and_appended_passages(spark, monkeypatch):
    monkeypatch.setattr(S, "NODE", 16)  # nodes of some texts are divided
    texts, want = [], []
    for g in range(150):
        w = prose(1000 + 3 * g, 400).split()
        other = prose(1001 + 3 * g, 400).split()
        new = w + other[:90] if g % 2 else w[:150] + other[:36] + w[186:]
        assert len(grams(" ".join(w)) & grams(" ".join(new))) / len(grams(" ".join(w)) | grams(" ".join(new))) >= 0.8
        texts += [" ".join(w), " ".join(new)]
        want += [2 * g, 2 * g]
    out = {x.doc_id: x.component_id for x in S.near_copies(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert [out[i] for i in range(len(texts))] == want


def test_stage_keeps_texts_below_the_bound(spark):
    texts = []
    for g in range(60):
        w = prose(5000 + 2 * g, 300).split()
        new = w[:100] + prose(5001 + 2 * g, 300).split()[: 48] + w[148:]  # similarity 0.7 to 0.75
        assert 0.65 <= len(grams(" ".join(w)) & grams(" ".join(new))) / len(grams(" ".join(w)) | grams(" ".join(new))) < 0.8
        texts += [" ".join(w), " ".join(new)]
    kept = C.near_duplicates(spark, spark.createDataFrame(rows(texts), SCHEMA), "")
    assert sorted(x.doc_id for x in kept.collect()) == list(range(len(texts)))


def test_divided_nodes_compare_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "NODE", 8)
    base = prose(77, 300).split()
    texts = []
    for k in range(40):  # a chain: neighbours are near copies, the ends share little
        w = list(base)
        for at in range(0, 300, 60):
            w[at : at + k] = [f"x{at + i}" for i in range(k)]
        texts.append(" ".join(w))
    root = list(range(40))
    for i in range(40):
        for j in range(i):
            if len(grams(texts[i]) & grams(texts[j])) / len(grams(texts[i]) | grams(texts[j])) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r == max(a, b) else r for r in root]
    out = {x.doc_id: x.component_id for x in S.near_copies(spark.createDataFrame(rows(texts), SCHEMA), least=0.8).collect()}
    assert [out[i] for i in range(40)] == root


def test_families_that_the_hub_does_not_join(spark, monkeypatch):
    """Copies at every distance from one text: the node decides the pairs that the hub leaves open."""
    base = prose(78, 200).split()
    r = random.Random(5)
    texts = []
    for k in range(160):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(200)] = f"y{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += ["", None, " "]
    sets = [grams(t or "") for t in texts]
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.8 if a or b else True
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert len(set(root)) > 5
    df = spark.createDataFrame(rows(texts), SCHEMA)
    for node, weight in ((4096, 2_000_000), (16, 2_000_000), (4096, 500)):
        monkeypatch.setattr(S, "NODE", node)
        monkeypatch.setattr(S, "WEIGHT", weight)
        out = {x.doc_id: x.component_id for x in S.near_copies(df).collect()}
        assert [out[i] for i in range(len(texts))] == root


def test_stage_on_repeated_rows_and_ids(spark):
    a, b = prose(300, 80), prose(301, 80)
    data = [(1, a), (1, a), (1, b), (2, b), (2, prose(302, 90)), (None, a), (None, prose(303, 70)), (None, prose(303, 70)), (3, None), (4, ""), (None, "")]
    df = spark.createDataFrame([(i, t, "g", 1) for i, t in data], "doc_id long, text string, its_id string, _gone int").repartition(3)
    out = C.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, a), (1, b), (2, prose(302, 90)), (None, prose(303, 70)), (3, None)], key=str)


def test_near_nodes_are_groups_of_linked_fingerprints(spark):
    given = [(1, 10, 0x0F), (2, 10, 0), (3, 10, 0xF00), (4, 10, 0xFF << 40), (5, 10, 0xFF << 40), (6, 10, 0xFFFF << 20)]
    out = S.near_nodes(spark.createDataFrame(given, "code long, size int, fp long")).collect()
    groups = {}
    for x in out:
        groups.setdefault(x.node, set()).add(x.code)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5]] and {x.size for x in out} == {10}


def test_near_copies_take_candidates_from_the_fingerprint_index(spark, monkeypatch):
    """With one band of all minima only the fingerprints find copies of similarity 0.95."""
    monkeypatch.setattr(S, "ROWS", S.BINS)
    r, base, found = random.Random(5), prose(77, 400).split(), []
    code = lambda t: S.voted(S.shingles_of(t))
    own = S.minima_of(S.shingles_of(" ".join(base)))
    while len(found) < 6:
        w = list(base)
        for _ in range(2):
            w[r.randrange(len(w))] = f"edit{r.randrange(999)}"
        t = " ".join(w)
        if (code(t) ^ code(" ".join(base))).bit_count() <= 4 and not np.array_equal(S.minima_of(S.shingles_of(t)), own):
            found.append(t)
    texts = [" ".join(base), *found, prose(78, 400)]
    out = {x.doc_id: x.component_id for x in S.near_copies(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert out == {**dict.fromkeys(range(7), 0), 7: 7}
