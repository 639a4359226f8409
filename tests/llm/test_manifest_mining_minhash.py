"""The Merkle manifest, hard negatives and MinHash classes against plain versions on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("earlywarn.llm.queries")
from earlywarn.llm import hard_negatives, merkle, minhash  # noqa: E402

DOCS = "doc_id long, source string, lang string, n_chars long, text string, root string, tree string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """The root, and for each leaf its place and siblings level by level."""
    seen, cover = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, covers = [], []
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            for j in range(len(run)):
                for x in cover[k + j]:
                    seen[x].append((j, run[:j] + run[j + 1 :]))
            above.append(digest(*run))
            covers.append(sum(cover[k : k + 3], []))
        nodes, cover = above, covers
    return nodes[0], seen


def plain_manifest(rows):
    def leaf(r, text):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))

    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    of = {}
    for s in names:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r, r[4]))))
        of[s] = plain_tree([leaf(r, r[4]) for r in trees[s]])
    root, top = plain_tree([of[s][0] for s in names])
    out = []
    for s, upper in zip(names, top, strict=True):
        for r, lower in zip(trees[s], of[s][1], strict=True):
            steps = lower + upper
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = leaf(r, r[4].replace("\n", "") if even and r[4] is not None else r[4])
            for j, others in steps:
                folded = digest(*others[:j], folded, *others[j:])
            out.append((r[0], leaf(r, r[4]), of[s][0], root, digest(*(x for _, others in steps for x in others)), folded, folded == root))
    return out


def test_manifest_equals_a_plain_one(spark):
    rng = random.Random(1)
    rows = [(i * 3, rng.choice(["a", "é", "z"]), None if i % 11 == 0 else "en", i, f"text {i}\n\nmore", "x", "y") for i in range(900)]
    rows += [(None, None, None, None, None, "x", "y"), (None, None, "en", 1, "", "x", "y"), (5, "lone", "en", 1, "t\n" * 30_000, "x", "y"), (7, "", "en", 1, "", "x", "y")]
    rows += [(9_999, "a", "en", 3, "same\nrow", "x", "y")] * 5 + [(9_999, "a", "en", 4, "same id", "x", "y")]
    # one source of more than two tiers of stretches
    rows += [(i, "many", "en", 1, str(i), "x", "y") for i in range(merkle.BLOCK * 4 + 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = [tuple(r) for r in merkle.manifest(df).drop("source").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(got, key=key) == sorted(plain_manifest(rows), key=key)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(1, "s", "en", 1, "t", "x", "y")], DOCS)
    r = merkle.manifest(df).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == digest()
    assert merkle.manifest(df.limit(0)).count() == 0


@pytest.mark.parametrize("total", [1, 2, 3, 4, 9, 10, 27, 82, 243])
def test_witnesses_of_an_appender(total):
    nodes = [hashlib.sha256(bytes([i])).digest() for i in range(total)]
    a = merkle.Appender(total)
    for n in nodes:
        a.append(n)
    root = a.finish()
    assert root.hex() == plain_tree([n.hex() for n in nodes])[0]
    assert all(merkle.fold(n, a.witness(i)) == root for i, n in enumerate(nodes))


def plain_mining(rows):
    ok = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, np.floor(np.array(v, float) * 256)) for i, v, lab, *_ in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for *_, v in ok), default=0)
    m = np.array([np.pad(v, (0, width - len(v))) for *_, v in ok]).astype(np.int64)
    ids = np.array([2**63 - 1 if i is None else i for i, *_ in ok])
    out = []
    for a, (i, lab, _) in enumerate(ok):
        if i is None or i % 50:
            continue
        score = m @ m[a]
        order = np.lexsort((ids, -score))
        near = [x for x in order if ok[x][1] == lab and x != a][:5]
        for p in near:
            rank = 0
            for x in order:
                if ok[x][1] != lab and 50 * score[p] <= 100 * score[x] <= 95 * score[p] and rank < 3:
                    rank += 1
                    out.append((i, ok[p][0], rank, ok[x][0], int(score[p]), int(score[x])))
    return out


def test_hard_negatives_equal_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TASK_BLOCKS", 2)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 20))
    rows = [(int(i), [float(x) for x in centre[i % 6] + rng.normal(scale=0.7, size=20)], int(i) % 6, "x", 1) for i in range(1500)]
    rows += [(i, [0.5] * 20, i % 3, "x", 1) for i in range(2000, 2300)]  # one vector a hundred times each label
    rows += [(3000, None, 1, "x", 1), (3050, [1.0] * 20, None, "x", 1), (3100, [float("nan")] * 20, 1, "x", 1), (3150, [float("inf")] + [0.0] * 19, 1, "x", 1), (3200, [None] * 20, 1, "x", 1)]
    rows += [(3250, [], 1, "x", 1), (3300, [0.5, 0.25], 2, "x", 1), (None, [0.5] * 20, 2, "x", 1), (3350, [0.4] * 20, -1, "x", 1), (100, [0.3] * 20, 2, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string, a int").repartition(6)
    plain = plain_mining([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], *r) for i, v, *r in rows])
    got = [tuple(r) for r in hard_negatives.mine(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain)) and len(got) > 100
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_bounds_hold_every_score():
    rng = np.random.default_rng(2)
    v = rng.integers(-500, 500, (60, 32)) * rng.integers(0, 3, (60, 1))
    r = hard_negatives.Rows(hard_negatives.pack(np.arange(60), np.arange(60), np.zeros(60, int), v))
    seen = []

    def useful(i, low, high):
        seen.append((low, high))
        return np.ones(high.shape, bool)

    i, j, score = hard_negatives._bounded(r, np.arange(60), r, np.arange(60), useful)
    assert (score == (v @ v.T)[i, j]).all() and len(i) == 3600
    for low, high in seen:
        flat = score if low.ndim == 1 else score.reshape(low.shape)
        assert (low <= flat).all() and (flat <= high).all()


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_classes(rows, k, num, den):
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and common * den >= num * (len(sets[i]) + len(sets[j]) - common) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((doc, len(sets[i]), component if sets[i] else doc, doc == (component if sets[i] else doc)))
    return out


def test_minhash_classes_equal_all_pairs(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 30, 120]))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(rng.choice([0, 0, 3])):  # chains of near copies around the threshold
            text = [rng.choice(words) if rng.random() < 0.06 else w for w in text]
            rows.append((len(rows), " ".join(text).upper()))
    group = [rng.choice(words) for _ in range(200)]
    for _ in range(150):  # a third of all rows: near copies
        near = list(group)
        near[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((len(rows), " ".join(near)))
    rows += [(len(rows) + i, f"the same start {i}") for i in range(40)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (None, "w1 w2 w3"), (None, "only null ids here"), (1003, "w1 w2 w3"), (1003, "w1 w2 w3"), (1004, "a " * 5000)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, key string").repartition(7)
    got = [tuple(r) for r in minhash.near_duplicates(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_classes(rows, 2, 4, 5)))
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_signatures_agree_as_sets_do():
    rng = np.random.default_rng(3)
    common, rest = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)
    sig = minhash.minima(np.concatenate([common, rest[:100], common, rest[100:]]), np.array([900, 0, 900]))
    assert abs((sig[0] == sig[2]).mean() - 0.8) < 0.08 and not sig[1].any()
    assert (minhash.bands(sig)[0] == minhash.bands(sig)[2]).any()
