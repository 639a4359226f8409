"""Operators that SQL cannot express, against plain versions that try everything."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("earlywarn.llm.queries")
from earlywarn.llm import html_extract, mixing, quotes, toxicity  # noqa: E402


def test_every_reading_of_a_span():
    model = toxicity.CharModel(Counter({w: 30 for w in "you are an idiot ass moron see the of".split()}))
    blank = " " * (toxicity.ORDER - 1)

    def readings(seen, h, cost, read):
        if not seen:
            yield (cost if h == blank else cost + model.cost(h, " ")), read
            return
        c, rest = seen[0], seen[1:]
        put = lambda x: (h + x)[-(toxicity.ORDER - 1) :]
        options = [(c, 0.0)] if c.isalpha() else [(x, toxicity.DISGUISE) for x in toxicity.LEET.get(c, "")]
        for x, extra in options:
            yield from readings(rest, put(x), cost + extra + model.cost(h, x), read + x)
            if h[-1] == x:
                yield from readings(rest, h, cost + toxicity.REPEAT, read)
        if c in toxicity.SEPARATORS:
            if h == blank:
                yield from readings(rest, h, cost, read)
            else:
                yield from readings(rest, h, cost + toxicity.GAP, read)
                yield from readings(rest, blank, cost + model.cost(h, " "), read + " ")
        elif c in toxicity.PUNCTUATION:
            yield from readings(rest, blank, cost if h == blank else cost + model.cost(h, " "), read + c)
        elif not options:
            yield from readings(rest, put(c), cost + model.cost(h, c), read + c)

    rng, decoded = random.Random(3), 0
    for _ in range(400):
        word = rng.choice(["idiot", "ass", "moron", "an ass", "you"])
        span = "".join(rng.choice([c, c, c + c, {"i": "1", "o": "0", "a": "4", "s": "$"}.get(c, c), c + " ", c + "."]) for c in word)
        if not any(c.isalpha() for c in span):
            continue
        every = list(readings(span, blank, 0.0, ""))
        best = min(cost for cost, _ in every)
        literal = sum(model.word_cost(w) for w in re.split(r"[ .\-_*!|+(]+", span) if w)
        if abs(best + toxicity.MARGIN - literal) < 1e-9:
            continue
        want = {span} if best + toxicity.MARGIN >= literal else {r for cost, r in every if cost < best + 1e-9}
        decoded += want != {span}
        assert toxicity.decode(span, model) in want, span
    assert decoded > 50


def test_best_region_of_every_run():
    rng = random.Random(4)
    weights = {"word": 0.5, "p": -0.75, "/p": -1.25, "div": -2.0, "word:a": -0.25}
    for _ in range(300):
        seq = [(t, "one two" if t.startswith("word") else "") for t in rng.choices(list(weights), k=rng.randrange(0, 25))]
        worth = [weights[t] * (2 if t.startswith("word") else 1) for t, _ in seq]
        sums = {(i, j): sum(worth[i:j]) for i in range(len(seq)) for j in range(i + 1, len(seq) + 1)}
        lo, hi = html_extract.best_region(seq, weights)
        assert sum(worth[lo:hi]) == max([0.0, *sums.values()])


def test_rounding_keeps_words_and_expectations():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(1, 7))
        size, part = rng.integers(1, 20, n), rng.uniform(0.05, 0.95, n)
        mean = np.zeros(n)
        for draw in (draws := rng.uniform(size=(4000, n))):
            got = mixing.pivotal(size, part, draw)
            assert math.isclose(float(got @ size), float(part @ size), rel_tol=1e-9) and ((got >= 0) & (got <= 1)).all()
            assert ((got > 1e-12) & (got < 1 - 1e-12)).sum() <= 1
            mean += got
        assert np.abs(mean / len(draws) - part).max() < 0.05


def test_mix_by_hand_count(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, "", "a b", "w " * rng.randrange(1, 400), "a b\tc\n d"]), rng.choice(["hot"] * 5 + ["b", "Z", None, "é"])) for i in range(1500)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    total = Counter()
    for i, s in source.items():
        total[s] += size[i]
    weight = dict(zip(sorted(total, key=lambda s: (s is None, s or "")), itertools.cycle((3, 1, 2))))
    target, open_ = {}, set(total)
    while True:  # shares of what is left until no source is above its stop
        left = 1.5 * sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            break
        target |= {s: 2.0 * total[s] for s in over}
        open_ -= over
    target |= share if open_ else {}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert (r.size, r.source_size) == (size[i], total[source[i]]) and math.isclose(r.target, target[source[i]], rel_tol=1e-9)
        assert r.taken == r.copies * size[i] <= 2 * size[i]
    for s in total:
        taken = sum(r.taken for i, r in got.items() if source[i] == s)
        assert abs(taken - target[s]) <= max(size[i] for i in size if source[i] == s)


def replies(rows):
    """Parents, depths and positions of messages given as distinct (conv, turn, role, text), turn by turn."""
    fold = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", " ", t.lower()).strip(" ")
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        said, written, children, parent, facts = [], [], {}, {}, {}
        for k, (_, _, _, text) in enumerate(mine):
            lines = [(re.match(r"[ \t]*(?:>[ \t]*)*", x)[0], x) for x in (text or "").split("\n")]
            own = "\n".join(x for m, x in lines if ">" not in m).strip(" ")
            runs = [(level, fold("\n".join(x[len(m) :] for m, x in g))) for level, g in ((lv, list(g)) for lv, g in itertools.groupby(lines, key=lambda v: v[0].count(">"))) if level]
            parts = [[fold(x[len(m) :]) for m, x in g] for lv, g in ((lv, list(g)) for lv, g in itertools.groupby(lines, key=lambda v: v[0].count(">"))) if lv]
            parts = [[x for x in part if x] for part in parts]
            holds = lambda j, n, t: t in said[j] or (parts[n] and any(written[j][i : i + len(parts[n])] == parts[n] for i in range(len(written[j]))))  # noqa: B023, E731
            sources = [[j for j in range(k) if holds(j, n, t)] for n, (_, t) in enumerate(runs)]
            found = [(level, n, max(sources[n])) for n, (level, _) in enumerate(runs) if sources[n]]
            said.append({fold(p) for p in [own, *re.split(r"\n{2,}", own), *own.split("\n")]} - {""})
            written.append([x for x in map(fold, own.split("\n")) if x])
            parent[k] = min(found)[2] if found else k - 1 if k else None
            children.setdefault(parent[k], []).append(k)
            facts[k] = (own, len(runs), len(found))
        stack, place = [(0, 0)], 0
        while stack:
            k, depth = stack.pop()
            place += 1
            out[conv, mine[k][1]] = (*facts[k], mine[parent[k]][1] if parent[k] is not None else None, depth, place)
            stack += [(x, depth + 1) for x in reversed(children.get(k, []))]
    return out


def test_runs_of_lines_link(spark):
    told = "First of three\nsecond of three\nthird of three\n\nAnother paragraph\nof two lines\n\nThe end"
    quoted = ["> first of THREE\n> second of three\nA", "> second of three\n> third  of three\n>\n> another paragraph\nB", "> first of three\n> third of three\nC", "> another paragraph of\n> two lines\nD", ">\n>\nE", "> of two lines\n> the end\n>\n> more\nF"]
    rows = [("x", 0, "user", told), ("y", 0, "user", "other"), *(("x", i + 1, "assistant", q) for i, q in enumerate(quoted)), ("y", 1, "user", quoted[0])]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.text, r.n_quotes, r.n_linked, r.parent_turn, r.depth, r.position) for r in quotes.link_quotes(df).collect()}
    assert [got["x", i][2] for i in range(1, 7)] == [1, 1, 0, 1, 0, 0] and got["y", 1][2] == 0
    assert [got["x", i][3] for i in range(1, 7)] == [0, 0, 2, 0, 4, 5]
    assert got == replies(rows)


def test_runs_roll_as_they_are_computed_afresh():
    values = quotes.line_values("a\nB  b\n\n c\nb b\nc\nd")
    assert len(values) == 6 and list(quotes.runs_of(values, 2))[1] == list(quotes.runs_of(values, 2))[3]
    for k in range(1, 8):
        assert list(quotes.runs_of(values, k)) == [next(quotes.runs_of(values[i : i + k], k)) for i in range(len(values) - k + 1)]


@pytest.mark.parametrize("ranges", [1, 7])
def test_replies_by_brute_force(spark, ranges):
    rng, rows = random.Random(8), []
    for conv, length in [("hot", 150), (None, 12), *((f"c{i}", rng.randrange(1, 9)) for i in range(25))]:
        texts = []
        for turn in range(length):
            lines = [rng.choice(["Yes", "thanks  a lot", f"point {rng.randrange(30)}", "", "a > b"]) for _ in range(rng.randrange(1, 5))]
            if texts and rng.random() < 0.6:
                old = rng.choice(texts).split("\n")
                start = rng.randrange(len(old))
                piece = rng.choice([old, [rng.choice(old)], old[start : start + 2], ["never said"]])
                lines = [rng.choice(["> ", ">", " > > "]) + x.upper() for x in piece] + lines
            texts.append("\n".join(lines))
            rows.append((conv, turn, rng.choice(["user", "assistant"]), texts[-1]))
    want = replies(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows + rows[:20], "conv_id string, turn long, role string, text string").repartition(5)
        got = quotes.link_quotes(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows) + 20
    assert {(r.conv_id, r.turn): (r.text, r.n_quotes, r.n_linked, r.parent_turn, r.depth, r.position) for r in got} == want
    assert max(v[4] for v in want.values()) > 5 and sum(v[2] for v in want.values()) > 60
