"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation on every word of the training text.

Vocabulary. The commonest words of the training text (and the end mark) are outcomes of their own; every other word belongs to a class given by its
last two bytes. ``outcome_sizes`` says how many words and classes there are: both grow with the root of the bytes of text. The neural model gives the
normalised probability of an outcome after the two outcomes before it (end marks before the first word); a word of a class then has the add-one share
of its count in the class:

    log p(word) = log p_model(outcome | context) + [word outside the shortlist] log((count + 1) / (N_class + V_class + 1))

An unseen word counts as the one unseen type of its class, as in the add-one base score. The model is log-bilinear: the prediction vector is the sum of the
context vectors, each times its position's weights. Outcomes are ordered by count and cut into about ``sqrt(size)`` groups; p(outcome) is
p(group) p(outcome | group), each a softmax of products with the prediction vector, so a normalised probability costs about ``2 sqrt(size)`` products.

Training is noise-contrastive estimation of both factors, in numpy inside Spark tasks: the training text is dealt into shards by a hash, and in each of
``ROUNDS`` rounds every shard trains a copy of the model on its next part. The copies' changes are averaged row by row over the shards that changed the row.
Every position of the training text is an example, none is left out; a text of fewer than ``EXAMPLES`` is passed over again until it has given so many, the last time in part. Equal examples of a shard
(an outcome after the same two) are trained together, weighted by how often they occur, since the likelihood only depends on these counts.
Held-out documents (crc32 of the id as text, mod 7, is 2) only ask for counts.

Plan.
1. Documents are dealt into blocks of about ``BLOCK_BYTES`` of text by a hash of their id and text. A block lists its distinct words once, with their counts in
   training documents, packed by hash range into a few binary rows.
2. Each range sums its words over all blocks and answers every block, in the order asked, with total counts. Sums of N, V and the classes, and the
   range's commonest words, leave it as one small row. A block sends no row to a range it has no word for, so there are never more rows than words of blocks.
3. Each round shuffles its part of the training text to the shards once; the changes of the model are summed in about ``sqrt(shards)`` tasks before
   they reach the driver, which holds a few models at a time and no counts of the corpus.
4. Documents and answers meet by block, and each block is scored. A block is bounded by ``BLOCK_BYTES`` or one text.

Defined cases: null and empty texts have the end mark only; a null id is a training row; repeated rows count and score each for itself; without training text every count is 0 and the
model is uniform; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.llm import textkit as tk
from earlywarn.llm.storage import input_bytes, materialize

#: The least numbers of words and classes that are outcomes.
SHORTLIST = 384
CLASSES = 64
BLOCK_BYTES = 8 << 20
RANGE_BYTES = 8 << 20
#: Text of a shard in one round, and the number of rounds.
SHARD_BYTES = 6 << 20
ROUNDS = 4
#: Noise outcomes to an example: groups, and outcomes of the example's group.
NOISE = 16
NOISE_WITHIN = 4
DIMENSION = 32
#: The least number of examples: smaller texts are passed over several times, larger ones once.
EXAMPLES = 3_000_000
#: The most equal examples that are one step's row; of more there are several rows.
TOGETHER = 8
BATCH = 4096
SEED = 7
#: The hash that stands for the end mark; no word hashes to it but by a chance of 2**-64.
END = np.uint64(0xE0D0E0D0E0D0E0D1)


def held_out(doc_id):
    """Whether a row is held out: crc32 of the id as text, mod 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def outcome_sizes(text_bytes: int) -> tuple[int, int]:
    """How many words, and how many classes of other words, are outcomes in a corpus of so many bytes of text."""
    root = math.isqrt(text_bytes)
    return max(SHORTLIST, root // 6), min(max(CLASSES, root // 160), 1 << 16)


def _classes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, classes: int) -> np.ndarray:
    """Class of each word: a hash of its last two bytes and of whether it has two."""
    last = buf[end - 1].astype(np.uint64)
    before = np.where(end - start > 1, buf[np.maximum(end - 2, 0)], 0).astype(np.uint64)
    return (tk.mix(last * np.uint64(257) + before) % np.uint64(classes)).astype(np.uint16)


def _stream(column: pa.Array, classes: int) -> Iterator[tuple[int, int, tk.Words, np.ndarray, np.ndarray]]:
    """Rows, words, hashes and classes of each chunk of a column."""
    for lo, hi, buf, off in tk.chunks(column):
        w = tk.words(buf, off)
        yield lo, hi, w, tk.word_hashes(w), _classes(w.buf, w.start, w.end, classes)


def _merge(hashes: list[np.ndarray], counts: list[np.ndarray], classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, their summed counts and their class."""
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, np.uint16)
    keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(keys))
    return keys, np.rint(total).astype(np.int64), np.concatenate(classes)[first]


def _block_words(text: pa.Array, learn: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a block with their counts in its training rows."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo, hi, w, h, k in _stream(text, classes):
        end_rows = int(learn[lo:hi].sum())
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True) if len(h) else (h, np.zeros(0, np.int64), np.zeros(0, np.int64))
        n = np.bincount(inverse, weights=learn[lo:hi][w.row].astype(np.float64), minlength=len(keys))
        parts.append((np.append(keys, END), np.append(n, end_rows), np.append(k[first], np.uint16(0))))
        if len(parts) >= 32:
            parts = [_merge(*map(list, zip(*parts, strict=True)))]
    return _merge(*map(list, zip(*parts, strict=True))) if parts else _merge([], [], [])


def _ask(ranges: int, classes: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        learn = ~table.column("out").to_numpy().astype(bool)
        h, n, k = _block_words(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()), learn, classes)
        part = (h % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(ranges + 1))
        rows = [(r, order[cut[r] : cut[r + 1]]) for r in range(ranges) if cut[r + 1] > cut[r]]
        block = int(key[0].as_py())
        return pa.table(
            {
                "range": pa.array([r for r, _ in rows], pa.int32()),
                "block": pa.array([block] * len(rows), pa.int32()),
                "words": pa.array([h[i].tobytes() for _, i in rows], pa.binary()),
                "counts": pa.array([tk.narrow(n[i]).tobytes() for _, i in rows], pa.binary()),
                "classes": pa.array([k[i].tobytes() for _, i in rows], pa.binary()),
            }
        )

    return run


ASKED = "range int, block int, words binary, counts binary, classes binary"
ANSWERED = "block int, range int, totals binary, sums binary, top binary"


def _answer(ranges: int, shortlist: int, classes: int):
    """Total counts for every block that asked this range, and one row (block -1) of sums and commonest words."""
    # words are dealt to ranges by hash: more of the shortlist than ten deviations above the mean do not meet in one
    mean = (shortlist + 1) / ranges
    most = min(shortlist + 1, math.ceil(mean + 10 * math.sqrt(mean) + 20))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        words = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("words")]
        counts = [tk.widen(b.as_py()) for b in table.column("counts")]
        kinds = [np.frombuffer(b.as_py(), np.uint16) for b in table.column("classes")]
        h, total, k = _merge(words, counts, kinds)
        known = total > 0
        word = known & (h != END)
        sums = np.concatenate([np.bincount(k[word], weights=total[word], minlength=classes), np.bincount(k[word], minlength=classes), [total.sum(), known.sum()]]).astype(np.int64)
        common = np.lexsort((h, -total))[:most]
        common = common[known[common]]
        top = np.stack([h[common], total[common].astype(np.uint64), k[common].astype(np.uint64)]) if len(common) else np.zeros((3, 0), np.uint64)
        replies = [tk.narrow(total[np.searchsorted(h, w)]).tobytes() for w in words]
        blocks = table.column("block").to_pylist()
        r = int(key[0].as_py())
        return pa.table(
            {
                "block": pa.array([-1, *blocks], pa.int32()),
                "range": pa.array([r] * (len(blocks) + 1), pa.int32()),
                "totals": pa.array([None, *replies], pa.binary()),
                "sums": pa.array([sums.tobytes()] + [None] * len(blocks), pa.binary()),
                "top": pa.array([top.tobytes()] + [None] * len(blocks), pa.binary()),
            }
        )

    return run


class Vocabulary:
    """Shortlist (sorted hashes and counts), class sums without the shortlist, N and V."""

    def __init__(self, sums: np.ndarray, top: np.ndarray, shortlist: int = SHORTLIST):
        self.classes = (len(sums) - 2) // 2
        self.n_class, self.v_class = sums[: self.classes].copy(), sums[self.classes : -2].copy()
        self.total, self.types = int(sums[-2]), int(sums[-1])
        ends = top[:, top[0] == END]
        rest = top[:, top[0] != END]
        rest = rest[:, np.lexsort((rest[0], -rest[1].astype(np.int64)))[:shortlist]]
        chosen = rest[:, np.argsort(rest[0])]
        self.words, self.counts = chosen[0], chosen[1].astype(np.int64)
        np.subtract.at(self.n_class, chosen[2].astype(np.int64), self.counts)
        np.subtract.at(self.v_class, chosen[2].astype(np.int64), 1)
        self.end = len(self.words)
        self.size = self.end + 1 + self.classes
        end_count = int(ends[1].sum()) if ends.size else 0
        self.outcome_counts = np.concatenate([self.counts, [end_count], self.n_class])

    def outcomes(self, h: np.ndarray, k: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return self.end + 1 + k.astype(np.int32)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, self.end + 1 + k.astype(np.int64)).astype(np.int32)


def _triples(out: np.ndarray, per_row: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Outcomes with an end mark after each row, and the two before each; the last array gives the row."""
    n_rows = len(per_row)
    row = np.repeat(np.arange(n_rows), per_row + 1)
    stop = np.cumsum(per_row + 1) - 1
    seq = np.full(len(row), end, np.int32)
    body = np.ones(len(row), bool)
    body[stop] = False
    seq[body] = out
    one = np.concatenate([[end], seq[:-1]]).astype(np.int32) if len(seq) else seq
    two = np.concatenate([[end, end], seq[:-2]]).astype(np.int32)[: len(seq)]
    first = stop - per_row
    one[first] = end
    two[first] = end
    second = first[per_row >= 1] + 1
    two[second] = end
    return seq, one, two, row


class LogBilinear:
    """p(outcome | two outcomes before), as p(group | context) p(outcome | group, context). The last column of ``output`` and ``groups`` is a bias."""

    #: Tables that training changes, each with its sums of squared gradients.
    TABLES = ("context", "output", "groups", "position")

    def __init__(self, size: int, prior: np.ndarray, dimension: int = DIMENSION, seed: int = SEED):
        rng = np.random.default_rng(seed)
        p = (prior + 1.0) / (prior + 1.0).sum()
        order = np.argsort(-p, kind="stable")
        self.rank = np.empty(size, np.int64)
        self.rank[order] = np.arange(size)
        self.p, width = p[order], math.ceil(math.sqrt(size))
        self.first = np.arange(0, size, width)
        self.last = np.minimum(self.first + width, size) - 1
        self.group = np.arange(size) // width
        self.p_group = np.add.reduceat(self.p, self.first)
        self.p_within = self.p / self.p_group[self.group]
        self.context = rng.normal(0, 0.1, (size, dimension)).astype(np.float32)
        self.output = rng.normal(0, 0.1, (size, dimension + 1)).astype(np.float32)
        self.groups = rng.normal(0, 0.1, (len(self.first), dimension + 1)).astype(np.float32)
        self.output[:, -1] = np.log(self.p_within)
        self.groups[:, -1] = np.log(self.p_group)
        self.position = np.ones((2, dimension), np.float32) * np.array([[0.8], [0.4]], np.float32)
        self.squares = {k: np.full((len(t), t.shape[1] if k == "position" else 1), 0.1, np.float32) for k, t in self.tables().items()}

    def tables(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in self.TABLES}

    def predict(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        q = np.ones((len(one), self.output.shape[1]), np.float32)
        q[:, :-1] = self.context[one] * self.position[0] + self.context[two] * self.position[1]
        return q

    def train(self, one: np.ndarray, two: np.ndarray, nxt: np.ndarray, passes: float = 1, done: float = 0.0, share: float = 1.0, seed: int = SEED) -> int:
        """Noise-contrastive estimation with Adagrad steps on ``passes`` times as many examples: all of them in every whole pass, the rest drawn without repetition; the rate falls from
        ``done`` on by ``share`` of the whole training. Returns the number of examples seen."""
        rng, n = np.random.default_rng(seed), len(nxt)
        total = math.ceil(n * passes)
        noise = _Noise(self)
        for start in range(0, total, max(n, 1)):
            drawn = slice(None) if total - start >= n else rng.permutation(n)[: total - start]
            a, b, x, weight = _together(one[drawn], two[drawn], nxt[drawn], len(self.p))
            order, seen = rng.permutation(len(x)), start
            for lo in range(0, len(order), BATCH):
                i = order[lo : lo + BATCH]
                self._step(rng, a[i], b[i], self.rank[x[i]], weight[i], 0.25 * (1 - 0.9 * (done + share * seen / total)), noise)
                seen += int(weight[i].sum())
        return total

    def _step(self, rng, a, b, t, weight, rate, noise: _Noise) -> None:
        q, g = self.predict(a, b), self.group[t]
        # groups: one set of noise serves the whole batch
        d = noise.groups(rng)
        true, other = self.groups[g], self.groups[d]
        e_true = _sigmoid(noise.log_group[g] - np.einsum("ij,ij->i", q, true)) * weight
        e_other = _sigmoid(q @ other.T - noise.log_group[d]) * (weight * (-NOISE / len(d)))[:, None]
        g_q = e_true[:, None] * true + e_other @ other
        rows_group, g_group = np.concatenate([g, d]), np.concatenate([e_true[:, None] * q, e_other.T @ q])
        # outcomes of a group: one set of noise serves all examples of the group
        true = self.output[t]
        e_true = _sigmoid(noise.log_within[t] - np.einsum("ij,ij->i", q, true)) * weight
        g_q += e_true[:, None] * true
        rows_out, g_out = [t], [e_true[:, None] * q]
        order = np.argsort(g.astype(np.uint16) if len(self.first) <= 1 << 16 else g, kind="stable")
        cut = np.searchsorted(g[order], np.arange(len(self.first) + 1))
        present = np.flatnonzero(cut[1:] > cut[:-1])
        for k, w in zip(present, noise.within(rng, present), strict=True):
            mine = order[cut[k] : cut[k + 1]]
            other, q_mine = self.output[w], q[mine]
            e_other = _sigmoid(q_mine @ other.T - noise.log_within[w]) * (weight[mine] * (-NOISE_WITHIN / len(w)))[:, None]
            g_q[mine] += e_other @ other
            rows_out.append(w)
            g_out.append(e_other.T @ q_mine)
        g_q = g_q[:, :-1]
        g_in = np.concatenate([g_q * self.position[0], g_q * self.position[1]])
        g_pos = np.stack([(g_q * self.context[a]).sum(0), (g_q * self.context[b]).sum(0)]) / weight.sum()
        _adagrad(self.context, self.squares["context"], np.concatenate([a, b]), g_in, rate)
        _adagrad(self.output, self.squares["output"], np.concatenate(rows_out), np.concatenate(g_out), rate)
        _adagrad(self.groups, self.squares["groups"], rows_group, g_group, rate)
        self.squares["position"] += g_pos**2
        self.position += rate * 0.1 * g_pos / np.sqrt(self.squares["position"])

    def log_probabilities(self, one: np.ndarray, two: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Normalised natural-log probabilities, by matrix products over batches: with all groups, then with the outcomes of each example's group. Equal examples are computed once."""
        size = len(self.p)
        keys, inverse = np.unique((nxt.astype(np.int64) * size + one) * size + two, return_inverse=True)
        return self._log_probabilities(keys // size % size, keys % size, keys // (size * size))[inverse]

    def _log_probabilities(self, one: np.ndarray, two: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        out = np.empty(len(nxt), np.float64)
        for lo in range(0, len(nxt), 1 << 15):
            q, t = self.predict(one[lo : lo + (1 << 15)], two[lo : lo + (1 << 15)]), self.rank[nxt[lo : lo + (1 << 15)]]
            g = self.group[t]
            p = _log_softmax(q @ self.groups.T, g)
            order = np.argsort(g, kind="stable")
            cut = np.searchsorted(g[order], np.arange(len(self.first) + 1))
            for k in np.flatnonzero(cut[1:] > cut[:-1]):
                mine = order[cut[k] : cut[k + 1]]
                p[mine] += _log_softmax(q[mine] @ self.output[self.first[k] : self.last[k] + 1].T, t[mine] - self.first[k])
            out[lo : lo + (1 << 15)] = p
        return out


class _Noise:
    """Draws of groups, and of outcomes of a group, by their shares of the training text."""

    def __init__(self, net: LogBilinear):
        self.net, self.cum, self.cum_group = net, np.cumsum(net.p), np.cumsum(net.p_group)
        self.starts = self.cum[net.first] - net.p[net.first]
        self.log_group, self.log_within = np.log(net.p_group * NOISE).astype(np.float32), np.log(net.p_within * NOISE_WITHIN).astype(np.float32)

    def groups(self, rng) -> np.ndarray:
        return np.minimum(np.searchsorted(self.cum_group, rng.random(4 * NOISE)), len(self.cum_group) - 1)

    def within(self, rng, k: np.ndarray) -> np.ndarray:
        """A row of outcomes of each of the groups ``k``."""
        net, at = self.net, k[:, None]
        return np.clip(np.searchsorted(self.cum, self.starts[at] + rng.random((len(k), 2 * NOISE_WITHIN)) * net.p_group[at]), net.first[at], net.last[at])


def _together(one: np.ndarray, two: np.ndarray, nxt: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different examples (the two outcomes before and the next) and how often each occurs; those that occur more than ``TOGETHER`` times fill several rows."""
    keys, n = np.unique((nxt.astype(np.int64) * size + one) * size + two, return_counts=True)
    rows = -(-n // TOGETHER)
    keys, weight = np.repeat(keys, rows), np.repeat(n // rows, rows)
    first = np.cumsum(rows) - rows
    weight += np.arange(len(keys)) - np.repeat(first, rows) < np.repeat(n % rows, rows)
    return keys // size % size, keys % size, keys // (size * size), weight.astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.minimum(np.maximum(x, np.float32(-30)), np.float32(30), dtype=np.float32)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log softmax of each row at one column."""
    z -= z.max(1, keepdims=True)
    picked = z[np.arange(len(z)), at]
    return picked.astype(np.float64) - np.log(np.exp(z, out=z).sum(1, dtype=np.float64))


def _adagrad(table: np.ndarray, sq: np.ndarray, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
    if len(table) <= 1 << 16:
        rows = rows.astype(np.uint16)  # sorted by radix
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    keys, total = rows[first], np.add.reduceat(g[order], first, axis=0)
    sq[keys] += (total * total).mean(1, keepdims=True)
    table[keys] += rate * total / np.sqrt(sq[keys])


class LanguageModel:
    """The vocabulary and the neural model; scores blocks given total counts of their words."""

    def __init__(self, vocabulary: Vocabulary, network: LogBilinear):
        self.v, self.net = vocabulary, network

    def score(self, text: pa.Array, counts_of) -> dict[str, np.ndarray]:
        """Per row: n_tokens, n_known, base_score, score. ``counts_of`` maps word hashes to training counts."""
        v, n = self.v, len(text)
        result = {"n_tokens": np.zeros(n, np.int64), "n_known": np.zeros(n, np.int64), "base_score": np.zeros(n), "score": np.zeros(n)}
        end_count = counts_of(np.array([END]))[0]
        floor = math.log(v.total + v.types + 1)
        class_floor = np.log(v.n_class + v.v_class + 1.0)
        for lo, hi, w, h, k in _stream(text, v.classes):
            c = counts_of(h).astype(np.float64)
            out = v.outcomes(h, k)
            seq, one, two, row = _triples(out, w.per_row, v.end)
            p = np.bincount(row, weights=self.net.log_probabilities(one, two, seq), minlength=hi - lo)
            rare = out > v.end
            share = np.where(rare, np.log(c + 1) - class_floor[np.where(rare, out - v.end - 1, 0)], 0.0)
            p += np.bincount(w.row, weights=share, minlength=hi - lo)
            base = np.bincount(w.row, weights=np.log(c + 1) - floor, minlength=hi - lo) + math.log(end_count + 1) - floor
            result["n_tokens"][lo:hi] = w.per_row + 1
            result["n_known"][lo:hi] = np.bincount(w.row, weights=c > 0, minlength=hi - lo).astype(np.int64) + int(end_count > 0)
            result["base_score"][lo:hi] = base / math.log(10)
            result["score"][lo:hi] = p / math.log(10)
        return result


CHANGES = "part int, shard int, seen long, changes binary"


def _train_shard(sent, round_: int, passes: float, parts: int):
    """The changes of the model by one shard's part of the training text, in an order that does not depend on how rows were dealt."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        v, start = sent.value
        net, shard = copy.deepcopy(start), int(key[0].as_py())
        triples: list[tuple[np.ndarray, ...]] = []
        for _, _, w, h, k in _stream(table.sort_by("h").column("text").combine_chunks(), v.classes):
            triples.append(_triples(v.outcomes(h, k), w.per_row, v.end)[:3])
        nxt, one, two = (np.concatenate(x) for x in zip(*triples, strict=True))
        seen = net.train(one, two, nxt, passes, round_ / ROUNDS, 1 / ROUNDS, SEED + shard * ROUNDS + round_)
        changes = np.concatenate([x.ravel() for k in net.TABLES for x in _change(net, start, k)])
        return pa.table({"part": pa.array([shard % parts], pa.int32()), "shard": pa.array([shard], pa.int32()), "seen": pa.array([seen]), "changes": pa.array([changes.astype(np.float32).tobytes()], pa.binary())})

    return run


def _change(net: LogBilinear, start: LogBilinear, k: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Changes of a table and of its squares, and the rows that changed."""
    squares = net.squares[k] - start.squares[k]
    return getattr(net, k) - getattr(start, k), squares, squares.any(1).astype(np.float32)


def _sum_changes(key: tuple, table: pa.Table) -> pa.Table:
    table, total = table.sort_by("shard"), np.zeros(0)
    for x in table.column("changes"):
        x = np.frombuffer(x.as_py(), np.float32)
        total = total + x if len(total) else x.astype(np.float64)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([-1], pa.int32()), "seen": pa.array([sum(table.column("seen").to_pylist())], pa.int64()), "changes": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def train_network(texts: DataFrame, v: Vocabulary, text_bytes: int, examples: int = EXAMPLES) -> tuple[LogBilinear, int]:
    """The model trained on ``texts`` (``doc_id, text``), and the number of examples seen."""
    spark, net, all_seen = texts.sparkSession, LogBilinear(v.size, v.outcome_counts), 0
    shards = max(1, math.ceil(text_bytes / (SHARD_BYTES * ROUNDS)))
    parts, passes = math.isqrt(shards - 1) + 1, max(1.0, examples / max(1, v.total))
    h = F.xxhash64("doc_id", "text")
    texts = texts.select("text", h.alias("h")).withColumn("round", F.pmod("h", F.lit(ROUNDS))).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    for r in range(ROUNDS):
        sent = spark.sparkContext.broadcast((v, net))
        mine = texts.where(F.col("round") == r).select("shard", "h", "text")
        summed = mine.groupBy("shard").applyInArrow(_train_shard(sent, r, passes, parts), CHANGES).groupBy("part").applyInArrow(_sum_changes, CHANGES)
        total = np.zeros(0)
        for row in sorted(summed.collect(), key=lambda x: x.part):
            x = np.frombuffer(row.changes, np.float32)
            total, all_seen = (total + x if len(total) else x.astype(np.float64)), all_seen + row.seen
        sent.destroy()
        at = 0
        for k in net.TABLES if len(total) else ():
            table, squares = getattr(net, k), net.squares[k]
            cut = np.cumsum([at, table.size, squares.size, len(table)])
            change, square, n = (total[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True))
            n, at = np.maximum(n, 1)[:, None], cut[-1]
            table += (change.reshape(table.shape) / n).astype(np.float32)
            squares += (square.reshape(squares.shape) / n).astype(np.float32)
    return net, all_seen


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", examples: int = EXAMPLES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = input_bytes(base, "text")
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    ranges = max(1, math.ceil(size / RANGE_BYTES / 4))
    shortlist, classes = outcome_sizes(size)
    base = base.withColumn("out", held_out(F.col("doc_id"))).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    answers = materialize(base.groupBy("block").applyInArrow(_ask(ranges, classes), ASKED).groupBy("range").applyInArrow(_answer(ranges, shortlist, classes), ANSWERED))
    sums, tops = np.zeros(2 * classes + 2, np.int64), [np.zeros((3, 0), np.uint64)]
    for r in answers.where("block = -1").select("sums", "top").toLocalIterator():
        sums += np.frombuffer(r.sums, np.int64)
        top = np.concatenate([*tops, np.frombuffer(r.top, np.uint64).reshape(3, -1)], axis=1)
        tops = [top[:, np.argsort(-top[1].astype(np.int64), kind="stable")[: 2 * shortlist + 2]]]
    v = Vocabulary(sums, tops[0], shortlist)
    net, _ = train_network(base.where("not out").select("doc_id", "text"), v, size, examples)
    sent = spark.sparkContext.broadcast(LanguageModel(v, net))

    def score_block(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        model = sent.value
        column = left.column("text").combine_chunks() if left.num_rows else pa.array([], pa.string())
        out = left.column("out").to_numpy().astype(bool) if left.num_rows else np.zeros(0, bool)
        h, _, _ = _block_words(column, ~out, model.v.classes)
        part = (h % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        reply = {r.as_py(): tk.widen(t.as_py()) for r, t in zip(right.column("range"), right.column("totals"), strict=True)}
        total = np.zeros(len(h), np.int64)
        if reply:
            total[order] = np.concatenate([reply[r] for r in sorted(reply)])
        got = model.score(column, lambda x: total[np.searchsorted(h, x)])
        return pa.table({"doc_id": left.column("doc_id").cast(id_type), "held_out": pa.array(out), **{k: pa.array(got[k]) for k in ("n_tokens", "n_known")}, "train_tokens": pa.array(np.full(len(out), model.v.total)), "base_score": pa.array(got["base_score"]), "score": pa.array(got["score"])})

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(base.schema["doc_id"].dataType)
    schema = f"doc_id {dict(base.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return base.groupBy("block").cogroup(answers.where("block >= 0").select("block", "range", "totals").groupBy("block")).applyInArrow(score_block, schema)
