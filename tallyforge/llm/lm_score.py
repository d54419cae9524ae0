"""Scores of whole texts under a causal self-attention model, beside a smoothed word-unigram base.

Texts are words (A-Z lower-cased) and one end. The model works on the words' subword ids, laid end to end from a start
to an end: every id that the training texts hold has an embedding and an output of its own (frequent ones at the top of
the softmax, the rest in groups with a second softmax each), ids that they never hold share what is left. It is one
layer of causal self-attention, trained in numpy. A text's score is the log probability of all its ids and its end,
each predicted once by attention; nothing else is mixed in.

Every block of words of the training texts trains all parameters once, in one of two rounds: FIRST_EVERY-th blocks in
the first, then the others, most of the corpus, in the second. In a round every task starts from the same parameters and
learns from its part of the corpus; the results are averaged by the windows they saw.

Scoring cuts a document into windows of CONTEXT + STRIDE inputs, each STRIDE after the last: its STRIDE newest
positions are scored, once, with at least CONTEXT inputs before them, in batches of masked attention.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import doc_split, save, table, words_of
from tallyforge.llm.sp_codec import MARK, default_model

#: Ids with outputs of their own at the top; the other known ids are in groups of about the square root of their number.
SINGLES = 64
WIDTH = 16
CONTEXT = 12
STRIDE = 36
#: Training texts are learned from in blocks of this many words.
BLOCK_WORDS = 256
#: One block in so many is learned from in the first round, the others in the second.
FIRST_EVERY = 4
#: Learning rates of the two rounds.
RATES = (0.03, 0.01)
BATCH_WINDOWS = 64
#: Words of the blocks that are cut into windows together.
BATCH_WORDS = 8_192
#: Rows of a group that are multiplied at once.
ROWS = 16
#: Words whose ids a training task remembers at most.
KNOWN_WORDS = 200_000
#: Words of buckets that a task holds at most before it sends those of the first.
HELD_WORDS = 1_000_000
#: Text of a bucket at most, in bytes (a longer text is a bucket's only one): documents of one bucket share a dictionary of their words' counts.
BUCKET_BYTES = 192 << 20
#: Numbers of a part of the parameters, as tasks send them.
PART = 4096

#: Targets that are no ids: the end of a text, and nothing.
END, NONE = -1, -2


class Subwords:
    """Subword ids of words; pieces of a word begin with the space marker, so texts are concatenations of words."""

    _made: dict[bytes, object] = {}

    def __init__(self, model: bytes):
        import sentencepiece

        if model not in self._made:
            self._made[model] = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.plain = self._made[model]

    def first(self) -> np.ndarray:
        """For each id, whether it begins words."""
        return np.array([self.plain.id_to_piece(i).startswith(MARK) for i in range(self.plain.get_piece_size())])

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        try:
            b"".join(words).decode()
        except UnicodeDecodeError:
            words = [w.decode("utf-8", "replace") for w in words]
        return self.plain.encode(words, num_threads=1)


class Places(dict):
    """The places of words; one that is asked for and not held gets the next, and is new."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class WordNumbers:
    """The numbers of words' ids, kept from one look-up to the next up to some words."""

    def __init__(self, encode: Subwords, number: np.ndarray):
        self.encode, self.number = encode, number
        self.clear()

    def clear(self) -> None:
        self.index = Places()
        self.begin, self.size, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int64), 0

    def at(self, words: list[bytes]) -> np.ndarray:
        """Places of words; new ones are learned."""
        at = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        new, self.index.new = self.index.new, []
        n = len(self.index) - len(new)
        for a in range(0, len(new), 10_000):
            some = self.encode(new[a : a + 10_000])
            sizes = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
            ids = self.number[np.fromiter(chain.from_iterable(some), dtype=np.int64, count=int(sizes.sum()))]
            self.begin, self.size = (np.resize(x, 2 * (n + len(some))) if len(x) < n + len(some) else x for x in (self.begin, self.size))
            self.begin[n : n + len(some)], self.size[n : n + len(some)] = self.used + np.cumsum(sizes) - sizes, sizes
            if len(self.flat) < self.used + len(ids):
                self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            n += len(some)
        return at

    def numbers(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words at some places, laid end to end, and how many each has."""
        n = self.size[at]
        return self.flat[np.repeat(self.begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


class Attention:
    """Parameters and passes of the model; params is a dict of float32 arrays.

    Ids of the vocabulary are numbered anew, known ones by falling count; then come one for all unseen ids that begin
    words, one for all others, the start and the missing input.
    """

    #: Parameters of the outputs.
    HEAD = ("out", "bias", "inner", "inner_bias")

    def __init__(self, counts: dict[int, int], n_ends: int, first: np.ndarray, seed: int = 5):
        """counts: subword ids' counts in the training texts; first: for each id of the vocabulary, whether it begins words."""
        n = np.zeros(len(first))
        n[list(counts)] = list(counts.values())
        known = np.flatnonzero(n)
        known = known[np.lexsort((known, -n[known]))]
        v = len(known)
        self.number = np.where(first, v, v + 1)
        self.number[known] = np.arange(v)
        self.start, self.missing = v + 2, v + 3
        singles, others = min(SINGLES, v), np.arange(max(0, v - SINGLES))
        self.size = max(16, int(np.ceil(len(others) ** 0.5)))
        self.groups = -(-len(others) // self.size)
        # what follows is by target; END, which is -1, is the last entry
        self.group, self.slot = np.full(v + 3, -1), np.zeros(v + 3, dtype=np.int64)
        self.group[singles:v], self.slot[singles:v] = others // self.size, others % self.size
        tops = singles + self.groups + 3
        self.top = np.append(np.arange(v), tops - 3 + np.arange(3))
        self.top[singles:v] = singles + self.group[singles:v]
        unseen = [int(((n == 0) & (first == kind)).sum()) for kind in (True, False)]
        self.within = np.append(np.zeros(v), [*-np.log(np.maximum(1, unseen)), 0.0]).astype(np.float32)
        w = WIDTH
        self.shapes = {
            "embed": (v + 3, w), "query": (w, w), "key": (w, w), "value": (w, w), "near": (CONTEXT + STRIDE,), "last": (w, w), "mixed": (w, w), "shift": (w,),
            "out": (w, tops), "bias": (tops,), "inner": (self.groups, w, self.size), "inner_bias": (self.groups, self.size),
        }
        rng = np.random.default_rng(seed)
        self.params = {k: (rng.normal(size=s) * (0.3 if k == "embed" else w**-0.5) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in self.shapes.items()}
        for k in ("out", "inner"):
            self.params[k] *= 0.1
        # the prior: counts, with one for unseen ids of a kind and for the end
        count = np.append(n[known], [min(1, u) for u in unseen] + [n_ends + 1])
        sums = np.maximum(np.bincount(self.top, weights=count, minlength=tops), 1e-9)
        self.params["bias"] = np.log(sums / sums.sum()).astype(np.float32)
        inner = np.full((self.groups, self.size), 1e-9)
        inner[self.group[singles:v], self.slot[singles:v]] = count[singles:v]
        self.params["inner_bias"] = np.log(inner / inner.sum(axis=1, keepdims=True)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            self.params[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n

    def windows(self, ids: np.ndarray, lengths: np.ndarray, context: int, batch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Batches of inputs, targets and owners of windows of documents whose ids (numbers) are laid end to end.

        A document of n ids has n + 1 positions: position p sees the start and its first p ids, and predicts id p or the
        end. Windows hold context inputs before their targets; CONTEXT + STRIDE inputs in all.
        """
        stride = CONTEXT + STRIDE - context
        n_windows = -(-(lengths + 1) // stride)
        owner = np.repeat(np.arange(len(lengths)), n_windows)
        first = (np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)) * stride
        begin = np.repeat(np.cumsum(lengths) - lengths, n_windows)
        padded = np.append(ids, 0)
        for a in range(0, len(owner), batch):
            s = slice(a, a + batch)
            at = first[s, None] + np.arange(-context, stride)
            n = lengths[owner[s], None] + 1
            inputs = np.where((at >= 0) & (at < n), padded.take(begin[s, None] + at - 1, mode="clip"), self.missing)
            inputs[at == 0] = self.start
            mine = at[:, context:]
            target = padded.take(begin[s, None] + mine, mode="clip")
            target[mine == n - 1] = END
            target[mine >= n] = NONE
            yield inputs, target, owner[s]

    def tables(self, rows: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Queries, keys with values, states' first parts and embeddings of all inputs or of some rows.

        One more column of queries and keys carries the mask of missing inputs, one more of the values the sums, one more
        of the first parts makes the column of ones of the states. Values of all inputs are mixed already.
        """
        p = self.params
        h = np.concatenate([p["embed"], np.zeros((1, WIDTH), np.float32)])
        missing = np.arange(len(h)) == self.missing
        if rows is not None:
            h, missing = h[rows], missing[rows]
        one = np.ones((len(h), 1), np.float32)
        q = np.column_stack([np.clip(h @ p["query"], -4, 4) * np.float32(WIDTH**-0.5), one])
        value = p["value"] @ p["mixed"] if rows is None else p["value"]
        kv = np.column_stack([np.clip(h @ p["key"], -4, 4), -60 * missing.astype(np.float32), h @ value, one])
        # the hyperbolic tangent of a large number is 1
        return q, kv, np.column_stack([h @ p["last"] + p["shift"], 30 * one]), h

    def decay(self, context: int) -> np.ndarray:
        """What distance adds to the scores of attention; later inputs are masked."""
        back = np.arange(context, CONTEXT + STRIDE)[:, None] - np.arange(CONTEXT + STRIDE)
        return np.where(back >= 0, self.params["near"][np.maximum(back, 0)], np.float32(-60))

    def attend(self, inputs: np.ndarray, tables: tuple[np.ndarray, ...], decay: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sums of values (with those of attention as the last column), attention before division, queries, keys and values of windows."""
        q, kv = tables[0].take(inputs[:, -decay.shape[0] :], axis=0), tables[1].take(inputs, axis=0)
        k, v = kv[..., : WIDTH + 1], kv[..., WIDTH + 1 :]
        s = q @ k.transpose(0, 2, 1)
        s += decay
        np.exp(s, out=s)
        return s @ v, s, q, k, v

    def head(self) -> tuple[np.ndarray, np.ndarray]:
        """Outputs with their biases: those at the top and those in groups."""
        p = self.params
        return np.vstack([p["out"], p["bias"]]), np.concatenate([p["inner"], p["inner_bias"][:, None]], axis=1)

    def in_groups(self, z: np.ndarray, group: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows of z with a group, in chunks of ROWS of one group each, filled up with the first row of z.

        Gives these rows' numbers, their places in the chunks, the chunks' rows, groups, weights and logits.
        """
        some = np.flatnonzero(group >= 0)
        some = some[np.argsort(group[some].astype(np.int16), kind="stable")]
        n = np.bincount(group[some], minlength=self.groups)
        chunks = -(-n // ROWS)
        of = np.repeat(np.arange(self.groups), chunks)
        place = np.arange(len(some)) + np.repeat((np.cumsum(chunks) - chunks) * ROWS - (np.cumsum(n) - n), n)
        source = np.zeros(len(of) * ROWS, dtype=np.int64)
        source[place] = some
        rows, w = z.take(source, axis=0), inner.take(of, axis=0)
        return some, place, rows, of, w, (rows.reshape(len(of), ROWS, WIDTH + 1) @ w).reshape(-1, self.size)

    def positions(self, ids: np.ndarray, lengths: np.ndarray, tables: tuple[np.ndarray, ...], batch: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(owner, natural log probability) of each position of documents whose ids (numbers) are laid end to end, in runs."""
        out, inner = self.head()
        decay, one = self.decay(CONTEXT), np.ones(max(out.shape[1], self.size), np.float32)
        for x, target, owner in self.windows(ids, lengths, CONTEXT, batch):
            z = self.attend(x, tables, decay)[0].reshape(-1, WIDTH + 1)
            z /= z[:, WIDTH:].copy()
            z += tables[2].take(x[:, CONTEXT:].ravel(), axis=0)
            np.tanh(z, out=z)
            goal = target.ravel()
            logits = z @ out
            lp = logits.ravel().take(np.arange(0, logits.size, logits.shape[1]) + self.top.take(goal, mode="wrap")) + self.within.take(goal, mode="wrap")
            np.exp(logits, out=logits)
            lp -= np.log(logits @ one[: logits.shape[1]])
            some, place, _, _, _, e = self.in_groups(z, self.group.take(goal, mode="wrap"), inner)
            if len(some):
                mine = e.ravel().take(place * self.size + self.slot[goal[some]])
                np.exp(e, out=e)
                lp[some] += mine - np.log(e @ one[: self.size])[place]
            live = np.flatnonzero(goal != NONE)
            yield np.repeat(owner, STRIDE)[live], lp[live]

    def score(self, ids: np.ndarray, lengths: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
        """log10 probability of each document: of all its ids and its end."""
        total = np.zeros(len(lengths))
        for owner, lp in self.positions(ids, lengths, tables):
            total += np.bincount(owner, weights=lp, minlength=len(lengths))
        return total / np.log(10)

    def gradients(self, inputs: np.ndarray, target: np.ndarray, tables: tuple[np.ndarray, ...] | None = None) -> dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]]:
        """Of the mean of minus the log probabilities of all targets; (rows, gradients) for tables of parameters. With tables(), only of HEAD."""
        p, (n, stride) = self.params, target.shape
        x, t = inputs, tables
        if t is None:
            held = np.zeros(self.missing + 1, dtype=bool)
            held[inputs.ravel()] = True
            rows = np.flatnonzero(held)
            place = np.zeros(self.missing + 1, dtype=np.int64)
            place[rows] = np.arange(len(rows))
            x = place[inputs]
            t = self.tables(rows)
        now = x[:, -stride:].ravel()
        context, a, q, k, v = self.attend(x, t, self.decay(inputs.shape[1] - stride))
        context = context.reshape(-1, WIDTH + 1)
        sums = context[:, WIDTH:].copy()
        context /= sums
        if tables is None:
            z = np.ones_like(context)
            z[:, :WIDTH] = context[:, :WIDTH] @ p["mixed"]
        else:
            z = context
        z += t[2].take(now, axis=0)
        np.tanh(z, out=z)
        goal = target.ravel()
        live = goal != NONE
        scale = np.float32(1 / max(1, np.count_nonzero(live)))
        out, inner = self.head()
        # differences from targets are scaled where they meet the states: these are far narrower
        d = z @ out
        np.exp(d, out=d)
        total = d @ np.ones(d.shape[1], np.float32)
        d.reshape(-1)[np.arange(0, d.size, d.shape[1]) + self.top.take(goal, mode="wrap")] -= total
        each = (live * scale / total)[:, None]
        w = self.product(z * each, d, n)
        g = {"out": w[:-1], "bias": w[-1]}
        if tables is None:
            dz = d @ p["out"].T
            dz *= each
        some, at, chunks, of, w, e = self.in_groups(z, self.group.take(goal, mode="wrap"), inner)
        if len(some):
            np.exp(e, out=e)
            total = e @ np.ones(self.size, np.float32)
            e.reshape(-1)[at * self.size + self.slot[goal[some]]] -= total[at]
            weight = np.zeros((len(e), 1), e.dtype)
            weight[at, 0] = scale / total[at]
            chunks *= weight
            begins = np.flatnonzero(np.diff(of, prepend=-1))
            ends = [*(begins[1:] * ROWS).tolist(), len(e)]
            by_group = np.empty((len(begins), WIDTH + 1, self.size), e.dtype)
            for i, (begin, end) in enumerate(zip((begins * ROWS).tolist(), ends, strict=True)):
                np.matmul(chunks[begin:end].T, e[begin:end], out=by_group[i])
            g["inner"], g["inner_bias"] = (of[begins], by_group[:, :-1]), (of[begins], by_group[:, -1])
            if tables is None:
                back = (e.reshape(-1, ROWS, self.size) @ w[:, :-1].transpose(0, 2, 1)).reshape(-1, WIDTH)
                back *= weight
                dz[some] += back[at]
        if tables is not None:
            return g
        z = z[:, :WIDTH]
        dz *= 1 - z * z
        # of attention: what an input's value adds to the context, less the context itself; the values' last column is 1
        dc = np.empty_like(context)
        np.divide(dz @ p["mixed"].T, sums, out=dc[:, :WIDTH])
        dc[:, WIDTH] = -np.einsum("ij,ij->i", dc[:, :WIDTH], context[:, :WIDTH])
        dc = dc.reshape(n, stride, WIDTH + 1)
        ds = dc @ v.transpose(0, 2, 1)
        ds *= a
        near = ds.sum(axis=0)
        back = np.arange(inputs.shape[1] - stride, inputs.shape[1])[:, None] - np.arange(inputs.shape[1])
        g["near"] = np.bincount(back[back >= 0], weights=near[back >= 0], minlength=CONTEXT + STRIDE)
        dq = (ds @ k[..., :WIDTH]).reshape(-1, WIDTH)
        dkv = np.concatenate([ds.transpose(0, 2, 1) @ q[..., :WIDTH], a.transpose(0, 2, 1) @ dc[..., :WIDTH]], axis=2).reshape(-1, 2 * WIDTH)
        # clipped entries pass no gradient; q holds its scale already
        where, h = x.ravel(), t[3]
        dq *= np.float32(WIDTH**-0.5)
        for clipped, mine, of in ((np.abs(h @ p["query"]) >= 4, dq, now), (np.abs(h @ p["key"]) >= 4, dkv[:, :WIDTH], where)):
            if clipped.any():
                mine *= ~clipped[of]
        dzq = np.concatenate([dz, dq], axis=1)
        of_now = self.product(np.concatenate([context, h.take(now, axis=0)], axis=1), dzq, n)
        of_all = self.product(h.take(where, axis=0), dkv, n)
        g |= {"mixed": of_now[:WIDTH, :WIDTH], "shift": of_now[WIDTH, :WIDTH], "last": of_now[WIDTH + 1 :, :WIDTH], "query": of_now[WIDTH + 1 :, WIDTH:]}
        g |= {"key": of_all[:, :WIDTH], "value": of_all[:, WIDTH:]}
        dh = (dkv @ np.concatenate([p["key"], p["value"]], axis=1).T).reshape(*x.shape, WIDTH)
        dh[:, -stride:] += (dzq @ np.concatenate([p["last"], p["query"]], axis=1).T).reshape(n, stride, WIDTH)
        cells = (where * WIDTH)[:, None] + np.arange(WIDTH)
        embed = np.bincount(cells.ravel(), weights=dh.ravel(), minlength=len(rows) * WIDTH).reshape(-1, WIDTH).astype(np.float32)
        g["embed"] = (rows[rows < self.missing], embed[rows < self.missing])
        return g

    @staticmethod
    def product(x: np.ndarray, y: np.ndarray, windows: int) -> np.ndarray:
        """x.T @ y of long narrow matrices: a product for each window, then their sum, which is faster than one."""
        return (x.reshape(windows, -1, x.shape[1]).transpose(0, 2, 1) @ y.reshape(windows, -1, y.shape[1])).sum(axis=0)


class Adam:
    """Steps of a model; rows of a table that a batch does not hold stay as they are."""

    def __init__(self, model: Attention, rate: float, whole: bool = True):
        self.model, self.rate, self.n = model, rate, 0
        self.tables = None if whole else model.tables()
        names = model.shapes if whole else model.HEAD
        self.mean = {k: np.zeros(model.shapes[k], np.float32) for k in names}
        self.spread = {k: np.zeros(model.shapes[k], np.float32) for k in names}

    def step(self, inputs: np.ndarray, target: np.ndarray) -> None:
        self.n += 1
        up, down = np.float32(self.rate / (1 - 0.9**self.n)), np.float32(1 / (1 - 0.99**self.n))
        for k, g in self.model.gradients(inputs, target, self.tables).items():
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            if not isinstance(rows, slice) and len(rows) == len(self.mean[k]):
                rows = slice(None)  # all of them, in order
            mean, spread = self.mean[k][rows], self.spread[k][rows]
            mean *= np.float32(0.9)
            mean += np.float32(0.1) * g
            g = g * g
            g *= np.float32(0.01)
            spread *= np.float32(0.99)
            spread += g
            by = spread * down
            np.sqrt(by, out=by)
            by += np.float32(1e-8)
            np.divide(mean, by, out=by)
            by *= up
            if not isinstance(rows, slice):
                self.mean[k][rows], self.spread[k][rows] = mean, spread
            self.model.params[k][rows] -= by


def blocks(words: list[bytes], first: bool) -> Iterator[tuple[list[bytes], bool]]:
    """The blocks of a text that a round learns from, and whether the text ends with them; each block belongs to one of the two rounds.

    A text without words is one empty block. Copies of a text deal their blocks alike.
    """
    start = zlib.crc32(b" ".join(words[:8]))
    for k, a in enumerate(range(0, max(1, len(words)), BLOCK_WORDS)):
        if ((start + k) % FIRST_EVERY == 0) == first:
            yield words[a : a + BLOCK_WORDS], a + BLOCK_WORDS >= len(words)


def train_round(texts: DataFrame, subword_model: bytes, model: Attention, round_no: int) -> np.ndarray:
    """One round over texts (text binary), of all parameters: the average of what its tasks learn, weighted by their windows.

    The parameters, which grow with the vocabulary's ids that the texts hold and not with the texts, meet in parts.
    """
    start, rate = model.flat(), RATES[round_no]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, mine = Subwords(subword_model), model
        mine.load(start)
        adam, known, seen = Adam(mine, rate), WordNumbers(encode, mine.number), 0
        held: list[tuple[list[bytes], bool]] = []
        waiting = 0

        def learn() -> None:
            nonlocal seen, waiting
            words = list(chain.from_iterable(w for w, _ in held))
            ids, n = known.numbers(known.at(words))
            owner, ended = np.repeat(np.arange(len(held)), [len(w) for w, _ in held]), np.array([e for _, e in held])
            for inputs, target, of in mine.windows(ids, np.bincount(owner, weights=n, minlength=len(held)).astype(np.int64), 0, BATCH_WINDOWS):
                target[(target == END) & ~ended[of, None]] = NONE  # a block's end is not its text's
                adam.step(inputs, target)
                seen += len(inputs)
            held.clear()
            waiting = 0
            if len(known.index) > KNOWN_WORDS:
                known.clear()

        for b in batches:
            for t in b.column(0):
                for block in blocks(words_of(t.as_buffer().to_pybytes() if t.is_valid else None), round_no == 0):
                    held.append(block)
                    waiting += len(block[0]) + 1
                    if waiting >= BATCH_WORDS:
                        learn()
        if held:
            learn()
        if seen:
            flat = mine.flat().astype(np.float64) * seen
            for k in range(0, len(flat), PART):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([flat[k : k + PART]], pa.list_(pa.float64())), pa.array([seen], pa.int64())], names=["k", "w", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for k, w, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                held = sums.setdefault(k, [0.0, 0])
                held[0], held[1] = held[0] + w.values.to_numpy(), held[1] + n
        for k, (w, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([w / n], pa.list_(pa.float64()))], names=["k", "w"])

    learned = texts.mapInArrow(run, "k int, w array<double>, n long")
    out = start.copy()
    for r in learned.repartition("k").mapInArrow(add, "k int, w array<double>").collect():
        out[r.k : r.k + PART] = r.w
    return out


def subword_counts(counts: DataFrame, subword_model: bytes) -> dict[int, int]:
    """For each subword id its tokens in the words, from the counts of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Subwords(subword_model)
        held: Counter[int] = Counter()
        for b in batches:
            words, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            for a in range(0, len(words), 10_000):
                some = encode(words[a : a + 10_000])
                ids = np.fromiter(chain.from_iterable(some), dtype=np.int64)
                sums = np.bincount(ids, weights=np.repeat(n[a : a + 10_000], list(map(len, some))))
                held.update(dict(zip(np.flatnonzero(sums).tolist(), sums[sums > 0].astype(np.int64).tolist(), strict=True)))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.int64())], names=["id", "n"])

    parts = counts.select("word", "c").mapInArrow(run, "id int, n long")
    return {r.id: r.n for r in parts.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def bucketed(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """(doc_id, held_out, text, bucket): neighbouring rows of a file share a bucket, so that a scan meets whole buckets.

    Rows longer than four times the mean have buckets of their own by powers of four, of fewer rows each: none holds more
    than BUCKET_BYTES, but that of one longer text; of the shorter rows one holds an eighth of that on the average. Rows that come from no file are first written to the shared folder.
    """
    cols = [F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("binary").alias("text")]
    place = ["_metadata.file_path", "_metadata.row_index"]
    try:
        src = docs.select(*cols, *place)
    except AnalysisException:
        src = save(docs.select(*cols), "documents").select("doc_id", "held_out", "text", *place)
    all_rows = src.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).head()
    usual = max(64.0, 4 * all_rows.bytes / max(1, all_rows.n))
    length = F.coalesce(F.octet_length("text"), F.lit(0))
    kind = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1)) / usual) / 2)).cast("int")
    rows = F.greatest(F.lit(1), F.floor(BUCKET_BYTES / (usual * F.when(kind == 0, 2.0).otherwise(F.pow(F.lit(4.0), kind)))))
    return src.select("doc_id", "held_out", "text", F.xxhash64("file_path", kind, F.floor(F.col("row_index") / rows)).alias("bucket"))


def bucket_words(docs: DataFrame) -> DataFrame:
    """(bucket, word, c): the words of each bucket's texts and how often its training texts hold them.

    A task sends a pair once for each run of rows of a bucket, or more often where the words fill its memory: the rows of a
    pair add up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Counter[bytes], set[bytes]]] = {}
        for b in batches:
            for k, out, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if t.is_valid:
                    held.setdefault(k, (Counter(), set()))[out].update(words_of(t.as_buffer().to_pybytes()))
            while sum(map(len, chain.from_iterable(held.values()))) > HELD_WORDS:
                yield from _sent(held)
        while held:
            yield from _sent(held)

    return docs.select("bucket", "held_out", "text").mapInArrow(run, "bucket long, word binary, c long")


def _sent(held: dict[int, tuple[Counter[bytes], set[bytes]]]) -> Iterator[pa.RecordBatch]:
    k = next(iter(held))
    counts, others = held.pop(k)
    words = [*counts, *(others - counts.keys())]
    c = np.zeros(len(words), np.int64)
    c[: len(counts)] = list(counts.values())
    for a in range(0, len(words), 50_000):
        part = words[a : a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int64)), pa.array(part, pa.binary()), pa.array(c[a : a + 50_000])], names=["bucket", "word", "c"])


def score_documents(docs: DataFrame, subword_model: bytes, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Words, counts and the model are learned from rows where held_out is false. base_score is the sum over a text's
    words and end of log10((c + 1) / (N + V + 1)); score is the model's log10 probability of its subwords and end. A
    null text is an empty one: an end alone. Without training rows every count is 0 and the model is its prior.
    Repeated rows each keep their row and are counted each; empty tables give no rows; other columns are ignored.
    """
    src = bucketed(docs, id_col, text_col, held_out)
    training = src.where("not held_out").select("text")
    words = save(bucket_words(src), "bucket_words")
    counts = save(words.where("c > 0").groupBy("word").agg(F.sum("c").alias("c")), "words")
    n_train = training.count()
    seen = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).head()
    total, distinct = seen.n + n_train, seen.v + (n_train > 0)
    model = Attention(subword_counts(counts, subword_model), n_train, Subwords(subword_model).first())
    for round_no in range(len(RATES)):
        model.load(train_round(training, subword_model, model, round_no))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        known, tables = WordNumbers(Subwords(subword_model), model.number), model.tables()
        at = known.at(left.column("word").to_pylist())  # a word may have several rows
        c = np.zeros(len(known.index) + 1, np.int64)
        c[at], c[-1] = left.column("c").to_numpy(), n_train
        log_c = np.log10(c + 1.0)
        out: list[tuple] = []
        texts = right.column("text").combine_chunks()
        for a in range(0, right.num_rows, 64):
            where = []
            for t in texts[a : a + 64]:
                w = words_of(t.as_buffer().to_pybytes() if t.is_valid else None)
                where.append(known.at(w))
            ids, n = known.numbers(np.concatenate(where))
            owner = np.repeat(np.arange(len(where)), list(map(len, where)))
            scores = model.score(ids, np.bincount(owner, weights=n, minlength=len(where)).astype(np.int64), tables)
            for w, s in zip(where, scores, strict=True):
                out.append((len(w) + 1, int((c[w] > 0).sum()) + int(n_train > 0), float(log_c[w].sum() + log_c[-1]), float(s)))
        made = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        return pa.Table.from_arrays([right.column("doc_id"), right.column("held_out"), *made], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    known = words.select("bucket", "word").join(counts, "word", "left").select("bucket", "word", F.coalesce("c", F.lit(0)).cast("long").alias("c"))
    shape = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double"
    scored = known.groupBy("bucket").cogroup(src.groupBy("bucket")).applyInArrow(run, shape)
    base = F.col("logs") - F.col("n_tokens") * float(np.log10(total + distinct + 1))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, default_model(), doc_split("doc_id", 7) == 2)
