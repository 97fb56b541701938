"""Language-model scoring by masked pseudo-likelihood.

A network in NumPy predicts each token from the SIDE tokens before it and the SIDE after it, itself
masked; a document's score is the sum of the log-probabilities of all its tokens. Tokens are words
(white-space separated, A-Z lower-cased): the most frequent of the whole corpus have a class each,
the others share hashed classes, within which a word has its share of the words of the whole corpus:
log P(word) = log P(class | context) + log P(word | class), and a word that the corpus hasn't counts
as one more. Classes lie in groups, and the network predicts the group and then the class within it.
Words of at least KNOWN_SHARE of the corpus are broadcast with their counts, rarer ones
joined. The vocabulary comes from the counts of all words of all documents, and grows with them.
The weights are trained on all documents, in rounds, each document in one round by a hash of its id and
text. A round's documents are dealt by that hash into shards of some SHARD_TOKENS tokens; each shard
starts from the shared weights and passes over its documents in the order of the hash, and the shards'
weights are averaged by the tokens that they saw. Shards depend on the documents alone, so weights and
scores are the same (but for rounding) however the table is partitioned and on any number of machines.

Null counts as empty text; texts without words have 0 tokens, the score 0 and no mean. Texts of any
length are read whole. Rows are scored one by one, repeated ones and those of null ids too; an empty
table gives an empty result. Other columns, of any name, aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions

FREQUENT, HASHED, SIDE, WIDTH, HIDDEN = 192, 64, 2, 16, 16
CLASSES, PAD = FREQUENT + HASHED, FREQUENT + HASHED
#: Classes are predicted by group, so that a token costs GROUPS + MEMBERS exponentials and not CLASSES.
GROUPS = 16
MEMBERS = CLASSES // GROUPS
ROUNDS, RATE, STEP_TOKENS, SEED = 2, 0.5, 1024, 11
#: Tokens of a round that a shard trains on, about.
SHARD_TOKENS = 2_000_000
#: Words of this share of the corpus are at most its inverse in number.
KNOWN_SHARE = 1e-6
#: Words counted or remembered at a time in a worker.
HELD_WORDS = 200_000
_BLOCK = 4096


class Classes(dict):
    """Word -> class; remembers hashed words up to a bound."""

    def __init__(self, frequent: list[bytes]):
        import xxhash

        super().__init__({w: i for i, w in enumerate(frequent)})
        self._hash = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        k = FREQUENT + self._hash(word) % HASHED
        if len(self) < HELD_WORDS:
            self[word] = k
        return k

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Network:
    """Embeddings of the context by place, one hidden layer, and a softmax in two steps: over groups of
    classes, then over the classes of the token's group, log P(class) = log P(group) + log P(class | group).
    The last row of an output matrix is its bias, for the hidden layer ends with a 1."""

    SHAPES = (("embed", (CLASSES + 1, WIDTH)), ("inner", (2 * SIDE, WIDTH, HIDDEN)), ("shift", (HIDDEN,)), ("groups", (HIDDEN + 1, GROUPS)), ("members", (GROUPS, HIDDEN + 1, MEMBERS)))
    SIZE = sum(int(np.prod(s)) for _, s in SHAPES)

    def __init__(self, flat: np.ndarray):
        self.flat, at = np.array(flat, np.float32), 0
        for name, shape in self.SHAPES:
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def initial(cls, counts: np.ndarray) -> Network:
        """Small random weights; the biases are the log frequencies of each group and of its classes."""
        net = cls(np.random.default_rng(SEED).normal(0, 0.1, cls.SIZE))
        net.shift[:] = 0
        each = (counts + 1).reshape(GROUPS, MEMBERS)
        net.groups[-1] = np.log(each.sum(1) / each.sum())
        net.members[:, -1] = np.log(each / each.sum(1, keepdims=True))
        return net

    @staticmethod
    def contexts(tokens: np.ndarray) -> np.ndarray:
        """For each token of one document the tokens around it, PAD beyond its ends."""
        padded = np.concatenate([np.full(SIDE, PAD), tokens, np.full(SIDE, PAD)])
        n = len(tokens)
        return np.stack([padded[SIDE + d : SIDE + d + n] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))], 1)

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        by_place = self.embed @ self.inner
        by_place[0] += self.shift
        x = by_place[0].take(around[:, 0], 0)
        for k in range(1, 2 * SIDE):
            x += by_place[k].take(around[:, k], 0)
        out = np.ones((len(around), HIDDEN + 1), np.float32)
        np.tanh(x, out=out[:, :HIDDEN])
        return out

    @staticmethod
    def _by_group(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The order of the groups, and (group, first, end) of those that occur."""
        ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
        return np.argsort(group.astype(np.int16), kind="stable"), [(k, s, e) for k, (s, e) in enumerate(zip([0, *ends], ends, strict=False)) if s < e]

    def _softmax(self, h: np.ndarray, tokens: np.ndarray) -> tuple:
        """Of both steps the logits' exponentials (each row up to a factor), their sums and the logits of the
        tokens; the second step's rows are in the order of groups, with the order, the runs and the members."""
        group, member = np.divmod(tokens, MEMBERS)
        order, runs = self._by_group(group)
        sorted_h, z = h.take(order, 0), np.empty((len(h), MEMBERS), np.float32)
        for k, s, e in runs:
            np.dot(sorted_h[s:e], self.members[k], out=z[s:e])
        return (*_exponentials(h @ self.groups, group, self.groups), *_exponentials(z, member[order], self.members), group, member[order], sorted_h, order, runs)

    def log_probabilities(self, around: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        out = np.empty(len(tokens))
        for i in range(0, len(tokens), _BLOCK):
            _, first, one, _, second, two, _, _, _, order, _ = self._softmax(self._hidden(around[i : i + _BLOCK]), tokens[i : i + _BLOCK])
            part = one - np.log(first)
            part[order] += two - np.log(second)
            out[i : i + _BLOCK] = part
        return out

    def step(self, around: np.ndarray, tokens: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean negative log-probability."""
        n, places = len(tokens), 2 * SIDE
        h, every = self._hidden(around), np.arange(n)
        p, first, _, q, second, _, group, member, sorted_h, order, runs = self._softmax(h, tokens)
        p *= (rate / n / first)[:, None]
        p[every, group] -= rate / n
        q *= (rate / n / second)[:, None]
        q[every, member] -= rate / n
        dh, more = p @ self.groups[:HIDDEN].T, np.empty((n, HIDDEN), np.float32)
        self.groups -= h.T @ p
        for k, s, e in runs:
            np.dot(q[s:e], self.members[k, :HIDDEN].T, out=more[s:e])
            self.members[k] -= sorted_h[s:e].T @ q[s:e]
        dh[order] += more
        h = h[:, :HIDDEN]
        dh *= 1 - h * h
        # for each place the sums of dh by class: its classes sorted, and equal ones summed together
        keys = (around + np.arange(places) * (CLASSES + 1)).T.ravel().astype(np.int16)  # 16 bits sort by radix
        order = np.argsort(keys, kind="stable")
        own = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        by_class = np.zeros((places * (CLASSES + 1), HIDDEN), np.float32)
        by_class[own[starts]] = np.add.reduceat(dh.take(order % n, 0), starts, axis=0)
        by_class = by_class.reshape(places, CLASSES + 1, HIDDEN)
        embed = (by_class @ self.inner.transpose(0, 2, 1)).sum(0)
        self.inner -= self.embed.T @ by_class
        self.embed -= embed
        self.shift -= dh.sum(0)


def _exponentials(z: np.ndarray, own: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(z) in place, each row up to a factor where a logit could overflow; its rows' sums; the logits of `own`."""
    if abs(outer).sum(-2).max() >= 80:  # the hidden layer is within -1 and 1
        z -= z.max(1, keepdims=True)
    own = z[np.arange(len(z)), own]
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], np.float32), own


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.col(text_col).cast("string").alias("text"))


def word_counts(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(word binary, n) of all words of all texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def made(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                counts.update((t or "").encode().lower().split())
                if len(counts) > HELD_WORDS:
                    yield made(counts)
                    counts = Counter()
        yield made(counts)

    return _texts(df, text_col).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _class_counts(words: DataFrame, frequent: list[bytes]) -> np.ndarray:
    """Words of each class, of (word, n) of all words."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        classes, counts = Classes(frequent), np.zeros(CLASSES, np.int64)
        for b in batches:
            np.add.at(counts, [classes[w] for w in b.column("word").to_pylist()], b.column("n").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(counts)], names=["k", "n"])

    counts = np.zeros(CLASSES)
    for r in words.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r.k] = r.n
    return counts


class Words:
    """Counts of all words: those that workers hold, and the table of all (word, n)."""

    def __init__(self, table: DataFrame, class_counts: np.ndarray):
        self.table, self.class_counts = table, class_counts
        #: The least count of the words held.
        self.least = max(1, math.ceil(class_counts.sum() * KNOWN_SHARE))
        held = table.where(F.col("n") >= self.least).toArrow()
        self.held, self.counts = held.column("word").to_pylist(), held.column("n").to_numpy()

    def rarer(self) -> DataFrame:
        """(hash, log_n) of words that aren't held and occur twice at least (the logarithm of one is 0)."""
        return self.table.where((F.col("n") < self.least) & (F.col("n") > 1)).select(F.xxhash64("word").alias("hash"), F.log("n").alias("log_n"))


class Shares(dict):
    """Word -> place of a held word in the arrays `classes` and `logs` (log P(word | class)); of another
    word -(class + 1), whose share is the class' part in `rest`, to which the join adds log n."""

    def __init__(self, frequent: list[bytes], held: list[bytes], counts: np.ndarray, class_counts: np.ndarray):
        self._others, self.rest = Classes(frequent), -np.log(class_counts + 1)
        self.classes = np.array([self._others[w] for w in held], np.int64)
        self.logs = np.where(self.classes < FREQUENT, 0.0, np.log(np.maximum(counts, 1)) + self.rest[self.classes]) if len(held) else np.zeros(0)
        super().__init__(zip(held, range(len(held)), strict=True))

    def __missing__(self, word: bytes) -> int:
        code = -1 - self._others[word]
        if len(self) < len(self.classes) + HELD_WORDS:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(classes, logs, places of those that aren't held)."""
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        other = np.flatnonzero(codes < 0)
        known = np.maximum(codes, 0)
        tokens = self.classes[known] if len(self.classes) else np.zeros(len(codes), np.int64)
        logs = self.logs[known] if len(self.classes) else np.zeros(len(codes))
        tokens[other] = -1 - codes[other]
        logs[other] = self.rest[tokens[other]]
        return tokens, logs, other


def fit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[list[bytes], np.ndarray, Words]:
    """The frequent words, the weights and the counts of all words."""
    words = checkpointed(word_counts(df, text_col=text_col))
    frequent = [bytes(r.word) for r in words.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    counts = _class_counts(words, frequent)
    net, shards = Network.initial(counts), max(1, math.ceil(counts.sum() / rounds / SHARD_TOKENS))
    mark = F.xxhash64(F.col(id_col).cast("string"), "text")
    texts = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).select("text", mark.alias("mark"))
    texts = texts.withColumn("shard", F.pmod(F.shiftright("mark", 16), F.lit(shards)))
    for number in range(rounds):
        start, rate = net.flat.copy(), RATE / (1 + number)

        def train(batches: Iterator, start: np.ndarray = start, rate: float = rate) -> Iterator:
            import pyarrow as pa

            classes, total, shard, net, seen, held = Classes(frequent), np.zeros(Network.SIZE + 1), None, None, 0, []

            def closed() -> None:
                nonlocal seen, held
                if held:
                    seen += _epoch(net, held, rate)
                if seen:
                    total[:-1] += net.flat.astype(np.float64) * seen
                    total[-1] += seen
                seen, held = 0, []

            for b in batches:
                for text, own in zip(b.column("text").to_pylist(), b.column("shard").to_pylist(), strict=True):
                    if own != shard:
                        closed()
                        shard, net, n = own, Network(start), 0
                    tokens = classes.of(text)
                    if len(tokens):
                        held.append(tokens)
                        n += len(tokens)
                        if n >= 64 * STEP_TOKENS:
                            seen += _epoch(net, held, rate)
                            held, n = [], 0
            closed()
            if total[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "value"])

        # a shard's rows lie together and in order, however many tasks there are; a shard is streamed, not held
        own = texts.where(F.pmod("mark", F.lit(rounds)) == number)
        own = own.repartition(min(shards, shuffle_partitions(df.sparkSession)), "shard").sortWithinPartitions("shard", "mark", "text").select("shard", "text")
        # as many rows as weights, summed by Spark
        sums = {r.k: r.value for r in own.mapInArrow(train, "k bigint, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()}
        if sums:
            net = Network(np.array([sums[k] for k in range(Network.SIZE)]) / sums[Network.SIZE])
    return frequent, net.flat, Words(words, counts)


def _epoch(net: Network, texts: list[np.ndarray], rate: float) -> int:
    around, tokens = np.concatenate([Network.contexts(t) for t in texts]), np.concatenate(texts)
    order = np.random.default_rng(len(tokens)).permutation(len(tokens))
    for i in range(0, len(order), STEP_TOKENS):
        at = order[i : i + STEP_TOKENS]
        net.step(around.take(at, 0), tokens.take(at), rate)
    return len(tokens)


def score(df: DataFrame, model: tuple[list[bytes], np.ndarray, Words], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns per row id_col, n_tokens, log_likelihood, mean_log_likelihood."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    frequent, flat, words = model
    held = df.sparkSession.sparkContext.broadcast((words.held, words.counts, words.class_counts))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        shares, net = Shares(frequent, *held.value), Network(flat)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i in range(0, len(texts), 256):
                said = [(t or "").encode().lower().split() for t in texts[i : i + 256]]
                sizes = np.array([len(ws) for ws in said])
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                every = list(chain.from_iterable(said))
                tokens, logs, at = shares.of(every)
                around = np.concatenate([Network.contexts(tokens[s:e]) for s, e in zip(bounds, bounds[1:], strict=False)])
                ends = np.concatenate([[0], np.cumsum(net.log_probabilities(around, tokens) + logs)])[bounds]
                hashes = pa.array(np.array([xxhash.xxh64_intdigest(every[j], 42) for j in at], np.uint64).view(np.int64))  # F.xxhash64
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds).astype(np.int32)), hashes)
                yield pa.RecordBatch.from_arrays([b.column("row").slice(i, 256), b.column("id").slice(i, 256), pa.array(sizes, pa.int64()), pa.array(np.diff(ends), pa.float64()), rare], names=["row", "id", "n_tokens", "known", "rare"])

    out = rows.mapInArrow(run, f"row bigint, id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, known double, rare array<bigint>")
    total = F.col("known")
    if words.least > 2:
        out = checkpointed(out)
        rarer = words.rarer().repartition(shuffle_partitions(df.sparkSession), "hash")
        more = out.select("row", F.explode("rare").alias("hash")).join(rarer, "hash").groupBy("row").agg(F.sum("log_n").alias("more"))
        out = out.drop("rare").join(more, "row", "left")
        total = total + F.coalesce("more", F.lit(0.0))
    out = out.select(F.col("id").alias(id_col), "n_tokens", total.alias("log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
