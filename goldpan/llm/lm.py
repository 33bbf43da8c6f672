r"""Language-model scoring by masked pseudo-likelihood.

Tokens are the words ``\w+`` and single other visible characters of the lower-cased text. A token's
probability given both sides, the two tokens before and the two after, has three factors:

* p(class | sides) x p(slot | class, sides), by a window network. The ``own`` most frequent words have
  a slot each, all others share the remaining slots by their CRC-32, so every word's probability
  depends on its sides. Slots are cut into classes in the order of frequency.
* p(word | slot): the word's share of its slot's counts, which are one more for words never seen. The
  words of all documents are counted, and the counts of all of them stay a table: only the
  slots are bounded.

The network is trained in numpy: the slots of the four neighbours, or the document's edge, choose rows of
four tables, whose sum goes through tanh to the two softmax layers. Every window of every document
trains it once: those of one document in ``LEAD``, by a hash, give the weights that all others start
from. Each task takes Adagrad steps from these and returns its own weights, averaged by windows in a
tree, so the last digits of scores depend on how the files are cut into tasks.

A document's score is the sum of log p over all its tokens, each predicted once from both sides.

Plan: two passes over the text (counts, and the tokens as numbers, which are written) and two over
the numbers (training, scores), none of which moves text. Words beyond the ``top`` most frequent, a row for
each time one occurs, meet the table of counts in a join by word; none of them has over 1 / ``top`` of
all tokens. What is counted grows with the corpus; what is broadcast (``top`` words, one network) and
what the driver collects (the same, and at most ``TREE`` networks at once) doesn't.

Edges: a null or empty text, or one of white space only, has 0 tokens, pseudo_logp 0 and a null
mean_logp. Long texts are scored in parts with their true neighbours. Rows that repeat count and
score as often as they occur. Without any token the network stays as it began. An empty table
gives no rows. Ids may be null. Other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldpan.scratch import Scratch

TOKEN = re.compile(r"\w+|[^\w\s]")
SIDES = (-2, -1, 1, 2)
CLASSES, MEMBERS, HIDDEN = 32, 64, 15
LEAD = 8
FLUSH, PART = 600_000, 1 << 16
TREE = 16


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


class Vocabulary:
    """Words by falling count, their slots and their log share in the slot.

    A word's number is its place among ``words`` or, for any other, len(words) plus its shared slot.
    shared: the counts of all words of each CRC-32 modulo the number of shared slots.
    """

    def __init__(self, words: list[str], counts: list[int], shared: np.ndarray, classes: int = CLASSES, members: int = MEMBERS):
        self.at = {w: i for i, w in enumerate(words)}
        self.classes, self.members, self.shared = classes, members, len(shared)
        self.slots = classes * members
        own = min(self.slots - self.shared, len(words))
        n = np.array(counts, dtype=np.float64)
        code = np.array([zlib.crc32(w.encode()) % self.shared for w in words], np.int64)
        left = np.asarray(shared, np.float64) - np.bincount(code[:own], n[:own], minlength=self.shared)
        slot = np.r_[np.arange(own), self.slots - self.shared + code[own:], self.slots - self.shared + np.arange(self.shared)]
        self.slot = slot.astype(np.int16)  # by number
        self.within = np.r_[np.zeros(own), np.log(n[own:]) - np.log(left[code[own:]] + 1), -np.log(left + 1)]  # of a word seen once; score() adds the log of its count
        mass = np.full(self.slots, 0.5)
        mass[:own] += n[:own]
        mass[self.slots - self.shared :] += left
        self.share = mass / mass.sum()
        self.counts: DataFrame | None = None  # of all words, where the driver knows them

    def __getstate__(self) -> dict:
        return {**self.__dict__, "counts": None}

    def numbers(self, found: list[str]) -> np.ndarray:
        get, top, shared = self.at.get, len(self.at), self.shared
        out = [get(t, -1) for t in found]
        row = np.array(out, np.int32)
        for k in np.flatnonzero(row < 0).tolist():
            row[k] = top + zlib.crc32(found[k].encode()) % shared
        return row

    def encode(self, text: str | None) -> np.ndarray:
        return self.numbers(tokens(text))


class Network:
    """Window network: four tables of rows by slot, tanh, a softmax over classes and one over the slots of a class.

    The last column of both output layers is the bias. Weights stay within LIMIT, so no exponential overflows.
    """

    LIMIT = 4.0

    def __init__(self, classes: int = CLASSES, members: int = MEMBERS, hidden: int = HIDDEN, share: np.ndarray | None = None, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes, self.members, self.hidden = classes, members, hidden
        slots = classes * members
        self.edge = slots  # the slot of a place outside the document
        self.tables = (rng.standard_normal((len(SIDES), slots + 1, hidden)) * 0.1).astype(np.float32)
        self.top = (rng.standard_normal((classes, hidden + 1)) * 0.1).astype(np.float32)
        self.low = (rng.standard_normal((slots, hidden + 1)) * 0.1).astype(np.float32)
        share = (np.full(slots, 1 / slots) if share is None else share).reshape(classes, members)
        mass = share.sum(axis=1, keepdims=True)
        self.top[:, -1] = np.log(mass[:, 0])
        self.low[:, -1] = np.log(share / mass).ravel()

    def weights(self) -> np.ndarray:
        return np.concatenate([self.tables.ravel(), self.top.ravel(), self.low.ravel()])

    def with_weights(self, w: np.ndarray) -> Network:
        new = Network.__new__(Network)
        new.__dict__.update(self.__dict__)
        w = np.array(w, np.float32)
        a, b = self.tables.size, self.tables.size + self.top.size
        new.tables, new.top, new.low = w[:a].reshape(self.tables.shape), w[a:b].reshape(self.top.shape), w[b:].reshape(self.low.shape)
        return new

    def layer(self, context: np.ndarray) -> np.ndarray:
        """The hidden layer and a column of ones; context has a row for each side."""
        h = np.empty((context.shape[1], self.hidden + 1), np.float32)
        total = self.tables[0].take(context[0], axis=0)
        for k in range(1, len(SIDES)):
            total += self.tables[k].take(context[k], axis=0)
        np.tanh(total, out=h[:, :-1])
        h[:, -1] = 1
        return h

    def blocks(self, target: np.ndarray) -> list[tuple[int, int, int]]:
        """(class, begin, end) in sorted targets."""
        ends = np.searchsorted(target, np.arange(1, self.classes + 1) * self.members)
        return [(c, a, b) for c, (a, b) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())) if b > a]

    def log_p(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p(target | context). Targets are sorted."""
        h, m, n = self.layer(context), self.members, len(target)
        own, total, at = np.empty(n, np.float32), np.empty(n, np.float32), np.arange(n)
        ones, group, member = np.ones(max(m, self.classes), np.float32), target // m, target % m
        for c, a, b in self.blocks(target):
            z = h[a:b] @ self.low[c * m : (c + 1) * m].T
            own[a:b] = z.ravel().take(at[: b - a] * m + member[a:b])
            np.matmul(np.exp(z, out=z), ones[:m], out=total[a:b])
        z = h @ self.top.T
        own += z.ravel().take(at * self.classes + group)
        return own - np.log(total) - np.log(np.exp(z, out=z) @ ones[: self.classes])

    def _expected(self, h: np.ndarray, w: np.ndarray, scale: np.float32, back: np.ndarray) -> np.ndarray:
        """What all outputs w add to the gradients, of h in ``back`` and of w."""
        z = h @ w.T
        np.exp(z, out=z)
        ones = w.copy()
        ones[:, -1] = 1  # the product's last column is then the sum
        r = z @ ones
        s = scale / r[:, -1:]
        back += r * s
        return z.T @ (h * s)

    def gradient(self, context: np.ndarray, target: np.ndarray):
        """Of the mean loss: of the tables and of both output layers. Targets are sorted."""
        scale, h, m = np.float32(1 / len(target)), self.layer(context), self.members
        back = np.zeros_like(h)
        top, low = self._expected(h, self.top, scale, back), np.zeros_like(self.low)
        for c, a, b in self.blocks(target):
            low[c * m : (c + 1) * m] = self._expected(h[a:b], self.low[c * m : (c + 1) * m], scale, back[a:b])
        met = summed_by(target, h * scale, len(low))
        low -= met
        top -= met.reshape(self.classes, m, -1).sum(axis=1)
        back -= scale * (self.top.take(target // m, axis=0) + self.low.take(target, axis=0))
        h = h[:, :-1]
        back = (back[:, :-1] * (1 - h * h)).astype(np.float64)
        return np.stack([summed_by(side, back, self.edge + 1) for side in context]), top, low


def summed_by(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the values' rows that go to each of n rows."""
    width = values.shape[1]
    cells = rows.astype(np.int64)[:, None] * width + np.arange(width)
    return np.bincount(cells.ravel(), values.ravel(), n * width).reshape(n, width).astype(np.float32)


class Adagrad:
    def __init__(self, network: Network, rate: float):
        self.net, self.rate = network, np.float32(rate)
        self.squares = network.with_weights(np.full(network.weights().size, 1e-8, np.float32))

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        """Targets are sorted."""
        net, squares, rate = self.net, self.squares, self.rate
        tables, top, low = net.gradient(context, target)
        for w, s, g in ((net.tables, squares.tables, tables), (net.top, squares.top, top), (net.low, squares.low, low)):
            s += g * g
            g *= rate
            g /= np.sqrt(s)
            w -= g
        for w in (net.top, net.low):
            np.clip(w[:, :-1], -net.LIMIT, net.LIMIT, out=w[:, :-1])
            np.clip(w[:, -1], -4 * net.LIMIT, net.LIMIT, out=w[:, -1])


def windows(slots: list[np.ndarray], edge: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all tokens of some documents in a row, padded by edges, and the tokens' places."""
    pad = np.full(2, edge, np.int16)
    row = np.concatenate([pad, *(x for s in slots for x in (s, pad))])
    sizes = np.array([len(s) for s in slots])
    starts = 2 + np.cumsum(sizes + 2) - (sizes + 2)
    place = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return row, place


def encoded(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ids, rare, doc_id, at): each document's tokens as numbers of the vocabulary, its rare words, and a number of the row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most top words
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids, rare = [], []
                for text in part.column(0):
                    found = tokens(text.as_py())
                    numbers = shared.value.numbers(found)
                    ids.append(numbers.tobytes())
                    rare.append([found[k] for k in np.flatnonzero(numbers >= len(shared.value.at)).tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.string())), part.column(1)], names=["ids", "rare", "doc_id"])

    return docs.select(text_col, id_col).mapInArrow(run, f"ids binary, rare array<string>, doc_id {kind}").withColumn("at", F.monotonically_increasing_id())


def gathered(batches):
    """The encoded texts of a task, about PART tokens at a time, with their batch and rows."""
    for batch in batches:
        held, rows, n = [], [], 0
        for i, text in enumerate(batch.column(0)):
            ids = np.frombuffer(text.as_py(), np.int32)
            held.append(ids)
            rows.append(i)
            n += len(ids)
            if n >= PART:
                yield batch, rows, held
                held, rows, n = [], [], 0
        if held:
            yield batch, rows, held


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over whole texts of all documents."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            pairs = list(seen.items())
            seen.clear()
            for k in range(0, len(pairs), 50_000):
                words, n = zip(*pairs[k : k + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens(text.as_py()))
                if len(seen) > FLUSH:
                    yield from out()
        yield from out()

    return docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn_vocabulary(docs: DataFrame, top: int = 30_000, classes: int = CLASSES, members: int = MEMBERS, text_col: str = "text", scratch: Scratch | None = None) -> Vocabulary:
    scratch = scratch or Scratch(docs.sparkSession, "lm")
    counts = scratch.table(count_words(docs, text_col), "words")
    best = counts.orderBy(F.col("n").desc(), "word").limit(top).collect()
    shared = np.zeros(max(1, classes * members // 4))
    code = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(len(shared)))
    for r in counts.groupBy(code.alias("code")).agg(F.sum("n").alias("n")).collect():  # at most as many as shared slots
        shared[r["code"]] = r["n"]
    vocabulary = Vocabulary([r["word"] for r in best], [r["n"] for r in best], shared, classes, members)
    vocabulary.counts = counts
    return vocabulary


def summed(parts: DataFrame, scratch: Scratch) -> tuple[np.ndarray, int]:
    """Of rows (weights as bytes of floats, their windows) the mean by windows, in a tree, and all windows."""

    def mean(rows: list[tuple[bytes, int]]) -> tuple[np.ndarray, int]:
        n = sum(k for _, k in rows)
        return sum(np.frombuffer(w, np.float32) * (k / n) for w, k in rows), n

    def run(batches):
        rows = [(w.as_py(), k.as_py()) for batch in batches for w, k in zip(batch.column(0), batch.column(1))]
        if rows:
            w, n = mean(rows)
            yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["w", "n"])

    parts = scratch.table(parts, "weights")
    while (rows := parts.count()) > TREE:
        less = scratch.table(parts.repartition(-(-rows // TREE)).mapInArrow(run, "w binary, n long"), "weights")
        scratch.drop(parts)
        parts = less
    found = [(r["w"], r["n"]) for r in parts.orderBy("n", "w").collect()]
    scratch.drop(parts)
    return mean(found) if found else (np.zeros(0), 0)


def train(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, **options) -> Network:
    scratch = scratch or Scratch(docs.sparkSession, "lm")
    return train_encoded(scratch.table(encoded(docs, vocabulary, id_col, text_col), "encoded"), vocabulary, scratch, **options)


def train_encoded(texts: DataFrame, vocabulary: Vocabulary, scratch: Scratch, hidden: int = HIDDEN, batch_size: int = 4096, rate: float = 0.1, passes: int = 1) -> Network:
    network = Network(vocabulary.classes, vocabulary.members, hidden, vocabulary.share)
    slot = texts.sparkSession.sparkContext.broadcast(vocabulary.slot)  # at most top words

    def one_round(texts: DataFrame, start: Network) -> DataFrame:
        def run(batches):
            descent = Adagrad(start.with_weights(start.weights()), rate)
            seen, held_context, held_target, waiting = 0, [], [], 0

            def steps(size: int):
                nonlocal seen, held_context, held_target, waiting
                context, target = np.concatenate(held_context, axis=1), np.concatenate(held_target)
                order = np.random.default_rng(seen).permutation(len(target))
                last = len(order) - len(order) % size
                for k in range(0, last, size):
                    at = order[k : k + size]
                    at = at[np.argsort(target.take(at), kind="stable")]
                    descent.step(context.take(at, axis=1), target.take(at))
                    seen += size
                rest = order[last:]
                held_context, held_target, waiting = [context[:, rest]], [target[rest]], len(rest)

            for _, _, held in gathered(batches):
                row, place = windows([slot.value[ids] for ids in held], start.edge)
                held_context.append(np.stack([row[place + k] for k in SIDES]))
                held_target.append(row[place])
                waiting += len(place)
                if waiting >= PART:
                    steps(batch_size)
            if waiting >= batch_size:
                steps(batch_size)
            if waiting:
                steps(waiting)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([descent.net.weights().tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["w", "n"])

        return texts.select("ids").mapInArrow(run, "w binary, n long")

    lead = F.pmod(F.xxhash64("at"), F.lit(LEAD)) == 0
    for _ in range(passes):
        for part in (lead, ~lead):
            total, n = summed(one_round(texts.where(part), network), scratch)
            if n:
                network = network.with_weights(total)
    return network


def log_probabilities(held: list[np.ndarray], vocabulary: Vocabulary, network: Network, step: int = 1 << 14) -> np.ndarray:
    """log p of every token of some encoded documents, one after another."""
    row, place = windows([vocabulary.slot[ids] for ids in held], network.edge)
    out = vocabulary.within[np.concatenate(held)] if held else np.zeros(0)
    for k in range(0, len(place), step):
        at = place[k : k + step]
        order = np.argsort(row[at], kind="stable")
        at = at[order]
        out[k + order] += network.log_p(np.stack([row[at + side] for side in SIDES]), row[at])
    return out


def score(docs: DataFrame, vocabulary: Vocabulary, network: Network, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """A row for each document: doc_id, tokens, pseudo_logp, mean_logp."""
    scratch = scratch or Scratch(docs.sparkSession, "lm")
    return score_encoded(scratch.table(encoded(docs, vocabulary, id_col, text_col), "encoded"), vocabulary, network)


def score_encoded(texts: DataFrame, vocabulary: Vocabulary, network: Network) -> DataFrame:
    """texts: a written table, as rows are joined by their numbers."""
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, network))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        vocabulary, network = shared.value
        for batch, rows, held in gathered(batches):
            n = np.array([len(ids) for ids in held])
            p, some, total = log_probabilities(held, vocabulary, network), n > 0, np.zeros(len(n))
            if some.any():
                total[some] = np.add.reduceat(p, (np.cumsum(n) - n)[some])
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), pa.array(n, pa.int64()), pa.array(total)], names=["doc_id", "at", "tokens", "p"])

    found = texts.select("ids", "doc_id", "at").mapInArrow(run, f"doc_id {kind}, at long, tokens long, p double")
    p = F.col("p")
    if vocabulary.counts is not None:
        # The log of 1 adds nothing, so words seen once stay out, as do unseen ones.
        seen = vocabulary.counts.where("n > 1").select("word", F.log("n").alias("log_n"))
        more = texts.select(F.col("at").alias("_at"), F.explode("rare").alias("word")).join(seen, "word").groupBy("_at").agg(F.sum("log_n").alias("more"))
        found = found.join(more, F.col("at") == F.col("_at"), "left")
        p = p + F.coalesce("more", F.lit(0.0))
    return found.select("doc_id", "tokens", p.alias("pseudo_logp"), F.when(F.col("tokens") > 0, p / F.col("tokens")).alias("mean_logp"))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = 30_000, **options) -> DataFrame:
    """Learn from all documents and score all of them."""
    scratch = Scratch(docs.sparkSession, "lm")
    vocabulary = learn_vocabulary(docs, top, text_col=text_col, scratch=scratch)
    texts = scratch.table(encoded(docs, vocabulary, id_col, text_col), "encoded")
    return score_encoded(texts, vocabulary, train_encoded(texts, vocabulary, scratch, **options))


def op4_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, tokens, pseudo_logp, mean_logp."""
    return pseudo_likelihood(spark.read.parquet(f"{sf_dir}/documents.parquet"))
