"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class, context). The HEAD most frequent words are in
classes of WIDTH by frequency; all others are in tail classes by a hash of their last two bytes. Both
factors are log-linear in hashed features of the context: the word before, the one before that (a skip
feature), both of head words by name and of all others by hash, and the two together, where words outside
the head go by their tail class; within a tail class words have their smoothed relative frequency, and each
tail class keeps the share of one unseen word, so probabilities add up to one.

This part has a fixed size. What grows with the input are exact counts of hashed n-grams over the whole
corpus, of any words: each word with the one two before, with the one before, and with both. Each of the
three, in this order, draws the probability towards the share of the word among all that followed the
context, with a weight by the context's count; this keeps the sum at one. A training token is left out of
its own n-grams' counts.

1. Texts are read once, into blocks: a block's distinct words (64-bit hashes), and its tokens as numbers of them.
   Blocks send their distinct words with counts to buckets of the hash range,
   which add them up and return every block's totals: exact corpus counts without a shared vocabulary.
   N-grams go the same way, to buckets of their own, as hashes of as many bits as the input's size asks for.
   The number of buckets follows the input's bytes.
2. Training sees every training document once, in ROUNDS disjoint parts. In a round each partition runs
   AdaGrad over its documents in mini-batches, from the weights of the round before; weights are then
   averaged row by row, by how often a row was updated, in a tree of small groups. Their size is fixed.
3. The weights of the n-grams, one for each doubling of a context's count, are fitted by EM to every training token:
   blocks count their tokens by the context's count and by how far the n-gram's share is from the probability.
4. Blocks meet their totals again and are scored in sparse numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import pack, unpack
from quarry.llm.common import digest, frees, frees_group, frees_groups, in_order, mix, nullable, pack_ids, ranges, ranked, release, shuffles_freed, small_batches, spread, text_or_empty, unpack_ids, words_of, written

HEAD, WIDTH, TAILS = 1024, 64, 16
HEAD_CLASSES = HEAD // WIDTH
CLASSES = HEAD_CLASSES + TAILS
#: Rows of the hashed pair features, and of each hashed feature of the words within a class.
PAIR_ROWS, WORD_ROWS = 8192, 8192
#: Numbers of the words outside the head, by hash; a number's tail class is its remainder by TAILS.
TAIL_ROWS = 4096
FEATURES = HEAD + TAIL_ROWS + 1  # what a context word can be: a head word, a hashed one, or the beginning
COARSE = HEAD + TAILS + 1  # the same with tail classes for hashed words
#: Of each feature, what it is among the coarse ones; of each word's number, its class.
COARSE_OF = np.concatenate([np.arange(HEAD), HEAD + np.arange(TAIL_ROWS) % TAILS, [HEAD + TAILS]])
CLASS_OF = np.concatenate([np.arange(HEAD) // WIDTH, HEAD_CLASSES + np.arange(TAIL_ROWS) % TAILS])
#: Bound of the logits, which keeps their exponentials finite.
MOST_LOGIT = 80.0
ROUNDS, BATCH, RATE, START = 2, 4096, 0.25, 1.0
HELD_OUT_OF, HELD_OUT_IS = 7, 2
BLOCK_BYTES = 8 << 20
_U = np.uint64
_LOW = _U(TAILS - 1)
#: The hash of the end of a text.
END = _U(0x1B873593CC9E2D50)
LN10 = float(np.log(10))
#: What stands before a text, and before that.
BEGIN, NONE = _U(0x2545F4914F6CDD1D), _U(0x9E6C63D0876A9A47)
#: Bits of an n-gram's hash beyond those of the input's number of bytes: two n-grams in a few thousand share one.
GRAM_SPARE = 10
#: Bytes of text for each bucket of words, and of n-grams.
WORD_BYTES, GRAM_BYTES = 64 << 20, 8 << 20
#: Weights by context count: none for 0, then one for each doubling. Groups in which blocks' tallies are added up.
BINS, FIT_FANS = 42, 32
#: Cells of an n-gram's share over the probability it is mixed into: one for no share, then STEPS to a doubling, REACH doublings either way; and the ratio that stands for each.
STEPS, REACH = 8, 32
CELLS = 1 + 2 * STEPS * REACH
RATIOS = np.append(0.0, 2.0 ** ((np.arange(CELLS - 1) + 0.5) / STEPS - REACH))


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts with an END after each text, and where each text begins. The lowest bits are the tail class."""
    hashes, begins, data, starts, ends = words_of([t.lower() for t in texts])
    raw = np.frombuffer(data, np.uint8)
    if len(ends):
        tail = raw[ends - 1].astype(_U) | (raw[np.maximum(ends - 2, starts)].astype(_U) << _U(8))
        hashes = (hashes & ~_LOW) | (mix(tail + _U(77)) & _LOW)
    return np.insert(hashes, begins[1:], END), begins + np.arange(len(begins))


def before(values: np.ndarray, begins: np.ndarray, first, zeroth) -> tuple[np.ndarray, np.ndarray]:
    """What stands one and two places before each token: first before a text, zeroth before that."""
    one, two = np.full(len(values), first, values.dtype), np.full(len(values), first, values.dtype)
    one[1:], two[2:] = values[:-1], values[:-2]
    at = begins[:-1]
    one[at], two[at] = first, zeroth
    second = at + 1
    two[second[second < begins[1:]]] = first
    return one, two


def grams(hashes: np.ndarray, begins: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """Keys of each token with the word two before, then with the one before, then with both; and of END after each of words and after BEGIN."""
    one, two = before(hashes, begins, BEGIN, NONE)
    n = len(hashes)
    keys = np.empty(3 * n + len(words) + 1, _U)
    keys[:n] = mix(mix(two + _U(1)) + hashes)
    keys[n : 2 * n] = mix(mix(one + _U(2)) + hashes)
    two += _U(3)
    keys[2 * n : 3 * n] = mix(mix(mix(two) + one) + hashes)
    keys[3 * n :] = mix(mix(np.append(words, BEGIN) + _U(2)) + END)
    keys >>= _U(64 - bits)
    return keys


def gram_bits(n_bytes: int) -> int:
    return min(63, max(32, n_bytes.bit_length() + GRAM_SPARE))


def narrow(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte planes apart, compressed."""
    steps = np.diff(keys, prepend=_U(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(keys) else 1
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def wide(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return np.cumsum(out.view("<u8").ravel(), dtype=_U)


class Block:
    """Texts in a row: their tokens, ids and whether they are learned from."""

    def __init__(self):
        self.ids, self.train, self.texts, self.bytes = [], [], [], 0

    def add(self, doc_id, train, text: bytes) -> None:
        self.ids.append(doc_id)
        self.train.append(train)
        self.texts.append(text)
        self.bytes += len(text)

    def row(self, number: int) -> pa.RecordBatch:
        """block, bytes, doc_ids, train, sizes, words, stream; frequent words have small numbers."""
        hashes, begins = sequences(self.texts)
        words, at = ranked(hashes)
        often = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[often] = np.arange(len(words))
        values = [pa.array([x], t) for x, t in ((number, pa.int64()), (self.bytes, pa.int64()), (pack_ids(self.ids), pa.binary()), (self.train, pa.list_(pa.bool_())), (np.diff(begins).tolist(), pa.list_(pa.int64())), (words[often].tobytes(), pa.binary()), (pack(rank[at]), pa.binary()))]
        return pa.RecordBatch.from_arrays(values, ["block", "bytes", "doc_ids", "train", "sizes", "words", "stream"])


def blocks_of(source: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """The texts (doc_id, train, text as binary) as rows of Block; a longer text is a block of its own."""

    def run(batches):
        part, n, block = TaskContext.get().partitionId(), 0, Block()
        for b in batches:
            for doc_id, train, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                block.add(doc_id, train, text.as_py())
                if block.bytes >= most:
                    yield block.row(part << 24 | n)
                    n, block = n + 1, Block()
        if block.ids:
            yield block.row(part << 24 | n)

    return source.mapInArrow(frees(run), "block long, bytes long, doc_ids binary, train array<boolean>, sizes array<long>, words binary, stream binary")


class Tokens:
    """A block's row, unpacked: words (hashes), stream (each token's number among them), begins of texts, and which tokens are learned from."""

    def __init__(self, words: bytes, stream: bytes, sizes, train):
        self.words, self.stream = np.frombuffer(words, _U), unpack(stream)
        self.begins = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
        self.learned = np.repeat(np.asarray(train, bool), np.diff(self.begins))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Tokens, np.ndarray]]:
    """Of a table of blocks (block, doc_ids, train, sizes, words, stream): the number, the tokens and the ids (0 for none)."""
    for b in batches:
        for i in range(b.num_rows):
            block, ids, train, sizes, words, stream = (c[i] for c in b.columns)
            yield block.as_py(), Tokens(words.as_py(), stream.as_py(), sizes.values.to_numpy(), train.values.to_numpy(zero_copy_only=False)), unpack_ids(ids.as_py())[0]


_COLUMNS = ("block", "doc_ids", "train", "sizes", "words", "stream")


def block_counts(blocks: DataFrame, lead: int, gram_lead: int, bits: int) -> DataFrame:
    """bucket, block, words, counts, digest: each block's distinct words of each range of leading bits, with their number in training texts; so its n-grams, in buckets from -1 down."""

    def parted(number, words, counts, bits, lead, raw, sign):
        bucket = (words >> _U(bits - lead)).astype(np.int64) if lead else np.zeros(len(words), np.int64)
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        parts = list(zip(starts, np.append(starts[1:], len(words)), strict=True))
        at = bucket[starts] if sign > 0 else -1 - bucket[starts]
        batch = [pa.array(at), pa.array(np.full(len(starts), number)), pa.array([raw(words[s:e]) for s, e in parts], pa.binary()), pa.array([pack(counts[s:e]) for s, e in parts], pa.binary()), pa.array([digest(words[s:e]) for s, e in parts], pa.int64())]
        return pa.RecordBatch.from_arrays(batch, ["bucket", "block", "words", "counts", "digest"])

    def run(batches):
        for number, t, _ in rows_of(batches):
            order = np.argsort(t.words)
            counts = np.bincount(t.stream, t.learned, len(t.words)).astype(np.int64)
            yield parted(number, t.words[order], counts[order], 64, lead, np.ndarray.tobytes, 1)
            keys, counts = marked(grams(t.words[t.stream], t.begins, t.words, bits), np.tile(t.learned, 3))
            del t, order
            yield parted(number, keys, counts, bits, gram_lead, narrow, -1)
            del keys, counts
            release()

    return blocks.select(*_COLUMNS).mapInArrow(frees(run), "bucket long, block long, words binary, counts binary, digest long")


def marked(keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (of 63 bits at most), ascending, and of each how many are marked; keys beyond the marks are not. keys is written over."""
    keys <<= _U(1)
    keys[: len(marks)] |= marks
    keys.sort()
    mark = (keys & _U(1)).astype(np.uint8)
    keys >>= _U(1)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(mark, first, dtype=np.int32)


def totals(parts: DataFrame, bits: int) -> DataFrame:
    """bucket, block, totals, digest: the corpus counts of each block's words and n-grams; and for each bucket of words a row with block -1: its most
    frequent words (top, top_counts), and by tail class the tokens and distinct words that were counted (tokens, types)."""
    schema = "bucket long, block long, totals binary, digest long, top array<long>, top_counts array<long>, tokens array<long>, types array<long>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grams_ = pdf["bucket"].iloc[0] < 0
        words = [wide(w) if grams_ else np.frombuffer(w, _U) for w in pdf["words"]]
        every, order, new = in_order(np.concatenate(words), bits if grams_ else 64)
        count = np.add.reduceat(np.concatenate([unpack(c) for c in pdf["counts"]])[order], np.flatnonzero(new), dtype=np.int64)
        whole = spread(count.astype(np.uint32), order, new)
        rows, start = [], 0
        for w, block, check in zip(words, pdf["block"], pdf["digest"], strict=True):
            rows.append((block, pack(whole[start : start + len(w)]), check, None, None, None, None))
            start += len(w)
        if not grams_:
            top = most_frequent(every, count)
            top = top[count[top] > 0]
            tail = (every & _LOW).astype(np.int64)
            rows.append((-1, None, 0, every[top].view(np.int64), count[top], np.bincount(tail, count, TAILS).astype(np.int64), np.bincount(tail, count > 0, TAILS).astype(np.int64)))
        out = pd.DataFrame(rows, columns=["block", "totals", "digest", "top", "top_counts", "tokens", "types"])
        out.insert(0, "bucket", pdf["bucket"].iloc[0])
        return out

    return parts.groupBy("bucket").applyInPandas(frees_group(run), schema)


class Vocabulary(NamedTuple):
    """The head words (hashes, ascending, and each one's number by frequency), class counts and tail sizes."""

    hashes: np.ndarray
    numbers: np.ndarray
    head_counts: np.ndarray  # by number
    tail_tokens: np.ndarray
    tail_types: np.ndarray
    tokens: int
    types: int

    def look_up(self, words: np.ndarray) -> np.ndarray:
        """Head number of each word, or HEAD + its hash below TAIL_ROWS, whose lowest bits are its tail class."""
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        hashed = (words >> _U(40) << _U(TAILS.bit_length() - 1) & _U(TAIL_ROWS - 1)) | words & _LOW
        return np.where(self.hashes[at] == words, self.numbers[at], HEAD + hashed.astype(np.int64))


#: Groups, at least, in which the buckets' most frequent words are merged before the driver sees them.
_MERGES = 16


def most_frequent(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of the HEAD most frequent words (ties: smaller hashes), and of END if it is there."""
    order = np.lexsort((words, -counts))
    return order[: HEAD + 1] if END in words[order[:HEAD]] else np.append(order[:HEAD], np.flatnonzero(words == END))


def vocabulary(counted: DataFrame, buckets: int) -> Vocabulary:
    """Lists of HEAD words, as many as the square root of the number of buckets, come to the driver, and the sums of the tail classes."""
    merges = max(_MERGES, int(buckets**0.5))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        words, counts = np.concatenate(pdf["top"].to_list()).view(_U), np.concatenate(pdf["top_counts"].to_list())
        at = most_frequent(words, counts)
        return pd.DataFrame({"top": [words[at].view(np.int64)], "top_counts": [counts[at]], "tokens": [np.sum(pdf["tokens"].to_list(), axis=0)], "types": [np.sum(pdf["types"].to_list(), axis=0)]})

    merged = counted.where("block = -1").groupBy(F.pmod("bucket", F.lit(merges)).alias("merge")).applyInPandas(merge, "top array<long>, top_counts array<long>, tokens array<long>, types array<long>").collect()
    words = np.concatenate([np.array(r.top, np.int64) for r in merged] or [np.zeros(0, np.int64)]).view(_U)
    count = np.concatenate([np.array(r.top_counts, np.int64) for r in merged] or [np.zeros(0, np.int64)])
    if END not in words:  # nothing is learned from, or END is rare
        words, count = np.append(words, END), np.append(count, 0)
    end = words == END
    at = most_frequent(words[~end], count[~end])[: HEAD - 1]
    hashes, counts = np.append(words[~end][at], END), np.append(count[~end][at], count[end])
    order = np.lexsort((hashes, -counts))
    hashes, counts = hashes[order], np.pad(counts[order].astype(float), (0, HEAD - len(order)))
    tokens, types = (np.sum([r[k] for r in merged], axis=0, dtype=float) if merged else np.zeros(TAILS) for k in ("tokens", "types"))
    whole, kinds = int(tokens.sum()), int(types.sum())
    own, held = (hashes & _LOW).astype(np.int64), counts[: len(hashes)]
    tokens, types = tokens - np.bincount(own, held, TAILS), types - np.bincount(own, held > 0, TAILS)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], order, counts, tokens, types, whole, kinds)


class Model:
    """Weights of both factors, with the counts' logarithms as biases to begin with."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        by_class = np.concatenate([vocab.head_counts.reshape(HEAD_CLASSES, WIDTH).sum(1), vocab.tail_tokens])
        self.cls = np.zeros((2 * FEATURES + PAIR_ROWS + 1, CLASSES), np.float32)
        self.cls[-1] = np.log((by_class + 1) / (by_class + 1).sum())
        self.word = np.zeros((2 * WORD_ROWS + HEAD_CLASSES, WIDTH), np.float32)
        held = np.arange(HEAD).reshape(HEAD_CLASSES, WIDTH) < len(vocab.hashes)
        prior = np.where(held, np.log(vocab.head_counts.reshape(HEAD_CLASSES, WIDTH) + 0.5), -1e4)
        self.word[2 * WORD_ROWS :] = np.maximum(prior - np.log(np.exp(prior).sum(1, keepdims=True) + 1e-30), -1e4)
        self.tail_log = np.log(vocab.tail_tokens + vocab.tail_types + 1)

    def context(self, numbers: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands one and two places before each token."""
        return before(numbers, begins, FEATURES - 1, FEATURES - 1)

    def coarse(self, numbers: np.ndarray) -> np.ndarray:
        """Context words by head number or tail class."""
        return COARSE_OF.take(numbers)

    def class_rows(self, one, two):
        pair = mix((self.coarse(one) * COARSE + self.coarse(two)).astype(_U)) % _U(PAIR_ROWS)
        return one, two + FEATURES, pair.astype(np.int64) + 2 * FEATURES

    def target(self, numbers: np.ndarray) -> np.ndarray:
        """The class of each word."""
        return CLASS_OF.take(numbers)

    def word_rows(self, cls, one, two):
        a = mix((cls * COARSE + self.coarse(one)).astype(_U) + _U(1 << 40)) % _U(WORD_ROWS)
        b = mix((cls * COARSE + self.coarse(two)).astype(_U) + _U(1 << 41)) % _U(WORD_ROWS)
        return a.astype(np.int64), b.astype(np.int64) + WORD_ROWS

    def factors(self, numbers, one, two):
        """Of a batch: the classes, the rows of their features, and both factors before their normalisation as (logits, exponentials, sums); and which tokens are head words."""
        target, rows = self.target(numbers), self.class_rows(one, two)
        c = _exponential(self.cls, *rows, np.array([len(self.cls) - 1]))
        head = np.flatnonzero(numbers < HEAD)
        own = target[head]
        in_class = self.word_rows(own, one[head], two[head])
        w = _exponential(self.word, *in_class, own + 2 * WORD_ROWS)
        return target, rows, c, head, in_class, w

    def log10(self, numbers: np.ndarray, counts: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Log10 probability of each token. counts: their corpus counts, used for tail words."""
        one, two = self.context(numbers, begins)
        out = np.empty(len(numbers))
        for a in range(0, len(numbers), BATCH):
            x = numbers[a : a + BATCH]
            target, _, (c, _, total), head, _, (w, _, of_words) = self.factors(x, one[a : a + BATCH], two[a : a + BATCH])
            got = c[np.arange(len(x)), target] - np.log(total, dtype=float)
            got[head] += w[np.arange(len(head)), x[head] % WIDTH] - np.log(of_words, dtype=float)
            rest = x >= HEAD
            got[rest] += np.log(counts[a : a + BATCH][rest] + 1.0) - self.tail_log[target[rest] - HEAD_CLASSES]
            out[a : a + BATCH] = got
        return out / LN10

    def trainer(self) -> Trainer:
        return Trainer(self)


def _exponential(weights: np.ndarray, *rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of the weights in the rows, within MOST_LOGIT; its exponentials; their sums."""
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    np.clip(z, -MOST_LOGIT, MOST_LOGIT, out=z)
    e = np.exp(z)
    return z, e, np.einsum("ij->i", e)


class Trainer:
    """AdaGrad with a step size for each row, in mini-batches; counts how often rows are updated. START keeps the steps of rare rows small."""

    def __init__(self, model: Model):
        self.model = model
        self.sums = [np.full(len(x), START, np.float32) for x in (model.cls, model.word)]
        self.uses = [np.zeros(len(x), np.float32) for x in (model.cls, model.word)]

    def fit(self, numbers: np.ndarray, begins: np.ndarray) -> None:
        one, two = self.model.context(numbers, begins)
        for a in range(0, len(numbers), BATCH):
            x = numbers[a : a + BATCH]
            target, rows, (_, g, total), head, in_class, (_, h, of_words) = self.model.factors(x, one[a : a + BATCH], two[a : a + BATCH])
            g /= total[:, None]
            g[np.arange(len(x)), target] -= 1
            for r in rows:
                self._step(0, r, g)
            if len(head):
                h /= of_words[:, None]
                h[np.arange(len(head)), x[head] % WIDTH] -= 1
                for r in in_class:
                    self._step(1, r, h)

    def _step(self, layer: int, rows: np.ndarray, gradient: np.ndarray) -> None:
        at, n, g = gathered(rows, gradient)
        weights, sums = (self.model.cls, self.model.word)[layer], self.sums[layer]
        squares = sums[at] + np.einsum("ij,ij->i", g, g) / g.shape[1]
        sums[at] = squares
        g *= (RATE / np.sqrt(squares))[:, None]
        weights[at] -= g
        self.uses[layer][at] += n


#: So many of a row's gradients are added up together with those of other rows, the rest by row.
_TOGETHER = 16


def gathered(rows: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a mini-batch (rows below 2^16): the distinct rows, the most frequent first, how often each occurs, and the sum of its gradients."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    n = np.diff(np.append(first, len(rows)))
    by = np.argsort((len(rows) - n).astype(np.uint16), kind="stable")
    first, n = first[by], n[by]
    g = gradient.take(order[first], axis=0)
    longer = len(n) - np.searchsorted(n[::-1], np.arange(1, _TOGETHER + 1), "right")  # rows that occur more than once, twice and so on
    for k, m in enumerate(longer[:-1], 1):
        if not m:
            break
        g[:m] += gradient.take(order[first[:m] + k], axis=0)
    for i in range(longer[-1]):
        g[i] += np.add.reduce(gradient.take(order[first[i] + _TOGETHER : first[i] + n[i]], axis=0), axis=0)
    return ordered[first], n, g


#: Ranges of rows that are averaged apart, and partitions whose weights meet first.
_PIECES, _FAN = 32, 512


def train(blocks: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Model:
    """A round's weights come to the driver; they have a fixed size."""
    model = Model(vocab)
    schema = "piece long, at binary, w binary, uses binary"
    for k in range(rounds):

        def run(batches, model=model, k=k):
            trainer = model.trainer()
            for _, t, ids in rows_of(batches):
                now = np.repeat(mix(ids.astype(_U) + _U(17)) % _U(rounds) == _U(k), np.diff(t.begins)) & t.learned
                begins = np.concatenate([[0], np.cumsum(now)])[t.begins]
                trainer.fit(vocab.look_up(t.words)[t.stream[now]], np.unique(begins))  # texts of other rounds are empty here
            rows, fan = [], TaskContext.get().partitionId() // _FAN
            for layer, (w, uses) in enumerate(zip((trainer.model.cls, trainer.model.word), trainer.uses, strict=True)):
                for p, at in enumerate(np.array_split(np.arange(len(w)), _PIECES)):
                    used = at[uses[at] > 0]
                    if len(used):
                        rows.append((fan, layer * _PIECES + p, used.astype("<i4").tobytes(), w[used].astype("<f2").tobytes(), uses[used].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["fan", "piece", "at", "w", "uses"])

        def average(pdf: pd.DataFrame) -> pd.DataFrame:
            piece = int(pdf["piece"].iloc[0])
            shape = (model.cls, model.word)[piece // _PIECES].shape
            total, uses = np.zeros(shape, np.float32), np.zeros(shape[0], np.float32)
            for a, w, u in zip(pdf["at"], pdf["w"], pdf["uses"], strict=True):
                a, u = np.frombuffer(a, "<i4"), np.frombuffer(u, np.float32)
                kind = "<f2" if len(w) == 2 * len(a) * shape[1] else "<f4"
                total[a] += np.frombuffer(w, kind).reshape(-1, shape[1]).astype(np.float32) * u[:, None]
                uses[a] += u
            at = np.flatnonzero(uses)
            return pd.DataFrame({"piece": [piece], "at": [at.astype("<i4").tobytes()], "w": [(total[at] / uses[at, None]).astype("<f4").tobytes()], "uses": [uses[at].tobytes()]})

        of_fans = blocks.select(*_COLUMNS).mapInArrow(frees(run), f"fan long, {schema}").groupBy("fan", "piece").applyInPandas(average, schema)
        for row in of_fans.groupBy("piece").applyInPandas(average, schema).collect():
            weights = (model.cls, model.word)[row.piece // _PIECES]
            at = np.frombuffer(row.at, "<i4")
            weights[at] = np.frombuffer(row.w, "<f4").reshape(len(at), -1)
    return model


def bins(contexts: np.ndarray) -> np.ndarray:
    """0 for none, then one for each doubling."""
    return np.minimum(np.frexp(contexts.astype(float))[1], BINS - 1)


def mixed(p: np.ndarray, counts: np.ndarray, contexts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probabilities p drawn towards the shares of the n-grams in their contexts."""
    for count, context, weight in zip(counts, contexts, weights, strict=True):
        w = weight[bins(context)]
        p = (1 - w) * p + w * count / np.maximum(context, 1)
    return p


def solved(tally: np.ndarray) -> np.ndarray:
    """A weight for each bin by EM, from the tokens of each bin and cell."""
    n, w = tally.sum(1), np.full(BINS, 0.5)
    w[0] = 0
    for _ in range(40):
        own = w[:, None] * RATIOS
        w = (tally * (own / (own + (1 - w)[:, None]))).sum(1) / (n + 5)
    out, seen = np.zeros(BINS), np.flatnonzero(n[1:]) + 1
    if len(seen):  # a count that did not occur has the weight of the next smaller one that did
        out[1:] = w[seen[np.maximum(np.searchsorted(seen, np.arange(1, BINS), "right") - 1, 0)]]
    return out


def tallies(p: np.ndarray, counts: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Of tokens with probability p, for each n-gram how many are in each bin and cell: all that EM needs to know of them.

    What an n-gram is mixed into is p with the n-grams before it, by the weights that these tokens alone would give them.
    """
    out = np.zeros((len(counts), BINS, CELLS), np.int64)
    for k in range(len(counts)):
        share = counts[k] / np.maximum(contexts[k], 1)
        cell = np.zeros(len(share), np.int64)
        at = np.flatnonzero(share)
        cell[at] = 1 + np.clip(np.floor(STEPS * (np.log2(share[at] / p[at]) + REACH)), 0, CELLS - 2).astype(np.int64)
        out[k] = np.bincount(bins(contexts[k]) * CELLS + cell, minlength=BINS * CELLS).reshape(BINS, CELLS)
        p = mixed(p, counts[k : k + 1], contexts[k : k + 1], solved(out[k])[None])
    return out


def settled(tally: np.ndarray) -> np.ndarray:
    """The weights of mixed()."""
    return np.stack([solved(t) for t in tally])


def counts_of(parts: pd.DataFrame, words: np.ndarray, stream: np.ndarray, begins: np.ndarray, vocab: Vocabulary, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block, from its totals: each distinct word's count; and for each token the counts of its three n-grams and of their contexts."""
    of_words, of_grams = parts[parts["bucket"] >= 0].sort_values("bucket"), parts[parts["bucket"] < 0].sort_values("bucket", ascending=False)
    totals_, more = (np.concatenate([unpack(x) for x in rows["totals"]]) for rows in (of_words, of_grams))
    order = np.argsort(words)
    every, places, new = in_order(grams(words[stream], begins, words, bits), bits)
    if len(order) != len(totals_) or len(every) != len(more) or any(digest(keys) != int(rows["digest"].to_numpy(np.int64).sum()) for keys, rows in ((words, of_words), (every, of_grams))):
        raise RuntimeError("a block and its totals differ")
    count = np.empty(len(words), np.int64)
    count[order] = totals_
    found, n = spread(more, places, new).astype(np.int64), len(stream)
    counts, ends = found[: 3 * n].reshape(3, n), found[3 * n :]
    texts = vocab.head_counts[vocab.look_up(np.array([END]))[0]]
    one, two = before(stream.astype(np.int64), begins, len(words), len(words))
    known = np.append(count, int(texts))
    pair = np.append(0, counts[1, :-1])
    contexts = np.stack([(known - ends)[two], known[one], pair])  # END has no word after it
    contexts[0, begins[:-1]] = contexts[2, begins[:-1]] = 0
    return count, counts, contexts


def left_out(counts: np.ndarray, contexts: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts without the token itself, if it was learned from: else a training text would be known by heart."""
    return np.maximum(counts - learned, 0), np.maximum(contexts - learned, 0)


def weights_of(counted: DataFrame, blocks: DataFrame, model: Model, bits: int) -> np.ndarray:
    """The weights, fitted to every training token. Blocks send tallies of a fixed size, which are added up in FIT_FANS groups."""
    vocab = model.vocab

    def run(parts: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples(index=False):
            t = Tokens(row.words, row.stream, row.sizes, row.train)
            at = np.flatnonzero(t.learned)
            if len(at):
                count, counts, contexts = counts_of(parts, t.words, t.stream, t.begins, vocab, bits)
                counts, contexts = left_out(counts, contexts, t.learned)
                p = 10 ** model.log10(vocab.look_up(t.words)[t.stream], count[t.stream], t.begins)[at]
                out.append((row.block % FIT_FANS, zstandard.ZstdCompressor(level=1).compress(tallies(p, counts[:, at], contexts[:, at]).tobytes())))
        return pd.DataFrame(out, columns=["fan", "tally"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((3, BINS, CELLS), np.int64)
        for tally in pdf["tally"]:
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(tally), np.int64).reshape(total.shape)
        return pd.DataFrame({"tally": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]})

    each = counted.groupBy("block").cogroup(blocks.select(*_COLUMNS).groupBy("block")).applyInPandas(frees_groups(run), "fan long, tally binary")
    total = np.zeros((3, BINS, CELLS), np.int64)
    for row in each.groupBy("fan").applyInPandas(frees_group(add), "tally binary").collect():
        total += np.frombuffer(zstandard.ZstdDecompressor().decompress(row.tally), np.int64).reshape(total.shape)
    return settled(total)


def scored(counted: DataFrame, blocks: DataFrame, model: Model, weights: np.ndarray, bits: int) -> DataFrame:
    vocab = model.vocab
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(parts: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples(index=False):
            t = Tokens(row.words, row.stream, row.sizes, row.train)
            count, counts, contexts = counts_of(parts, t.words, t.stream, t.begins, vocab, bits)
            counts, contexts = left_out(counts, contexts, t.learned)
            base = np.log10((count + 1) / (vocab.tokens + vocab.types + 1))
            tokens = np.log10(mixed(10 ** model.log10(vocab.look_up(t.words)[t.stream], count[t.stream], t.begins), counts, contexts, weights))
            sums = [np.add.reduceat(x[t.stream], t.begins[:-1]) for x in (base, (count > 0).astype(np.int64))]
            out.append(pd.DataFrame(dict(zip(names, (nullable(unpack_ids(row.doc_ids)), ~np.asarray(row.train, bool), row.sizes, sums[1], vocab.tokens, sums[0], np.add.reduceat(tokens, t.begins[:-1])), strict=True))))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in names})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return counted.groupBy("block").cogroup(blocks.select(*_COLUMNS).groupBy("block")).applyInPandas(frees_groups(run), schema)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose id's crc32 (of the id as text) leaves remainder HELD_OUT_IS by HELD_OUT_OF are held out;
    a null id is. Null text counts as empty: it is the end alone. base_score is the add-one unigram's
    log10 probability, score the model's. Repeated rows count each; if no text is learned from, no token
    is known, train_tokens is 0 and base_score 0; an empty table gives an empty result; other columns are
    not read. docs is read once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(HELD_OUT_OF)) == HELD_OUT_IS, F.lit(True))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~held).alias("train"), text_or_empty(text_col).cast("binary").alias("text"))
    with shuffles_freed(spark):  # counting, training and fitting shuffle more than there is room for at once
        blocks = written(blocks_of(source), "blocks")
        n_bytes = blocks.agg(F.sum("bytes")).first()[0] or 0
        bits, (lead, gram_lead) = gram_bits(n_bytes), ((ranges(spark, n_bytes, each, 2) - 1).bit_length() for each in (WORD_BYTES, GRAM_BYTES))
        counted = written(totals(block_counts(blocks, lead, gram_lead, bits), bits), "totals")
        model = train(blocks, vocabulary(counted, 1 << lead))
        parts = counted.where("block >= 0").select("bucket", "block", "totals", "digest")
        weights = weights_of(parts, blocks, model, bits)
    return scored(parts, blocks, model, weights, bits)
