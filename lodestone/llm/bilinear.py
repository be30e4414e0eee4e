"""Language-model scores: a log-bilinear neural model trained by noise-contrastive estimation.

The model predicts a word in two steps from the embeddings of the three before it: its class, then the
word among the class's members. The most frequent words are classes of their own; up to 16,384 more,
found by their counts over the corpus, are members of classes by their endings; every other word is in
the tail class of its last two bytes, where it has its smoothed share of the class's count. All words of
a tail class that training never saw share one further slot ("one unknown word"), so the probabilities
over known words, the unknown word of each tail class, and the end sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.session import checkpointed, id_remainder, parts_for, text_chars
from lodestone.llm.textcore import LOWER, Words, batches, column_bytes, group_sums, released

#: Classes: 0 the end, then tail classes, frequent words one each, and groups of up to MEMBERS words.
ENDINGS, SINGLES, GROUPS, MEMBERS = 64, 63, 128, 128
CLASSES = 1 + ENDINGS + SINGLES + GROUPS
#: A word enters the vocabulary if training has it this often, and it is among the most frequent ones.
LEAST_COUNT, MOST_WORDS = 20, SINGLES + GROUPS * MEMBERS
WIDTH, CONTEXT, NOISE, WORD_NOISE, BATCH = 16, 3, 32, 3, 4096
#: Tokens scored at once: over all classes, so that their scores stay in the processor's cache, and by groups.
ROWS, WINDOW = 1024, 32_768
CHUNK_CHARS, BUCKET_CHARS = 4_000_000, 4_000_000
#: Parameters in one row that tasks send, and how many tasks' rows are summed at once.
BLOCK, FAN = 1 << 16, 64
SMOOTHING = 0.1


def word_keys(words: Words) -> np.ndarray:
    """A 64-bit key of each word: 58 bits of its hash and, in the lowest six, the class of its last two bytes."""
    last = words.raw[words.ends - 1].astype(np.uint64)
    before = np.where(words.ends - words.starts > 1, words.raw[words.ends - 2], 0).astype(np.uint64)
    ending = (last * np.uint64(0x9E3779B1) + before * np.uint64(0x85EBCA77)) >> np.uint64(9) & np.uint64(ENDINGS - 1)
    return words.hashes() & ~np.uint64(ENDINGS - 1) | ending


def lowered(column: pa.ChunkedArray | pa.Array) -> Words:
    raw, docs = column_bytes(column)
    return Words(LOWER[raw], docs)


def _distinct(table: pa.Table) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's words, its distinct keys in order, each word's place among them, and whether its document is held out."""
    words = lowered(table["text"])
    keys, place = np.unique(word_keys(words), return_inverse=True)
    held = np.repeat(table["held_out"].to_numpy(zero_copy_only=False).astype(bool), words.counts())
    return words, keys, place, held


def _sent(n_buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, keys, place, held = _distinct(table)
        counts = np.bincount(place[~held], minlength=len(keys)).astype("<u4")
        bucket = ((keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int32)
        some, low = np.unique(bucket, return_index=True)
        cuts = np.append(low, len(keys)).tolist()
        parts = list(zip(cuts, cuts[1:], strict=False))
        return pa.table(
            {
                "bucket": pa.array(some, pa.int32()),
                "chunk": pa.array(np.full(len(some), key[0].as_py(), np.int64)),
                "keys": pa.array([keys[a:b].tobytes() for a, b in parts], pa.binary()),
                "counts": pa.array([counts[a:b].tobytes() for a, b in parts], pa.binary()),
            }
        )

    return run


def narrow(x: np.ndarray) -> bytes:
    """Counts in as many bytes as the largest needs (4 or 8), which is the first byte."""
    size = 8 if len(x) and x.max() >= 2**32 else 4
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def widened(x: bytes) -> np.ndarray:
    return np.frombuffer(x[1:], f"<u{x[0]}").astype(np.int64)


_SUMMED = "chunk long, bucket int, totals binary, n binary, v binary, words binary, counts binary"


def _summed(key: tuple, rows: pa.Table) -> pa.Table:
    """A bucket's answer to each chunk: its words' counts over the corpus. Also one row of sums by ending, and of the words frequent enough for the vocabulary."""
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["keys"]]
    counts = [np.frombuffer(x.as_buffer(), "<u4") for x in rows["counts"]]
    known, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(place, np.concatenate(counts), len(known)).astype("<i8")
    told = np.split(totals[place], np.cumsum([len(k) for k in keys])[:-1])
    ending = (known & np.uint64(ENDINGS - 1)).astype(np.int64)
    n, v = np.bincount(ending, totals, ENDINGS).astype("<i8"), np.bincount(ending, totals > 0, ENDINGS).astype("<i8")
    often = totals >= LEAST_COUNT
    a = len(keys)
    one = lambda x: pa.array([None] * a + [x.tobytes()], pa.binary())
    return pa.table(
        {
            "chunk": pa.chunked_array([rows["chunk"].combine_chunks(), pa.nulls(1, pa.int64())]),
            "bucket": pa.array([key[0].as_py()] * (a + 1), pa.int32()),
            "totals": pa.array([*(narrow(x) for x in told), None], pa.binary()),
            "n": one(n), "v": one(v), "words": one(known[often]), "counts": one(totals[often]),
        }
    )


def _frequent(least: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for words, counts in zip(batch.column("words"), batch.column("counts"), strict=True):
                w, n = np.frombuffer(words.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w[n >= least]), pa.array(n[n >= least])], names=["word", "n"])

    return run


def _endings(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for n, v in zip(batch.column("n"), batch.column("v"), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDINGS)), pa.array(np.frombuffer(n.as_buffer(), np.int64)), pa.array(np.frombuffer(v.as_buffer(), np.int64))], names=["ending", "n", "v"])


@dataclass
class Vocabulary:
    """Words by key in order with their ids; each id's class and place in it; classes' training counts, tails' numbers of words.

    Ids: 0 the end, 1 to ENDINGS the tails, then single words, then groups of words one after the other.
    """

    keys: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray
    word_counts: np.ndarray

    @classmethod
    def build(cls, words: np.ndarray, numbers: np.ndarray, ends: int, n: np.ndarray, v: np.ndarray) -> Vocabulary:
        """From the frequent words, most frequent first, and each ending's count and number of words."""
        ending = (words & np.uint64(ENDINGS - 1)).astype(np.int64)
        n = n - np.bincount(ending, numbers, ENDINGS).astype(np.int64)
        v = v - np.bincount(ending, minlength=ENDINGS)
        rest = SINGLES + np.argsort(ending[SINGLES:], kind="stable")
        order = np.concatenate([np.arange(min(SINGLES, len(words))), rest]).astype(np.int64)
        ids = np.empty(len(words), np.int64)
        ids[order] = 1 + ENDINGS + np.arange(len(words))
        word_counts = np.zeros(1 + ENDINGS + MOST_WORDS, np.int64)
        word_counts[ids] = numbers
        counts = np.zeros(CLASSES, np.int64)
        counts[0], counts[1 : 1 + ENDINGS] = ends, n
        np.add.at(counts, cls.class_of(ids), numbers)
        at = np.argsort(words)
        return cls(words[at], ids[at], counts, v, word_counts)

    @staticmethod
    def class_of(ids: np.ndarray) -> np.ndarray:
        first = 1 + ENDINGS + SINGLES
        return np.where(ids < first, ids, first + (ids - first) // MEMBERS)

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = (1 + (keys & np.uint64(ENDINGS - 1))).astype(np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[hit] = self.ids[at[hit]]
        return out

    def shares(self) -> np.ndarray:
        """The classes' smoothed shares of training; none for a group without words."""
        out = self.counts + 1.0
        out[1 + ENDINGS + SINGLES :][self.group_sizes() == 0] = 0
        out[1 + ENDINGS + min(SINGLES, len(self.keys)) : 1 + ENDINGS + SINGLES] = 0
        return out / out.sum()

    def group_sizes(self) -> np.ndarray:
        """How many words each group has."""
        n = max(0, len(self.keys) - SINGLES)
        return np.clip(n - MEMBERS * np.arange(GROUPS), 0, MEMBERS)


def streams(vocabulary: Vocabulary, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all tokens, an end after each document; the place of each word among them; the contexts."""
    n_docs = len(counts)
    bounds = np.append(0, np.cumsum(counts + 1))
    at = np.arange(len(keys)) + np.repeat(np.arange(n_docs), counts)
    tokens = np.zeros(int(bounds[-1]), np.int64)
    tokens[at] = vocabulary.of(keys)
    into = np.arange(len(tokens)) - np.repeat(bounds[:-1], counts + 1)
    contexts = np.zeros((CONTEXT, len(tokens)), np.int64)
    for j in range(CONTEXT):
        contexts[j, j + 1 :] = tokens[: -j - 1] if j + 1 <= len(tokens) else []
        contexts[j, into <= j] = 0
    return tokens, at, contexts


def summed_rows(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices (below 65,536) and the sums of their rows, through a sort of the indices."""
    order = np.argsort(index.astype(np.uint16), kind="stable")
    ordered = index[order]
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[heads], np.add.reduceat(rows[order], heads, axis=0)


class LogBilinear:
    """h = sum_j scale[j] * context[c_j]; a class's score is target . h + bias, a group member's word . h + word_bias."""

    SHAPES = (
        ("context", (1 + ENDINGS + MOST_WORDS, WIDTH)), ("target", (CLASSES, WIDTH)), ("scale", (CONTEXT, WIDTH)), ("bias", (CLASSES,)), ("word", (GROUPS * MEMBERS, WIDTH)), ("word_bias", (GROUPS * MEMBERS,)),
    )

    def __init__(self, flat: np.ndarray):
        self.flat, k = flat.astype(np.float32), 0
        self.parts = {}
        for name, shape in self.SHAPES:
            size = int(np.prod(shape))
            self.parts[name] = self.flat[k : k + size].reshape(shape)
            k += size

    @classmethod
    def new(cls, vocabulary: Vocabulary, shares: np.ndarray) -> LogBilinear:
        rng = np.random.default_rng(11)
        model = cls(np.concatenate([rng.normal(0, 0.1, int(np.prod(shape))) for _, shape in cls.SHAPES]))
        p = model.parts
        p["scale"][:], p["word"][:] = 1.0, 0.0
        p["bias"][:] = np.log(np.maximum(shares, 1e-30))
        # A word begins with its class's embedding, and with its share of the class.
        first = 1 + ENDINGS + SINGLES
        p["context"][first:] = p["context"][first:] * 0.1 + np.repeat(rng.normal(0, 0.1, (GROUPS, WIDTH)), MEMBERS, axis=0)
        grouped = vocabulary.word_counts[first:].reshape(GROUPS, MEMBERS) + 0.0
        p["word_bias"][:] = np.log((grouped + 1e-30) / np.maximum(grouped.sum(axis=1, keepdims=True), 1)).ravel()
        return model

    def hidden(self, contexts: np.ndarray) -> np.ndarray:
        return sum(self.parts["context"][contexts[j]] * self.parts["scale"][j] for j in range(CONTEXT))

    def train(self, tokens: np.ndarray, contexts: np.ndarray, shares: np.ndarray, sizes: np.ndarray, rate: float, seed: int, state: LogBilinear) -> None:
        """One pass of noise-contrastive estimation in batches, each with its own noise classes and words; steps by Adagrad."""
        rng = np.random.default_rng(seed)
        offset = np.log(NOISE * np.maximum(shares, 1e-30)).astype(np.float32)
        cumulative = np.cumsum(shares)
        p, s = self.parts, state.parts
        first = 1 + ENDINGS + SINGLES
        word_offset = np.log(WORD_NOISE / np.maximum(sizes, 1)).astype(np.float32)

        def step(name: str, grad: np.ndarray, at: np.ndarray | slice = slice(None)) -> None:
            grad = grad / n
            s[name][at] += grad * grad
            p[name][at] -= rate * grad / (np.sqrt(s[name][at]) + 1e-6)

        for i in range(0, len(tokens), BATCH):
            ids, c = tokens[i : i + BATCH], contexts[:, i : i + BATCH]
            w, n = Vocabulary.class_of(ids), len(ids)
            noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), CLASSES - 1)
            q, b = p["target"], p["bias"]
            h = self.hidden(c)
            real = np.einsum("ij,ij->i", h, q[w]) + b[w] - offset[w]
            fake = h @ q[noise].T + (b[noise] - offset[noise])
            dr = -1 / (1 + np.exp(np.clip(real, -30, 30)))
            df = 1 / (1 + np.exp(-np.clip(fake, -30, 30)))
            dh = df @ q[noise] + dr[:, None] * q[w]
            at, sums = summed_rows(np.concatenate([w, noise]), np.concatenate([dr[:, None] * h, df.T @ h]))
            biases = np.bincount(w, dr, CLASSES) + np.bincount(noise, df.sum(axis=0), CLASSES)

            inside = np.flatnonzero(ids >= first)
            if len(inside):
                own = ids[inside] - first
                group = own // MEMBERS
                size = sizes[group]
                other = group[:, None] * MEMBERS + (rng.random((len(own), WORD_NOISE)) * size[:, None]).astype(np.int64)
                both = np.concatenate([own[:, None], other], axis=1)
                hi = h[inside]
                scores = np.einsum("nkd,nd->nk", p["word"][both], hi) + p["word_bias"][both] - word_offset[group][:, None]
                d = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
                d[:, 0] -= 1
                dh[inside] += np.einsum("nk,nkd->nd", d, p["word"][both])
                flat = both.ravel()
                where, word_sums = summed_rows(flat, np.concatenate([d[:, :, None] * hi[:, None, :], d[:, :, None]], axis=2).reshape(-1, WIDTH + 1))
                step("word", word_sums[:, :WIDTH], where)
                step("word_bias", word_sums[:, WIDTH], where)

            scale_grad = np.stack([(dh * p["context"][c[j]]).sum(axis=0) for j in range(CONTEXT)])
            where, context_sums = summed_rows(c.ravel(), (dh[None] * p["scale"][:, None]).reshape(-1, WIDTH))
            step("target", sums, at)
            step("bias", biases)
            step("context", context_sums, where)
            step("scale", scale_grad)

    def log10(self, tokens: np.ndarray, contexts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities, a batch of matrix products at a time: of the class, and of a group's member in its group."""
        out = np.empty(len(tokens))
        q, b = self.parts["target"], self.parts["bias"]
        first = 1 + ENDINGS + SINGLES
        for i in range(0, len(tokens), WINDOW):
            ids, rows = tokens[i : i + WINDOW], slice(i, i + WINDOW)
            h = self.hidden(contexts[:, rows])
            for k in range(0, len(ids), ROWS):
                s = h[k : k + ROWS] @ q.T
                s += b
                w = Vocabulary.class_of(ids[k : k + ROWS])
                out[i + k : i + k + len(w)] = _log_share(s, w)
            inside = np.flatnonzero(ids >= first)
            group = (ids[inside] - first) // MEMBERS
            order = np.argsort(group.astype(np.uint8), kind="stable")
            cuts = np.searchsorted(group[order], np.arange(GROUPS + 1)).tolist()
            for g in np.unique(group).tolist():
                mine = inside[order[cuts[g] : cuts[g + 1]]]
                members = slice(g * MEMBERS, g * MEMBERS + int(sizes[g]))
                s = h[mine] @ self.parts["word"][members].T
                s += self.parts["word_bias"][members]
                out[i + mine] += _log_share(s, ids[mine] - first - g * MEMBERS)
        return out / np.log(10)


def _log_share(scores: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The log of each row's chosen share of the exponentials; ``scores`` are overwritten."""
    own = scores[np.arange(len(chosen)), chosen].astype(np.float64)
    top = scores.max(axis=1)
    scores -= top[:, None]
    np.exp(scores, out=scores)
    return own - top - np.log(scores.sum(axis=1, dtype=np.float64))


_BLOCKS = "block long, task long, weight double, part binary"


def _trained(vocabulary: Vocabulary, shares: np.ndarray, flat: np.ndarray, rate: float, seed: int):
    sizes = vocabulary.group_sizes()

    @released
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A pass over this task's texts, from the common start; what the parameters have become, and the tokens seen."""
        model, state, seen = LogBilinear(flat.copy()), LogBilinear(np.full(len(flat), 1e-4, np.float32)), 0
        for batch in batches(stream, "text"):
            words = lowered(batch.column("text"))
            tokens, _, contexts = streams(vocabulary, word_keys(words), words.counts())
            model.train(tokens, contexts, shares, sizes, rate, seed + seen % 1_000_003, state)
            seen += len(tokens)
        if seen:
            parts = [model.flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, TaskContext.get().partitionId())), pa.array(np.full(n, float(seen))), pa.array(parts, pa.binary())], names=["block", "task", "weight", "part"])

    return run


def _mean(key: tuple, rows: pa.Table) -> pa.Table:
    """The mean of at most FAN tasks' parameters in one block, by the tokens that each has seen."""
    rows = rows.sort_by("task")
    weight = rows["weight"].to_numpy()
    part = sum(w * np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for w, x in zip(weight, rows["part"], strict=True)) / weight.sum()
    return pa.table({"block": pa.array([key[0].as_py()]), "task": pa.array([key[1].as_py()]), "weight": pa.array([float(weight.sum())]), "part": pa.array([part.astype(np.float32).tobytes()], pa.binary())})


def averaged(trained: DataFrame) -> np.ndarray:
    """The tasks' parameters, averaged FAN at a time until one is left; a few MB come to the driver."""
    rows = checkpointed(trained)
    tasks = (rows.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        rows = rows.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("block", "task").applyInArrow(_mean, _BLOCKS)
        tasks = -(-tasks // FAN)
    return np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(rows.collect(), key=lambda r: r["block"])])


def _scored(vocabulary: Vocabulary, flat: np.ndarray, train_tokens: int, distinct: int, ends: int):
    model, sizes = LogBilinear(flat), vocabulary.group_sizes()

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), *((n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64()))})
        words, keys, place, _ = _distinct(table)
        parts = sorted(zip(answers["bucket"].to_pylist(), answers["totals"].to_pylist(), strict=True))
        totals = np.concatenate([widened(x) for _, x in parts] or [np.zeros(0, np.int64)])
        if len(totals) != len(keys):
            raise RuntimeError("a chunk's documents changed between two reads of the input")
        counts = words.counts()
        c = totals[place]
        scale = np.log10(train_tokens + SMOOTHING * (distinct + 1))
        logs = np.append(0, np.cumsum(np.log10(c + SMOOTHING)))[words.bounds]
        n_tokens = counts + 1
        base = np.diff(logs) + np.log10(ends + SMOOTHING) - n_tokens * scale
        tokens, at, contexts = streams(vocabulary, keys[place], counts)
        own = model.log10(tokens, contexts, sizes)
        many = (tokens[at] >= 1) & (tokens[at] <= ENDINGS)
        kinds = tokens[at][many]
        own[at[many]] += np.log10((c[many] + SMOOTHING) / (vocabulary.counts[kinds] + SMOOTHING * (vocabulary.sizes[kinds - 1] + 1)))
        bounds = np.append(0, np.cumsum(n_tokens))
        sums = np.append(0, np.cumsum(own))
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "held_out": table["held_out"],
                "n_tokens": pa.array(n_tokens),
                "n_known": pa.array(group_sums(c > 0, words.bounds) + (ends > 0)),
                "train_tokens": pa.array(np.full(len(counts), train_tokens)),
                "base_score": pa.array(base),
                "score": pa.array(sums[bounds[1:]] - sums[bounds[:-1]]),
            }
        )

    return run


def language_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", passes: int = 1, rate: float = 0.2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of whole texts.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, and one end. All is
    learned from documents whose crc32(id) modulo 10 is not 0 (held_out marks the others). base_score
    sums log10((c + 0.1) / (N + 0.1 * (V + 1))); n_known counts tokens with c > 0; score is the model's.

    Every word of every text is counted: chunks of documents send their distinct words once to the
    bucket of the word's hash and get back the words' counts. The words that occur LEAST_COUNT times or more
    in training, the most frequent MOST_WORDS of them at most, are the vocabulary. Training passes over all
    training texts; each task trains from the common parameters (about 560,000) and Spark averages what they
    become, weighted by tokens, so scores depend on how the input is split into tasks. Only these, the
    vocabulary and sums by ending come to the driver.

    Null and empty texts are the end alone. A null id counts as the empty text (held out). Rows that repeat an id
    or have none are learned and scored each, and dealt by their texts. Without training documents the model is
    uniform over classes. An empty table gives an empty result; other columns are not looked at.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), (id_remainder(id_column, 10) == 0).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    chars = text_chars(source)
    n_chunks, n_buckets = parts_for(chars, CHUNK_CHARS, 16), parts_for(chars, BUCKET_CHARS, 16)
    by_chunk = source.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks))).groupBy("chunk")
    sent = by_chunk.applyInArrow(_sent(n_buckets), "bucket int, chunk long, keys binary, counts binary")
    summed = checkpointed(sent.groupBy("bucket").applyInArrow(_summed, _SUMMED))
    ends = source.where("not held_out").count()
    totals = summed.where("chunk is null").select("n", "v").mapInArrow(_endings, "ending long, n long, v long").groupBy("ending").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in totals:
        n[r["ending"]], v[r["ending"]] = r["n"], r["v"]
    train_tokens, distinct = int(n.sum()) + ends, int(v.sum()) + (ends > 0)
    found = summed.where("chunk is null").select("words", "counts").mapInArrow(_frequent(LEAST_COUNT), "word long, n long")
    frequent = found.orderBy(F.desc("n"), "word").limit(MOST_WORDS).toArrow()
    words, numbers = frequent["word"].to_numpy().view(np.uint64), frequent["n"].to_numpy()
    order = np.lexsort((words.view(np.int64), -numbers))
    vocabulary = Vocabulary.build(words[order], numbers[order], ends, n, v)
    shares = vocabulary.shares()
    flat = LogBilinear.new(vocabulary, shares).flat
    for k in range(passes if train_tokens else 0):
        trained = source.where("not held_out").select("text").mapInArrow(_trained(vocabulary, shares, flat, rate / 2**k, 101 * k), _BLOCKS)
        flat = averaged(trained)
    answers = summed.where("chunk is not null").select("chunk", "bucket", "totals")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_scored(vocabulary, flat, train_tokens, distinct, ends), schema)
