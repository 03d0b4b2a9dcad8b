"""Language identification with a linear-chain conditional random field over words.

A word is what stands between white space; its letters in lower case count. Each word of a text has a label, and the text is one chain. A word's emission score is the sum of the weights of its features:
the lexicon entry of the whole word, affixes and character n-grams, hashed into a table. Learned transitions join
neighbours, so that a word is read in the light of its context and a switch of language has its price. Forward-backward gives each word's
marginals; a text's label is the one with most expected words, its score that share. The recursions go over whole texts in blocks of BLOCK words, which carry the forward sums on; only
the sums at the borders of blocks are kept, so a very long text needs little memory.

The model is fitted on a bounded sample: of each language the first SAMPLE different labelled texts in the order of a hash, all if they are fewer, whole, up to the one that fills SAMPLE_WORDS words, in pieces of CHAIN words.
A share of the pieces is spliced with pieces of other languages, so that transitions are learned on text that switches.
What decides is counted over all documents: the languages, all of which are learned that have a text with a letter, and how many different texts each has; copies of a text count once.
The model and its fitting grow with the number of languages, not with the documents.
All words of each text are labelled. Null texts and texts without a letter are `und` with score 0. Without any labelled row all texts are `und`.
Repeated rows are labelled alike; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.common import TEXT_ROWS_PER_BATCH, held

#: Texts of each language that the model is fitted on, at most, and words that they have together before the last one is taken.
SAMPLE = 300
SAMPLE_WORDS = 500_000
#: Words of a piece of training text, and the share of pieces that are spliced.
CHAIN = 64
SPLICED = 0.2
#: Words of each text in one block of the recursions, and words of a group of texts that go through them together.
BLOCK = 1024
GROUP_WORDS = 400_000
#: Words whose features are worked out together.
LEARN_WORDS = 10_000
TABLE_BITS = 16
EPOCHS = 3
WORD_CACHE = 200_000
UNKNOWN = "und"

_not_letters = re.compile(r"[\W\d_]+").sub


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # feature cells x languages
    transitions: np.ndarray
    start: np.ndarray


def letters(token: str) -> str:
    """What counts of a token: its letters, in lower case."""
    word = _not_letters("", token.lower())
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, cell) of every feature of every word: the word itself, affixes of up to 4, n-grams of 1 to 3 characters with borders."""
    text = "".join(f"<{w}>" for w in words)
    code = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(size)
    starts, owner = ends - size, np.repeat(np.arange(len(words)), size)
    left = ends[owner] - np.arange(len(code))  # characters from here to the word's end
    found = []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, 6):  # h at i: hash of the n characters from i
        h = h[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + (code[n - 1 :] + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        here = np.flatnonzero(left[: len(h)] >= n)
        if n <= 3:
            found.append((owner[here], h[here], n))
        if n >= 2:  # an affix of n-1 letters goes with its border
            fits = np.flatnonzero(size >= n)
            found.append((fits, h[starts[fits]], 10 + n))
            found.append((fits, h[ends[fits] - n], 20 + n))
    total = np.zeros(len(code) + 1, np.uint64)
    place = (np.arange(len(code)) - starts[owner]).astype(np.uint64)
    np.cumsum((code * np.uint64(0xD6E8FEB86659FD93)) ^ ((place + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)) * code, out=total[1:])
    found.append((np.arange(len(words)), total[ends] - total[starts], 99))
    words_, hashes = [], []
    for o, x, tag in found:
        x = (x + np.uint64(tag)) * np.uint64(0xBF58476D1CE4E5B9)
        words_.append(o)
        hashes.append(((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - TABLE_BITS))
    return np.concatenate(words_), np.concatenate(hashes).astype(np.int64)


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (chains x words x labels) and expected transitions, for chains padded to one length, in scaled probabilities."""
    chains, most, labels = emissions.shape
    e = np.exp(emissions - emissions.max(2, keepdims=True))
    step = np.exp(transitions)
    alpha = np.empty_like(e)
    beta = np.ones_like(e)
    alpha[:, 0] = e[:, 0] * np.exp(start)
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for t in range(1, most):
        alpha[:, t] = (alpha[:, t - 1] @ step) * e[:, t]
        alpha[:, t] /= alpha[:, t].sum(1, keepdims=True)
    both = np.zeros((labels, labels))
    inside = np.arange(most)[None, :] < lengths[:, None]
    for t in range(most - 2, -1, -1):
        ahead = e[:, t + 1] * beta[:, t + 1]
        b = ahead @ step.T
        b /= b.sum(1, keepdims=True)
        on = inside[:, t + 1]
        beta[:, t] = np.where(on[:, None], b, 1.0)
        pair = alpha[on, t][:, :, None] * step[None] * ahead[on][:, None, :]
        both += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    marginals = alpha * beta
    marginals /= marginals.sum(2, keepdims=True)
    return marginals * inside[:, :, None], both


def fit(chains: list[list[str]], labels: list[str]) -> Model:
    """Adaptive gradient ascent on the likelihood of the words' labels given the words; chains are of one label each, some are spliced here."""
    languages = sorted(set(labels))
    size = len(languages)
    weights, transitions, start = np.zeros((1 << TABLE_BITS, size)), np.eye(size), np.zeros(size)
    if size < 2 or not chains:
        return Model(languages, weights, transitions, start)
    of = {name: i for i, name in enumerate(languages)}
    vocabulary = sorted({w for chain in chains for w in chain})
    known = {w: i for i, w in enumerate(vocabulary)}
    rows = [np.array([known[w] for w in chain]) for chain in chains]
    owner, flat = cells(vocabulary)
    by_word = np.argsort(owner, kind="stable")
    flat, first = flat[by_word], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(vocabulary)))])
    gold = [np.full(len(row), of[label]) for row, label in zip(rows, labels, strict=True)]
    order, random = np.arange(len(rows)), np.random.default_rng(5)
    # two chains swap their ends where they are cut
    for i, j in random.permutation(len(rows))[: int(SPLICED * len(rows)) // 2 * 2].reshape(-1, 2):
        at, to = random.integers(len(rows[i]) + 1), random.integers(len(rows[j]) + 1)
        for parts in (rows, gold):
            left, right = parts[i], parts[j]
            parts[i], parts[j] = np.concatenate([left[:at], right[to:]]), np.concatenate([right[:to], left[at:]])
    whole = [i for i in order if len(rows[i])]
    rows, gold = [rows[i] for i in whole], [gold[i] for i in whole]
    order = np.arange(len(rows))
    squares, squares_t, squares_s = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6), np.full_like(start, 1e-6)
    for _ in range(EPOCHS):
        random.shuffle(order)
        for at in range(0, len(order), 512):
            some = order[at : at + 512]
            lengths = np.array([len(rows[i]) for i in some])
            padded, labelled = np.zeros((2, len(some), lengths.max()), np.int64)
            for k, i in enumerate(some):
                padded[k, : lengths[k]], labelled[k, : lengths[k]] = rows[i], gold[i]
            used, inverse = np.unique(padded, return_inverse=True)
            many = first[used + 1] - first[used]
            o = np.repeat(np.arange(len(used)), many)
            f = flat[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[used], many)]
            word_scores = np.stack([np.bincount(o, weights[f, c], len(used)) for c in range(size)], 1)
            marginals, both = forward_backward(word_scores[inverse.reshape(padded.shape)], lengths, transitions, start)
            inside = np.arange(padded.shape[1])[None, :] < lengths[:, None]
            truth = np.zeros_like(marginals)
            np.put_along_axis(truth, labelled[:, :, None], 1, 2)
            slope = (truth * inside[:, :, None] - marginals) / len(some)
            on_words = np.stack([np.bincount(inverse.ravel(), slope[:, :, c].ravel(), len(used)) for c in range(size)], 1)
            g = np.stack([np.bincount(f, on_words[o, c], len(weights)) for c in range(size)], 1) - 1e-6 * weights
            squares += g * g
            weights += 0.2 * g / np.sqrt(squares)
            seen = np.zeros((size, size))
            np.add.at(seen, (labelled[:, :-1][inside[:, 1:]], labelled[:, 1:][inside[:, 1:]]), 1)
            g = (seen - both) / len(some) - 1e-3 * transitions
            squares_t += g * g
            transitions += 0.1 * g / np.sqrt(squares_t)
            g = slope[:, 0].sum(0)
            squares_s += g * g
            start += 0.1 * g / np.sqrt(squares_s)
    return Model(languages, weights.astype(np.float32), np.clip(transitions, -4, 4), start)


class _Scores(dict):
    """Token -> its row in a table of emission scores; the last column is 1 if the token has a letter. A full table starts anew between batches."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows = model, np.zeros((0, len(model.languages) + 1), np.float32)

    def learn(self, tokens: list[str]) -> None:
        if len(self) + len(tokens) > WORD_CACHE:
            self.clear()
            self.rows = self.rows[:0]
        new = [t for t in dict.fromkeys(tokens) if t not in self]
        weights, tables = self.model.weights, [self.rows]
        for at in range(0, len(new), LEARN_WORDS):
            words = [letters(t) for t in new[at : at + LEARN_WORDS]]
            owner, cell = cells(words)
            some = np.fromiter((bool(w) for w in words), bool, len(words))
            rows = [np.bincount(owner, weights[cell, c], len(words)) * some for c in range(weights.shape[1])]
            tables.append(np.stack([*rows, some], 1).astype(np.float32))
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
        self.rows = np.concatenate(tables)


def _groups(texts: list[str | None]) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Texts that have words, with their places, in groups of about GROUP_WORDS words."""
    places, words, size = [], [], 0
    for i, t in enumerate(texts):
        if t and (own := t.split()):
            places.append(i)
            words.append(own)
            size += len(own)
            if size >= GROUP_WORDS:
                yield places, words
                places, words, size = [], [], 0
    if places:
        yield places, words


def _rows_of(words: list[list[str]], scores: _Scores) -> np.ndarray:
    """Of every token of every text, its row in the table of scores."""
    tokens = [t for own in words for t in own]
    fresh = {t for t in tokens if t not in scores}
    if fresh:
        scores.learn(list(set(tokens)) if len(scores) + len(fresh) > WORD_CACHE else list(fresh))
    return np.fromiter(map(scores.__getitem__, tokens), np.int64, len(tokens))


def predict(texts: list[str | None], model: Model, scores: _Scores) -> list[tuple[str, float]]:
    """Label and score of each text; all texts of a group go through forward-backward together."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if not model.languages:
        return out
    for places, words in _groups(texts):
        flat = _rows_of(words, scores)
        total = np.zeros((len(places), len(model.languages)))
        for owner, at, marginals in marginal_blocks(scores.rows[:, :-1], flat, np.array([len(w) for w in words]), model):
            share = marginals * scores.rows[flat[at], -1:]
            for c in range(total.shape[1]):
                total[:, c] += np.bincount(owner, share[:, c], len(places))
        sums = total.sum(1, keepdims=True)
        total /= np.maximum(sums, 1e-9)
        best = total.argmax(1)
        for k, i in enumerate(places):
            if sums[k, 0] > 0:
                out[i] = (model.languages[best[k]], float(min(1.0, total[k, best[k]])))
    return out


def predict_words(texts: list[str | None], model: Model, scores: _Scores) -> list[list[tuple[str, str, float]]]:
    """Of each text its words with their labels and these labels' probabilities; words without a letter are `und`."""
    out: list[list[tuple[str, str, float]]] = [[] for _ in texts]
    for places, words in _groups(texts):
        if not model.languages:
            labels = [(UNKNOWN, 0.0)] * sum(map(len, words))
        else:
            flat = _rows_of(words, scores)
            best, sure = np.zeros(len(flat), np.int64), np.zeros(len(flat))
            for _, at, marginals in marginal_blocks(scores.rows[:, :-1], flat, np.array([len(w) for w in words]), model):
                best[at], sure[at] = marginals.argmax(1), marginals.max(1)
            labels = [(model.languages[x], p) if has else (UNKNOWN, 0.0) for x, p, has in zip(best.tolist(), sure.tolist(), (scores.rows[flat, -1] > 0).tolist(), strict=True)]
        at = 0
        for i, own in zip(places, words, strict=True):
            out[i] = [(w, *label) for w, label in zip(own, labels[at : at + len(own)], strict=True)]
            at += len(own)
    return out


def marginal_blocks(table: np.ndarray, flat: np.ndarray, lengths: np.ndarray, model: Model, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place in `flat`, marginals) of the words of each block, last blocks first; a text's words follow one another in `flat`, rows of `table` are their emission scores.

    Texts run side by side, longest first, so that the texts that reach a word are the first ones. A pass forward keeps the forward sums at the borders of blocks; the
    pass back works each block's forward sums out again and meets them with the backward sums.
    """
    order = np.argsort(-lengths, kind="stable")
    begins, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    most = int(sizes[0])
    alive = np.searchsorted(-sizes, -np.arange(most), "left")  # texts with more than t words
    step, start = np.exp(model.transitions).astype(np.float32), np.exp(model.start).astype(np.float32)

    def emissions(first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of words first to last, word by word: texts, places, scaled emissions, and where each word's texts begin among these."""
        many = alive[first:last]
        edges = np.concatenate([[0], np.cumsum(many)])
        owner = np.arange(edges[-1]) - np.repeat(edges[:-1], many)
        at = begins[owner] + np.repeat(np.arange(first, last), many)
        e = table[flat[at]]
        return owner, at, np.exp(e - e.max(1, keepdims=True)), edges

    def forward(a: np.ndarray | None, e: np.ndarray, edges: np.ndarray) -> Iterator[np.ndarray]:
        for t in range(len(edges) - 1):
            here = e[edges[t] : edges[t + 1]]
            a = here * start if a is None else (a[: len(here)] @ step) * here
            a /= a.sum(1, keepdims=True)
            yield a

    borders: list[np.ndarray | None] = [None]
    for first in range(0, most - block, block):
        _, _, e, edges = emissions(first, first + block)
        for a in forward(borders[-1], e, edges):
            pass
        borders.append(a)
    back = np.ones((len(sizes), len(step)), np.float32)
    for number in range(len(borders) - 1, -1, -1):
        first = number * block
        owner, at, e, edges = emissions(first, min(most, first + block))
        gamma = np.concatenate(list(forward(borders[number], e, edges)))
        for t in range(len(edges) - 2, -1, -1):
            rows = slice(edges[t], edges[t + 1])
            now = back[: edges[t + 1] - edges[t]]
            gamma[rows] *= now
            n = (e[rows] * now) @ step.T
            back[: len(n)] = n / n.sum(1, keepdims=True)
        yield order[owner], at, gamma / gamma.sum(1, keepdims=True)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose crc32 of the key as text leaves 2 when divided by 4: never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns every label of the labelled rows of `docs` that are not held out. The driver gets `sample` different texts a language at most, whole, and no more once they have SAMPLE_WORDS words."""
    labelled = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(F.col(text).alias("text"), F.col(label).alias("label"), F.xxhash64(F.col(text), F.lit(7)).alias("name"))
    # texts are many or few, whatever number of rows repeats them; of many about the first 4 * sample by hash go on, so that at least `sample` are left if the estimate is off
    texts = labelled.groupBy("label").agg(F.approx_count_distinct("name").alias("texts"))  # a row a language
    place = F.shiftrightunsigned("name", 11) / F.lit(float(1 << 53))
    near = labelled.join(F.broadcast(texts), "label").filter(place < F.lit(4.0 * sample) / F.col("texts")).groupBy("label", "name").agg(F.min("text").alias("text"))
    first = Window.partitionBy("label").orderBy(F.shiftrightunsigned("name", 11), "name")  # over some 4 * sample texts
    size = F.size(F.split("text", r"\s+"))
    ranked = near.withColumn("place", F.row_number().over(first)).withColumn("before", F.sum(size).over(first) - size)
    drawn = ranked.filter((F.col("place") <= sample) & (F.col("before") < SAMPLE_WORDS))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, names = [], []
            for t, name in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = [w for x in t.split() if (w := letters(x))]
                out += [words[at : at + CHAIN] for at in range(0, len(words), CHAIN)]
                names += [name] * -(-len(words) // CHAIN)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), pa.array(names, pa.string())], names=["words", "label"])

    rows = sorted((r["label"], list(r["words"])) for r in drawn.select("text", "label").mapInArrow(pieces, "words array<string>, label string").toLocalIterator())
    return fit([w for _, w in rows], [x for x, _ in rows])


def identify(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", keep: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Label and score, named by `names`, beside `key`, or with `keep` beside all columns of `docs`, none of which may have these names."""
    shipped = docs.sparkSession.sparkContext.broadcast((int(np.random.default_rng().integers(1 << 62)), model))  # grows with languages only
    rows = docs if keep else docs.select(key, text)
    at = rows.columns.index(text)
    places = [i for i in range(len(rows.columns)) if keep or i != at]
    given = [rows.columns[i] for i in places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, fitted = shipped.value
        scores = held(("language", name), lambda: _Scores(fitted))
        for batch in batches:
            for start in range(0, batch.num_rows, TEXT_ROWS_PER_BATCH):
                b = batch.slice(start, TEXT_ROWS_PER_BATCH)
                found = predict(b.column(at).to_pylist(), fitted, scores)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in places), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*given, *names])

    kept = [f for f in rows.schema.fields if keep or f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{names[0]}` string", f"`{names[1]}` double"])
    return rows.mapInArrow(run, schema)


def label_words(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, words: every word of each text with its label and how sure that is."""
    shipped = docs.sparkSession.sparkContext.broadcast((int(np.random.default_rng().integers(1 << 62)), model))  # grows with languages only
    kind = docs.schema[key].dataType.simpleString()
    word = pa.list_(pa.struct([("word", pa.string()), ("label", pa.string()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, fitted = shipped.value
        scores = held(("language", name), lambda: _Scores(fitted))
        for batch in batches:
            for start in range(0, batch.num_rows, TEXT_ROWS_PER_BATCH):
                b = batch.slice(start, TEXT_ROWS_PER_BATCH)
                found = predict_words(b.column(1).to_pylist(), fitted, scores)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[{"word": w, "label": x, "probability": p} for w, x, p in own] for own in found], word)], names=[key, "words"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, words array<struct<word:string,label:string,probability:double>>")
