"""Evaluation texts leaking into training text, by latent semantic retrieval.

Items are cut into passages of ``run`` words, one at every word (a shorter item is one passage). TF-IDF vectors of these and of
passages of a bounded sample of documents span a latent space, found by a distributed randomised SVD; document frequencies
are counted over all documents. Every window of every document that is as long as some passage is folded into that space
and looked up in an index of the item passages: cells around centroids, of which the ``probes`` nearest are searched.
What has a cosine of at least ``cosine`` to an item passage is a candidate. A candidate with the passage's very words is a verbatim
leak; its window has the passage's own vector, so that the index can't miss it. For the others a long common
subsequence with the whole item, around the window, and the item's answer tell paraphrases.

Windows that can't reach the cosine are left out before they are folded in, by a bound: words that no item has lie outside the space,
and a window's cosine is at most the root of the share that the items' words have in its squared weight.

The items are a stated query set: they are taken in blocks of bounded size, each broadcast to one pass over the documents, which stay
where they are. Nothing of the documents is shuffled; of the sample the words' numbers reach the SVD as a distributed table.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.sample import sampled
from helixmill.operators.staging import BROADCAST_BYTES, staged

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class LeakOptions:
    """run: successive words that make a leak. cosine: least similarity of a candidate. factors: kept singular vectors.
    apart: random directions beside them, which keep words apart that the factors don't hold.
    sample: documents whose passages the space is fitted on, beside the items'; chosen by a hash of their id.
    passages: most item passages in a block. probes: cells searched, of about one per ``cell`` passages.
    paraphrase: least share of an item's words in a common subsequence."""

    run: int = 12
    cosine: float = 0.8
    factors: int = 80
    apart: int = 16
    extra: int = 8
    rounds: int = 2
    sample: int = 1000
    passages: int = 40_000
    probes: int = 6
    cell: int = 64
    paraphrase: float = 0.55
    seed: int = 7


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text; null has none."""
    return _WORD.findall(text.lower()) if text else []


def item_blocks(items: DataFrame, opts: LeakOptions):
    """The items in blocks: lists of (item_id, words, answer words). Items without any word leak nowhere; repeated ids count once."""
    block, size = [], 0
    seen = set()
    for r in items.where("item_id is not null").orderBy("item_id").toLocalIterator():  # one block at a time
        w = words(r["text"])
        if not w or r["item_id"] in seen:
            continue
        seen.add(r["item_id"])
        n = max(1, len(w) - opts.run + 1)
        if block and size + n > opts.passages:
            yield block
            block, size = [], 0
        block.append((r["item_id"], w, words(r["answer"])))
        size += n
    if block:
        yield block


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each word of the vocabulary stands, and how many documents have text. One row a task reaches the driver."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        total, n = np.zeros(len(known.value), np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    n += 1
                    hit = [known.value[w] for w in set(words(text)) if w in known.value]
                    total[hit] += 1
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(total[there], n))], names=["word", "n"])

    total = np.zeros(len(vocabulary), np.int64)
    n = 0
    for r in docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        if r["word"] < 0:
            n = r["n"]
        else:
            total[r["word"]] = r["n"]
    return total, n


def sampled_passages(docs: DataFrame, vocabulary: dict[str, int], idf: np.ndarray, opts: LeakOptions) -> DataFrame:
    """Rows (ids, weights) of length 1: passages of ``run`` words of ``sample`` documents, as far as their words are in the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast((vocabulary, idf))

    def cut(batches):
        vocab, weight = known.value
        for batch in batches:
            ids, weights = [], []
            for text in batch.column(0).to_pylist():
                w = [vocab.get(x, -1) for x in words(text)]
                for lo in range(0, len(w), opts.run):
                    i = np.array([x for x in w[lo : lo + opts.run] if x >= 0], np.int32)
                    if len(i):
                        ids.append(i)
                        weights.append(weight[i] / np.sqrt((weight[i].astype(float) ** 2).sum()))
            yield _rows(ids, weights)

    return sampled(docs.where("text is not null"), opts.sample, opts.seed).select("text").mapInArrow(cut, "ids array<int>, weights array<float>")


def _rows(ids: list, weights: list) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x) if x else np.zeros(0), t)) for x, t in ((ids, pa.int32()), (weights, pa.float32()))]
    return pa.RecordBatch.from_arrays(lists, names=["ids", "weights"])


def randomised_svd(rows: DataFrame, dim: int, factors: int, extra: int, rounds: int, seed: int) -> np.ndarray:
    """Leading right singular vectors (dim x factors) of the sparse rows (ids array<int>, weights array<float>).

    Each round is one distributed pass that sums A'(A Q) over the partitions, in stripes of rows of the result; only
    the dim x (factors + extra) product reaches the driver, however many rows there are.
    """
    width = min(dim, factors + extra)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0].astype(np.float32)
    stripe = 256
    for _ in range(rounds + 1):
        basis = rows.sparkSession.sparkContext.broadcast(q)

        def times(batches, basis=basis):
            total = np.zeros((dim, width), np.float32)
            for batch in batches:
                own = np.diff(batch.column(0).offsets.to_numpy())
                for lo in range(0, len(own), 2048):
                    piece = batch.slice(lo, 2048)
                    n = np.diff(piece.column(0).offsets.to_numpy())
                    ids, w = piece.column(0).flatten().to_numpy(), piece.column(1).flatten().to_numpy()[:, None]
                    if not len(ids):
                        continue
                    there = np.flatnonzero(n)
                    begin = np.concatenate([[0], np.cumsum(n[there])])[:-1]
                    along = np.add.reduceat(w * basis.value[ids], begin, axis=0)
                    part = w * np.repeat(along, n[there], axis=0)
                    order = np.argsort(ids, kind="stable")
                    head = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) > 0]))
                    total[ids[order][head]] += np.add.reduceat(part[order], head, axis=0)
            cells = [total[i : i + stripe].tobytes() for i in range(0, dim, stripe)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells, pa.binary())], names=["stripe", "part"])

        def add(frame):
            import pandas as pd

            total = sum(np.frombuffer(p, np.float32) for p in frame["part"])
            return pd.DataFrame({"stripe": [frame["stripe"].iloc[0]], "part": [total.astype(np.float32).tobytes()]})

        got = rows.mapInArrow(times, "stripe int, part binary").groupBy("stripe").applyInPandas(add, "stripe int, part binary").collect()
        y = np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(got, key=lambda r: r["stripe"])]).reshape(dim, width)
        basis.unpersist()
        last, (q, _) = y, np.linalg.qr(y.astype(np.float64))
        q = q.astype(np.float32)
    # within the span: singular vectors of A from the small matrix Q'A'AQ
    small = q.T.astype(np.float64) @ last.astype(np.float64)
    left, _, _ = np.linalg.svd(small)
    return (q @ left[:, :factors]).astype(np.float32)


@dataclass
class Model:
    """What a pass over the documents needs of a block of items."""

    vocabulary: dict[str, int]
    energy: np.ndarray  # squared weight of each word; the last is that of any other word
    vectors: np.ndarray  # vocabulary x dimensions, times weight
    passages: list  # of each length: ids (passages x length), item of each, vectors of length 1, centroids, passages by cell, where each cell begins
    items: list


def fit(docs: DataFrame, block, opts: LeakOptions) -> Model:
    vocabulary = {w: n for n, w in enumerate(sorted({x for _, w, _ in block for x in w}))}
    df, n = document_frequencies(docs, vocabulary)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.1)
    by_size: dict[int, list] = {}
    for k, (_, w, _) in enumerate(block):
        size = min(opts.run, len(w))
        ids = [vocabulary[x] for x in w]
        by_size.setdefault(size, []).extend((ids[i : i + size], k) for i in range(len(w) - size + 1))
    own = [np.array(i, np.int32) for parts in by_size.values() for i, _ in parts]
    own_rows = _rows(own, [idf[i] / np.linalg.norm(idf[i]) for i in own])
    fitted = staged(docs.sparkSession.createDataFrame(pa.Table.from_batches([own_rows])).select(F.col("ids").cast("array<int>"), F.col("weights").cast("array<float>")).unionByName(sampled_passages(docs, vocabulary, idf, opts)), "passages")
    factors = randomised_svd(fitted, len(vocabulary), min(opts.factors, len(vocabulary)), opts.extra, opts.rounds, opts.seed)
    rng = np.random.default_rng(opts.seed)
    typical = float(np.median(np.linalg.norm(factors, axis=1)))
    apart = rng.standard_normal((len(vocabulary), opts.apart)) * max(1e-3, 0.3 * typical) / np.sqrt(max(1, opts.apart))
    vectors = np.concatenate([factors, apart], axis=1) * idf[:, None]
    passages = []
    for size, parts in sorted(by_size.items()):
        ids, item = np.array([i for i, _ in parts], np.int32).reshape(len(parts), size), np.array([k for _, k in parts])
        _, first = np.unique(np.concatenate([ids, item[:, None].astype(np.int32)], axis=1), axis=0, return_index=True)
        ids, item = ids[np.sort(first)], item[np.sort(first)]
        unit = vectors[ids].sum(axis=1)
        unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
        centroids, cell = _cells(unit, max(1, len(unit) // opts.cell), rng)
        order = np.argsort(cell, kind="stable")
        passages.append((ids[order], item[order], unit[order], centroids, np.searchsorted(cell[order], np.arange(len(centroids) + 1))))
    return Model(vocabulary, np.append(idf.astype(np.float64) ** 2, (np.log(n + 1) + 0.1) ** 2), vectors, passages, block)


def _cells(unit: np.ndarray, n: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length 1 and the nearest of each vector, by a few rounds of spherical k-means."""
    centroids = unit[rng.choice(len(unit), n, replace=False)]
    for _ in range(8):
        cell = (unit @ centroids.T).argmax(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, cell, unit)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(size > 1e-6, total / np.maximum(size, 1e-6), centroids).astype(np.float32)
    return centroids, (unit @ centroids.T).argmax(axis=1)


def candidates(texts: list[list[str]], m: Model, opts: LeakOptions) -> tuple[np.ndarray, ...]:
    """Text, first word, item, cosine and whether the words are the same, of every window with a cosine of at least ``cosine`` to
    an item passage in the cells probed."""
    get, other = m.vocabulary.get, len(m.vocabulary)
    ids = np.array([get(w, other) for t in texts for w in t], np.int64)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    out = []
    weight = m.energy[ids]
    total = np.concatenate([[0], np.cumsum(weight)])
    for length, (known, item, unit, centroids, cells) in zip((k.shape[1] for k, *_ in m.passages), m.passages):
        n = len(ids) - length + 1
        if n <= 0:
            continue
        used = np.zeros(other + 1, bool)
        used[known.ravel()] = True  # no other word adds to a cosine with these passages
        inside = np.concatenate([[0], np.cumsum(np.where(used[ids], weight, 0))])
        least = opts.cosine**2 if length == opts.run else 1.0  # shorter items are looked for verbatim only
        share = (inside[length:] - inside[:n]) >= least * (total[length:] - total[:n]) * (1 - 1e-9)
        at = np.flatnonzero(share & (owner[:n] == owner[length - 1 :]))
        for lo in range(0, len(at), 8192):  # bounded memory whatever the length of the texts
            some = at[lo : lo + 8192]
            w = ids[some[:, None] + np.arange(length)]
            vector = np.zeros((len(some), m.vectors.shape[1]), np.float32)
            for k in range(length):
                there = w[:, k] < other
                vector[there] += m.vectors[w[there, k]]
            # what lies outside the space lengthens the window's vector; random directions don't
            norm = np.linalg.norm(vector, axis=1, keepdims=True)
            vector /= np.maximum(norm, 1e-9)
            near = vector @ centroids.T
            probes = min(opts.probes, len(centroids))
            best = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
            who, cell = np.repeat(np.arange(len(some)), probes), best.ravel()
            order = np.argsort(cell, kind="stable")
            who, cell = who[order], cell[order]
            edges = np.searchsorted(cell, np.arange(len(centroids) + 1))
            for c in np.unique(cell):
                mine = who[edges[c] : edges[c + 1]]
                like = vector[mine] @ unit[cells[c] : cells[c + 1]].T
                i, j = np.nonzero(like >= (opts.cosine if length == opts.run else 0.999))
                if len(i):
                    j_all = j + cells[c]
                    same = (w[mine[i]] == known[j_all]).all(axis=1)
                    out.append((owner[some[mine[i]]], some[mine[i]] - begin[owner[some[mine[i]]]], item[j_all], like[i, j], same))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float32, bool))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of words: a row of the table is one integer, whose zeros mark where it steps up."""
    at: dict[str, int] = {}
    for n, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << n
    whole = (1 << len(a)) - 1
    row = whole
    for w in b:
        if w in at:
            step = row & at[w]
            row = (row + step | row - step) & whole
    return len(a) - row.bit_count()


def in_common(a: list[str], b: list[str]) -> int:
    """How many words of ``a`` can be paired with equal ones of ``b``: no common subsequence is longer."""
    return (Counter(a) & Counter(b)).total()


def leaks(docs: DataFrame, items: DataFrame, opts: LeakOptions = LeakOptions()) -> DataFrame:
    """(doc_id, item_id, cosine, kind): kind is ``verbatim`` or ``paraphrase``, cosine the best of the pair's candidates.

    ``docs``: doc_id, text; ``items``: item_id, text, answer; other columns are ignored. Documents without an id are
    left out; null or empty texts and items hold nothing; a null answer isn't looked for; repeated rows of one doc_id
    give the pair once; empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, cosine double, kind string"
    parts = [_scan(docs, fit(docs, block, opts), opts, schema) for block in item_blocks(items, opts)]
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("kind").alias("kind"))


def _scan(docs: DataFrame, model: Model, opts: LeakOptions, schema: str) -> DataFrame:
    size = model.vectors.nbytes + sum(x.nbytes for p in model.passages for x in p) + sum(len(w) + 60 for w in model.vocabulary)
    if size > 4 * BROADCAST_BYTES:
        raise ValueError(f"a block of items takes {size >> 20} MB: lower LeakOptions.passages")
    model.vectors = model.vectors.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        m = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for lo in range(0, len(ids), 128):
                some = [words(t) for t in texts[lo : lo + 128]]
                rows += [(ids[lo + d], m.items[k][0], cosine, kind) for d, k, cosine, kind in _compare(some, m, opts)]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.string()))], names=["doc_id", "item_id", "cosine", "kind"])

    return docs.where("doc_id is not null and text is not null and text <> ''").mapInArrow(scan, schema)


def _counts(m: Model, k: int) -> dict[str, int]:
    """How often each word stands in an item, counted once."""
    known = m.__dict__.setdefault("counts", {})
    if k not in known:
        known[k] = Counter(m.items[k][1])
    return known[k]


def _compare(texts: list[list[str]], m: Model, opts: LeakOptions):
    """Which candidates are held verbatim, and which are paraphrased with their answer."""
    text, at, item, cosine, same = candidates(texts, m, opts)
    order = np.lexsort((-cosine, ~same, item, text))  # the same words first, then the nearest
    text, at, item, cosine, same = (x[order] for x in (text, at, item, cosine, same))
    last, there = -1, set()
    for n in np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])])[: len(text)]):
        d, k = int(text[n]), int(item[n])
        if same[n]:
            yield d, k, float(cosine[n]), "verbatim"
            continue
        w, (_, own, answer) = texts[d], m.items[k]
        least = opts.paraphrase * len(own)
        if d != last:
            last, there = d, set(w)
        counts = _counts(m, k)
        if len(own) < opts.run or sum(map(counts.__getitem__, there & counts.keys())) < least:
            continue
        around = w[max(0, int(at[n]) - 2 * len(own)) : int(at[n]) + 2 * len(own) + opts.run]  # the item may begin up to its length before the window
        if in_common(own, around) >= least and common_subsequence(own, around) >= least and (not answer or f" {' '.join(answer)} " in f" {' '.join(w)} "):
            yield d, k, float(cosine[n]), "paraphrase"
