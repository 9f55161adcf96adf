"""Containers of fixed capacity filled with whole documents, by lexical retrieval packing.

Documents are dealt into shards of about ``SHARD_DOCS`` documents, at most about ``SHARD_TOKENS`` tokens, by what they are about: a tree that halves a sample of ``TREE_SAMPLE`` documents
along the widest direction of their weighted tokens gives every document its place in one order, which is cut into ranges. A
shard holds a BM25 inverted index of its documents over the tokens of a public tokenizer; document frequencies and the mean length
are those of the whole corpus, a table of one number per vocabulary entry. The largest unused document seeds a container, the
index returns its unused neighbours in order of score, and those that fit fill the window; what is left of it takes the
largest unused documents that fit. A seed asks with its ``QUERY_TERMS`` tokens of most weight; its neighbours are looked up once
for all capacities. Only a document that alone exceeds the capacity is divided: into pieces of full capacity and a rest that
is packed like a document.

Defined results: a document without tokens (NULL, empty) lies in the first container of its shard and takes no room; repeated
rows are packed each; capacities that are NULL or below 1 are left out; text is tokenized whole, special tokens as plain text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pattern that splits text before the merges of this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = 65_536
SHARD_DOCS, SHARD_TOKENS = 4_096, 4_000_000
K1, B = 1.2, 0.75
#: Tokens a seed asks with: those of most weight in it.
QUERY_TERMS = 64
#: Hashed dimensions of a document's vector; documents the tree of topics is fitted on, about; its greatest depth.
DIMENSIONS, TREE_SAMPLE, MAX_DEPTH = 1_024, 8_192, 9
OUT = "container_kind string, capacity_tokens int, shard int, container int, position int, doc_id long, piece int, first_token int, n_tokens int"


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenized(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, ids (uint16 token ids as bytes), n_tokens, h (hash that breaks ties)."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(path)
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                ids = [np.array(tok.encode_ordinary(t), dtype=np.uint16) for t in part["text"].fillna("")]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "h": part["h"].to_numpy(), "ids": [i.tobytes() for i in ids], "n_tokens": [len(i) for i in ids]})

    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).mapInPandas(encode, "doc_id long, h long, ids binary, n_tokens int")


def statistics(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """Document frequency of every vocabulary entry, number of documents and of tokens, from the whole corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, total = np.zeros(VOCABULARY, dtype=np.int64), 0, 0
        for pdf in batches:
            for ids in pdf["ids"]:
                df[np.unique(np.frombuffer(ids, dtype=np.uint16))] += 1
            n, total = n + len(pdf), total + int(pdf["n_tokens"].sum())
        met = np.flatnonzero(df)
        yield pd.DataFrame({"token": np.concatenate([met, [-1, -2]]), "n": np.concatenate([df[met], [n, total]])})

    frequency = np.zeros(VOCABULARY, dtype=np.int64)
    n = total = 0
    for token, c in tokens.mapInPandas(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        if token >= 0:
            frequency[token] = c
        elif token == -1:
            n = c
        else:
            total = c
    return frequency, n, total


@functools.lru_cache(maxsize=1)
def _columns() -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of every token in the vectors of ``vector``."""
    rng = np.random.default_rng(0)
    return rng.integers(0, DIMENSIONS, VOCABULARY), rng.choice([-1.0, 1.0], VOCABULARY)


def vector(ids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The weighted tokens of a document, hashed into ``DIMENSIONS`` dimensions, of length 1."""
    column, sign = _columns()
    terms, times = np.unique(ids, return_counts=True)
    v = np.bincount(column[terms], idf[terms] * times / (times + K1) * sign[terms], DIMENSIONS)
    return (v / max(np.linalg.norm(v), 1e-9)).astype(np.float32)


def topic_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and cut of every node of a tree (as a heap) that halves the sample along its widest direction, again and again."""
    nodes = 2 ** (depth + 1)
    axes, cuts = np.zeros((nodes, DIMENSIONS), dtype=np.float32), np.zeros(nodes, dtype=np.float32)
    parts = {1: sample}
    for node in range(1, nodes):
        part = parts.pop(node, sample[:0])
        if not len(part):
            continue
        axis, mean = np.random.default_rng(node).normal(size=DIMENSIONS).astype(np.float32), part.mean(axis=0)
        for _ in range(8):  # power iteration
            axis = (part - mean).T @ ((part - mean) @ axis)
            axis /= max(float(np.linalg.norm(axis)), 1e-9)
        axes[node], along = axis, part @ axis
        cuts[node] = np.median(along)
        if 2 * node < nodes:
            parts[2 * node], parts[2 * node + 1] = part[along <= cuts[node]], part[along > cuts[node]]
    return axes, cuts


def placed(vectors: np.ndarray, axes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf of every document, and its place along the leaf's widest direction."""
    node = np.ones(len(vectors), dtype=np.int64)
    while True:
        along = np.einsum("ij,ij->i", vectors, axes[node])
        if 2 * node.max(initial=1) >= len(cuts):
            return node, along
        node = 2 * node + (along > cuts[node])


class Index:
    """BM25 inverted index of the documents of one shard."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        terms = [np.unique(i, return_counts=True) for i in ids]
        length = np.array([len(i) for i in ids], dtype=np.float64)
        doc = np.repeat(np.arange(len(ids)), [len(t) for t, _ in terms])
        term = np.concatenate([t for t, _ in terms]) if ids else np.zeros(0, np.uint16)
        tf = np.concatenate([c for _, c in terms]).astype(np.float64) if ids else np.zeros(0)
        norm = K1 * (1 - B + B * length[doc] / max(mean, 1e-9))
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
        ends = np.cumsum([len(t) for t, _ in terms])
        self.query = [t[np.argsort(-w, kind="stable")[:QUERY_TERMS]].astype(np.int64) for (t, _), w in zip(terms, np.split(weight, ends[:-1]), strict=True)] if ids else []
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange(VOCABULARY + 1))
        self.n = len(ids)
        self.found: dict[int, np.ndarray] = {}

    def scores(self, seed: int) -> np.ndarray:
        """Score of every document of the shard for the terms of the seed."""
        terms = self.query[seed]
        spans = [slice(a, b) for a, b in zip(self.starts[terms], self.starts[terms + 1], strict=True)]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents with any of the seed's terms, best first; kept for the other capacities."""
        if seed not in self.found:
            score = self.scores(seed)
            near = np.flatnonzero(score > 0)
            self.found[seed] = near[np.argsort(-score[near], kind="stable")].astype(np.int32)
        return self.found[seed]


def pack(sizes: np.ndarray, index: Index, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(container, position, document, piece, first token, tokens) for every document of a shard."""
    out, container = [], 0
    rest, first, piece = sizes.copy(), np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    for d in np.flatnonzero(sizes > capacity):
        while rest[d] > capacity:
            out.append((container, 0, d, piece[d], first[d], capacity))
            container, rest[d], first[d], piece[d] = container + 1, rest[d] - capacity, first[d] + capacity, piece[d] + 1
    unused = rest > 0
    by_size = np.argsort(-rest, kind="stable")
    ascending = rest[by_size][::-1]
    at = 0
    while True:
        while at < len(by_size) and not unused[by_size[at]]:
            at += 1
        if at == len(by_size):
            break
        seed = by_size[at]
        chosen, room = [seed], capacity - rest[seed]
        unused[seed] = False
        if room > 0:
            near = index.neighbours(seed)
            near = near[unused[near] & (rest[near] <= room)]
            while len(near):  # take what fits in order, step over what doesn't
                used = np.cumsum(rest[near])
                k = int(np.searchsorted(used, room, side="right"))
                if k:
                    chosen += near[:k].tolist()
                    unused[near[:k]] = False
                    room -= int(used[k - 1])
                near = near[k + 1 :]
                near = near[rest[near] <= room]
        while room > 0:
            start = len(by_size) - np.searchsorted(ascending, room, side="right")
            fits = unused[by_size[start:]]
            k = int(fits.argmax()) if len(fits) else 0
            if not len(fits) or not fits[k]:
                break
            d = by_size[start + k]
            chosen.append(d)
            unused[d], room = False, room - rest[d]
        out += [(container, k, d, piece[d], first[d], rest[d]) for k, d in enumerate(chosen)]
        container += 1
    out += [(0, len(sizes) + k, d, 0, 0, 0) for k, d in enumerate(np.flatnonzero(sizes == 0))]
    return out


def sharded(tokens: DataFrame, idf: np.ndarray, n_docs: int, shards: int) -> DataFrame:
    """The documents in ranges of the order of their topics, one range a shard."""
    send = tokens.sparkSession.sparkContext.broadcast
    weights = send(idf)

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"v": [vector(np.frombuffer(b, dtype=np.uint16), weights.value).astype(np.float16).tobytes() for b in pdf["ids"]]})

    depth = min(MAX_DEPTH, max(0, int(shards - 1).bit_length()))
    share = min(1.0, TREE_SAMPLE / max(1, n_docs))
    drawn = [r.v for r in tokens.select("ids", "h").sample(share, 7).mapInPandas(embed, "v binary").collect()] if depth else []
    tree = send(topic_tree(np.frombuffer(b"".join(drawn), dtype=np.float16).reshape(-1, DIMENSIONS).astype(np.float32), depth))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                leaf, along = placed(np.stack([vector(np.frombuffer(b, dtype=np.uint16), weights.value) for b in pdf["ids"]]), *tree.value)
                yield pdf.assign(leaf=leaf, along=along)

    rows = tokens.mapInPandas(place, "doc_id long, h long, ids binary, n_tokens int, leaf int, along float")
    return rows.repartitionByRange(shards, "leaf", "along", "h").select("doc_id", "ids", "n_tokens")


def containers(docs: DataFrame, kinds: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """The container of every document for every capacity, one row per document or piece of a divided one."""
    capacities = [(k, c) for k, c in kinds.where("capacity_tokens >= 1").select("container_kind", "capacity_tokens").distinct().orderBy("capacity_tokens", "container_kind").collect()]
    tokens = cut(tokenized(docs, path))
    frequency, n_docs, n_tokens = statistics(tokens)
    idf = np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5))
    mean = n_tokens / max(1, n_docs)
    shards = max(1, -(-n_docs // SHARD_DOCS), -(-n_tokens // SHARD_TOKENS))
    sent = docs.sparkSession.sparkContext.broadcast(idf)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pdf = pd.concat([pd.DataFrame(columns=["doc_id", "ids", "n_tokens"]), *batches])
        if pdf.empty:
            return
        shard = TaskContext.get().partitionId()
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable")
        ids = [np.frombuffer(b, dtype=np.uint16) for b in pdf["ids"]]
        index = Index(ids, sent.value, mean)
        doc, sizes = pdf["doc_id"].to_numpy(), pdf["n_tokens"].to_numpy().astype(np.int64)
        for kind, capacity in capacities:
            c = np.array(pack(sizes, index, capacity), dtype=np.int64).reshape(-1, 6)
            yield pd.DataFrame({"container_kind": kind, "capacity_tokens": capacity, "shard": shard, "container": c[:, 0], "position": c[:, 1], "doc_id": doc[c[:, 2]], "piece": c[:, 3], "first_token": c[:, 4], "n_tokens": c[:, 5]})

    return sharded(tokens, idf, n_docs, shards).mapInPandas(fill, OUT)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, share of the room that is filled, documents that are divided."""
    per = packed.groupBy("container_kind", "capacity_tokens", "shard", "container").agg(F.sum("n_tokens").alias("used"))
    room = per.groupBy("container_kind", "capacity_tokens").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"))
    return room.withColumn("fill_share", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
