"""Token counts by greedy longest match, in one pass over each word and without building its pieces.

The vocabulary is a trie. A node's failure link leads to where matching goes on when the trie has no edge for the
next character, and its pop count is how many pieces are complete by then; both are computed beforehand, so a
word costs time in its length. Only counts are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, documents
from .tokenizing import vocabulary_path

MARK = "▁"  # stands before a word, as in the vocabulary


def sentencepiece_pieces(path: str) -> list:
    """The ordinary pieces of a SentencePiece model: no control, unknown or byte tokens."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class LongestMatch:
    """Counts of greedy longest-match pieces. A character that begins no piece counts as its UTF-8 bytes."""

    def __init__(self, pieces):
        self.edges: list[dict] = [{}]
        ends = {}
        for piece in pieces:
            node = 0
            for c in piece:
                node = self.edges[node].setdefault(c, len(self.edges))
                if node == len(self.edges):
                    self.edges.append({})
            ends[node] = 1
        for c, node in self.edges[0].items():
            ends.setdefault(node, len(c.encode("utf-8", "replace")))
        # Breadth first: a node that is a piece pops itself and goes on at the root; any other takes over from
        # its parent's failure node, popping until an edge for its own character is found.
        self.fail, self.pops = [0] * len(self.edges), [0] * len(self.edges)
        level = [0]
        while level:
            below = []
            for parent in level:
                for c, node in self.edges[parent].items():
                    below.append(node)
                    if node in ends:
                        self.fail[node], self.pops[node] = 0, ends[node]
                        continue
                    to, popped = self.fail[parent], self.pops[parent]
                    while c not in self.edges[to] and to:
                        popped += self.pops[to]
                        to = self.fail[to]
                    if c in self.edges[to]:
                        self.fail[node], self.pops[node] = self.edges[to][c], popped
                    else:
                        self.fail[node], self.pops[node] = 0, popped + len(c.encode("utf-8", "replace"))
            level = below

    def count(self, word: str) -> int:
        edges, fail, pops = self.edges, self.fail, self.pops
        node = total = 0
        for c in word:
            while c not in edges[node] and node:
                total += pops[node]
                node = fail[node]
            to = edges[node].get(c)
            if to is None:
                total += len(c.encode("utf-8", "replace"))
            else:
                node = to
        while node:
            total += pops[node]
            node = fail[node]
        return total


_COUNTERS: dict = {}


def count_tokens(docs: DataFrame, pieces: list, *, mark: str = MARK, doc_id: str = "doc_id", text: str = "text", cached: int = 600_000) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_tokens of the whole text.

    Words are ``[^\\x20\\x09-\\x0D]+``, each led by ``mark``. Null, empty and blank texts count zero. Repeated
    rows stay, null ids too; an empty table gives no rows; other columns are ignored. Counts of words are cached in a worker up to ``cached``
    words; the vocabulary, whose size doesn't depend on the data, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(iterator):
        key = (len(shared.value), hash(tuple(shared.value)), mark)
        if key not in _COUNTERS:
            _COUNTERS[key] = (LongestMatch(shared.value), {})
        automaton, known = _COUNTERS[key]
        for batch in batches(iterator, "text", 4 << 20):
            split = pc.ascii_split_whitespace(pc.fill_null(batch.column(1), ""))
            coded = split.flatten().dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(known) > cached:
                known.clear()
            sizes = []
            for w in distinct:
                n = known.get(w)
                if n is None:
                    n = known[w] = automaton.count(mark + w) if w else 0
                sizes.append(n)
            index = coded.indices.to_numpy(zero_copy_only=False)
            each = np.array(sizes, np.int64)[index] if len(index) else np.zeros(0, np.int64)
            real = np.array([w != "" for w in distinct], np.int64)[index] if len(index) else each
            edges = np.asarray(split.offsets) - split.offsets[0].as_py()
            sums = [np.concatenate([[0], np.cumsum(x)])[edges] for x in (real, each)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.diff(s)) for s in sums)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of all documents."""
    return count_tokens(documents(spark, sf_dir), sentencepiece_pieces(vocabulary_path("piece_bpe_32k.model")))
