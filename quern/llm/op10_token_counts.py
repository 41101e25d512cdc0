"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the mark that stands for the space before it. Its
best split into pieces of a unigram vocabulary has the highest sum of piece
scores; the forward score of a prefix depends on nothing that follows, so all
pre-tokens go into one trie and each of its nodes gets a forward score and the
number of pieces of the best split, once for all pre-tokens below it. The
numbers at terminal nodes are the token counts.

The vocabulary file gives pieces by rank, which Zipf's law turns into scores:
-ln(rank + 2). A character that no piece has costs its UTF-8 bytes, ``UNKNOWN``
each. Of splits with equal scores the one with fewer pieces counts.

Each task keeps its own trie, at most ``NODES`` nodes, and begins a new one
when it is full; a word of more than ``LONG`` characters shares its prefix with
none and goes through the same forward scores in a window as wide as the longest
piece. So memory stays bounded, and results do not change. Nothing is shuffled.
Null and empty texts have no tokens; repeated rows each give a row. An empty
table gives an empty result. Columns other than the two named are not read, and
these may have any name. The path of the vocabulary is a parameter; the driver
reads it and the tasks get pieces and scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_NO = object()
UNKNOWN = -25.0
NODES = 1_000_000
LONG = 1_000


def read_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Score of each piece of a sentencepiece file, without control and byte pieces."""
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [file.id_to_piece(i) for i in range(file.get_piece_size()) if not (file.is_control(i) or file.is_unknown(i) or file.is_byte(i))]
    return {piece: -math.log(rank + 2) for rank, piece in enumerate(plain)}


class Trie:
    """Nodes are prefixes; ``best`` and ``count`` of a node are those of its best split."""

    def __init__(self, scores: dict[str, float]):
        self.longest = max(map(len, scores), default=1)
        # All ends of pieces, so that a search from the right stops where no piece goes on; of a whole piece its score.
        self.ends: dict[str, float | None] = {}
        for piece in scores:
            for k in range(1, len(piece)):
                self.ends.setdefault(piece[k:], None)
        self.ends |= scores
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node and character in one key
        self.best, self.count = [0.0], [0]
        self.known: dict[bytes, int] = {}

    def add(self, word: str) -> int:
        """Insert a pre-token; the number of pieces of its best split."""
        if len(word) > LONG:
            return self.rolled(word)
        child, best, count, ends = self.child, self.best, self.count, self.ends
        node, path = 0, [0]
        for i, c in enumerate(word):
            step = node << 21 | ord(c)
            after = child.get(step)
            if after is None:
                size = len(c.encode("utf-8", "surrogatepass"))
                top, n = best[node] + UNKNOWN * size, count[node] + size
                for k in range(i, -1, -1):
                    score = ends.get(word[k : i + 1], _NO)
                    if score is _NO:
                        break
                    if score is not None:
                        before = path[k]
                        total = best[before] + score
                        if total > top or (total == top and count[before] + 1 < n):
                            top, n = total, count[before] + 1
                after = child[step] = len(best)
                best.append(top)
                count.append(n)
            node = after
            path.append(node)
        return count[node]

    def rolled(self, word: str) -> int:
        """As ``add``, with the last forward scores only and no node."""
        wide = self.longest + 1
        best, count = [0.0] * wide, [0] * wide
        for i, c in enumerate(word):
            size = len(c.encode("utf-8", "surrogatepass"))
            top, n = best[i % wide] + UNKNOWN * size, count[i % wide] + size
            for k in range(i, max(-1, i - self.longest), -1):
                score = self.ends.get(word[k : i + 1], _NO)
                if score is _NO:
                    break
                if score is not None:
                    total = best[k % wide] + score
                    if total > top or (total == top and count[k % wide] + 1 < n):
                        top, n = total, count[k % wide] + 1
            best[(i + 1) % wide], count[(i + 1) % wide] = top, n
        return count[len(word) % wide]

    def tokens(self, words: list[bytes]) -> int:
        known = self.known
        for word in {w for w in words if w not in known}:
            if len(word) > LONG:  # words, not only nodes, would fill the memory
                return sum(map(self.one, words))
            if len(self.best) > NODES:
                self.clear()
                known = self.known
                return sum(self.one(w) for w in words)
            known[word] = self.add(MARK + word.decode("utf-8", "surrogatepass"))
        return sum(map(known.__getitem__, words))

    def one(self, word: bytes) -> int:
        """As ``tokens`` for one word, where the words of one text fill a trie."""
        if len(self.best) > NODES:
            self.clear()
        got = self.known.get(word)
        if got is None and len(word) > LONG:
            return self.rolled(MARK + word.decode("utf-8", "surrogatepass"))
        if got is None:
            got = self.known[word] = self.add(MARK + word.decode("utf-8", "surrogatepass"))
        return got


def count_tokens(docs: DataFrame, vocabulary: dict[str, float], ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident``, n_words and n_tokens of each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(vocabulary)
        for batch in batches:
            n_words, n_tokens = [], []
            for t in batch.column(1):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                n_tokens.append(trie.tokens(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=[ident, "n_words", "n_tokens"])

    return docs.select(F.col(ident), F.col(text)).mapInArrow(run, f"`{ident}` {kind}, n_words long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), read_vocabulary())
