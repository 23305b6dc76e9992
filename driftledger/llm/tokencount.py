"""Unigram token counts by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens are put in a trie of numbered nodes.  The best forward score of
a prefix, and the tokens on its path, depend on the prefix alone, so they are
computed once where pre-tokens share it; a pre-token's count stands at its terminal.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .shared import prepare

#: Trie nodes and terminals that a worker keeps before it starts anew.
NODES = 1_000_000
#: Prefixes longer than this aren't shared: their scores are kept for as far as a piece looks back.
DEPTH = 256
SPACE = "▁"
#: By so much a character without a piece scores below the least piece.
UNKNOWN = 10.0


class UnigramTrie:
    """Counts tokens of the best segmentation under the vocabulary's own piece scores.

    A character that is no piece by itself may be spelt in bytes, a token each, at a
    score ``UNKNOWN`` below the least piece's.  Of segmentations with the same score
    the one of fewer tokens counts.
    """

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        self.unknown = min(self.score.values()) - UNKNOWN
        self.longest = max(map(len, self.score))
        #: Last three characters (or all of fewer) -> lengths of the pieces that end in them.
        ends: dict[str, set[int]] = {}
        for piece in self.score:
            if len(piece) > 2:
                ends.setdefault(piece[-3:], set()).add(len(piece))
        self.ends = {c: sorted(n) for c, n in ends.items()}
        self._clear()

    def _clear(self) -> None:
        #: Node and next character (in the low 21 bits) -> node; negative score and tokens of each node's best path.
        self.child: dict[int, int] = {}
        self.cost, self.tokens = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def add(self, token: str) -> int:
        """Insert a pre-token and return its count, which is kept at its terminal."""
        child, score, ends, longest = self.child, self.score, self.ends, self.longest
        node, known = 0, 0
        costs, counts = [0.0], [0]  # of the positions so far, or as many as a piece looks back
        for c in token[:DEPTH]:
            to = child.get(node << 21 | ord(c))
            if to is None:
                break
            node, known = to, known + 1
            costs.append(self.cost[to])
            counts.append(self.tokens[to])
        for end in range(known + 1, len(token) + 1):
            c = token[end - 1]
            s = score.get(c)
            if s is None:
                size = len(c.encode("utf-8", "surrogatepass"))
                best, tokens = costs[-1] - self.unknown, counts[-1] + size
            else:
                best, tokens = costs[-1] - s, counts[-1] + 1
            if end > 1:
                s = score.get(token[end - 2 : end])
                if s is not None:
                    cost = costs[-2] - s
                    if cost < best or cost == best and counts[-2] < tokens - 1:
                        best, tokens = cost, counts[-2] + 1
                for n in ends.get(token[end - 3 : end], ()) if end > 2 else ():
                    if n > end:
                        break
                    s = score.get(token[end - n : end])
                    if s is not None:
                        cost = costs[-n] - s
                        if cost < best or cost == best and counts[-n] < tokens - 1:
                            best, tokens = cost, counts[-n] + 1
            costs.append(best)
            counts.append(tokens)
            if end <= DEPTH:
                to = child[node << 21 | ord(c)] = len(self.cost)
                self.cost.append(best)
                self.tokens.append(tokens)
                node = to
            elif len(costs) > DEPTH + longest:
                del costs[:-longest], counts[:-longest]
        return counts[-1]

    def count(self, text: str | None) -> tuple[int, int]:
        """Tokens and pre-tokens of a text."""
        words = (text or "").split()
        terminal = self.terminal
        try:
            return sum(map(terminal.__getitem__, words)), len(words)
        except KeyError:
            pass
        counts = Counter(words)
        total = 0
        for word, n in counts.items():
            known = self.terminal.get(word)
            if known is None:
                if len(self.cost) > NODES:
                    self._clear()
                known = self.add(SPACE + word)
                if len(word) <= DEPTH:
                    self.terminal[word] = known
            total += n * known
        return total, len(words)


@functools.lru_cache(2)
def load(path: str) -> UnigramTrie:
    return UnigramTrie(path)


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row a document: ``doc_id``, ``n_tokens``, ``n_pretokens``.

    Pre-tokens are runs without white space, with a word-start mark before, of any
    length.  A null or empty text has no tokens.  Repeated rows and null ids stay; an
    empty table gives no rows; other columns are ignored.
    Needs no shuffle; each worker's trie is bounded by ``NODES``.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = load(vocabulary_path)
        for batch in batches:
            found = [trie.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array([n for n, _ in found], pa.int64()), "n_pretokens": pa.array([n for _, n in found], pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, n_pretokens long")
