"""Token counts under a unigram model, with forward scores shared along a trie.

Distinct pre-tokens are inserted in a trie. The best score of a prefix depends on the prefix alone, so it is
computed once, when its node is made: the best, over all pieces that end there, of the score of the prefix
before the piece plus the piece's own. A terminal keeps the number of pieces of its best path.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.llm.arrow import map_rows, worker_cache

#: A word's mark: the pieces bear it in place of the blank before a word.
WORD_START = "▁"
#: Nodes after which a task starts a new trie. This bounds memory and does not touch results.
TRIE_NODES = 300_000
CACHE_WORDS = 500_000


def zipf_pieces(model_file: str) -> dict[str, float]:
    """Pieces of a vocabulary file with log-probabilities by Zipf's law over their order; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    norm = math.log(math.fsum(1 / (i + 10) for i in range(len(names))))
    return {p: -math.log(i + 10) - norm for i, p in enumerate(names)}


class ForwardTrie:
    """Tokens of pre-tokens by the best path. A character that no piece covers becomes its UTF-8 bytes, each a token with byte_score. Equal scores prefer the longer last piece."""

    def __init__(self, pieces: dict[str, float], byte_score: float | None = None):
        self.pieces = pieces
        self.byte_score = byte_score if byte_score is not None else min(pieces.values(), default=0.0) - 10
        self.longest = max(map(len, pieces), default=1)
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.score, self.count, self.terminal = [0.0], [0], {}

    def insert(self, word: str) -> int:
        """The word's number of tokens."""
        node, path = 0, [0]
        children, score, count, pieces = self.children, self.score, self.count, self.pieces
        for i, c in enumerate(word):
            after = children[node].get(c)
            if after is None:
                after = children[node][c] = len(children)
                size = len(c.encode("utf-8", "surrogatepass"))
                best, n = score[node] + size * self.byte_score, count[node] + size
                for start in range(i, max(-1, i - self.longest), -1):
                    s = pieces.get(word[start : i + 1])
                    if s is not None and score[path[start]] + s >= best:
                        best, n = score[path[start]] + s, count[path[start]] + 1
                children.append({})
                score.append(best)
                count.append(n)
            node = after
            path.append(node)
        self.terminal[node] = count[node]
        return count[node]


class WordCounter:
    """Counts of whole texts: words are cut at white space and counted once each, as long as they fit the cache."""

    def __init__(self, pieces: dict[str, float]):
        self.trie, self.known = ForwardTrie(pieces), {}

    def counts(self, texts: Iterable[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        split = [t.split() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        for word in sorted(set().union(*split).difference(known)):
            if len(self.trie.children) > TRIE_NODES:
                self.trie.clear()
            known[word] = self.trie.insert(WORD_START + word)
        return [(len(words), sum(map(known.__getitem__, words))) for words in split]


def token_counts(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row; null and empty texts, and those of white space only, have none. The vocabulary file is read where the job is planned."""
    pieces = zipf_pieces(model_file)

    def rows(batches):
        counter = worker_cache(f"unigram {model_file}", lambda: WordCounter(pieces))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = counter.counts([t or "" for t in part.column(1).to_pylist()])
                for key, (words, n) in zip(part.column(0).to_pylist(), got, strict=True):
                    yield (key, words, n), 24

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), rows, "doc_id LONG, n_pretokens LONG, n_tokens LONG", keeps=True)
