"""Token counts by dynamic programming shared along a trie of pre-tokens.

Each task puts the distinct pre-tokens it meets into a trie. A node stands for a prefix and
holds its forward score: the best unigram segmentation of that prefix, and its number of
tokens. Scores are computed once per node, so pre-tokens with a common prefix share the
work; a pre-token's count is read at its terminal. The trie is started anew when it is
full, which changes no count. Nothing is shuffled.

The vocabulary is a given file, never trained. Its pieces are ranked; a piece's unigram
score is the log of a Zipf share of its rank.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK = "▁"
# Nodes of a task's trie before it is started anew: a memory bound only.
MAX_NODES = 1_000_000
# Longer pre-tokens are scored on their own, with a rolling window, outside the trie.
LONG = 1_000
_PRE_TOKEN = re.compile(f"\n|{SPACE_MARK}?[^{SPACE_MARK}\n]+|{SPACE_MARK}")


def pre_tokens(text: str | None) -> list[str]:
    """Pieces that each start at a space mark; line ends stand alone. None for an empty text."""
    if not text:
        return []
    return _PRE_TOKEN.findall(SPACE_MARK + text.replace(" ", SPACE_MARK))


def load_pieces(path: str) -> tuple[str, ...]:
    """Pieces of a vocabulary file in order of rank, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(
        model.id_to_piece(i)
        for i in range(model.vocab_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    )


def zipf_scores(pieces: tuple[str, ...]) -> dict[str, float]:
    """Log share of each piece if shares fall as one over the rank."""
    total = math.log(sum(1.0 / (r + 1) for r in range(len(pieces)))) if pieces else 0.0
    return {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}


class ForwardTrie:
    """Best segmentation of every prefix of the pre-tokens put in so far."""

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        # What a longer piece ends with: a scan from the end may stop at anything else.
        self.endings = {piece[i:] for piece in scores for i in range(1, len(piece))}
        # A character outside the vocabulary becomes its bytes, at this score.
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.max_nodes = max_nodes
        self.computed = 0
        self._clear()

    def _clear(self) -> None:
        # Keyed by node and code point in one number, which the garbage collector need not visit.
        self.child: dict[int, int] = {}
        self.best = [0.0]
        self.tokens = [0]
        self.terminal: dict[str, int] = {}

    def _forward(self, word: str, end: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Score and tokens of ``word[:end]``; ``best`` and ``tokens`` give those of its last prefixes.

        Starts are tried from the end backwards, up to where no piece ends like that any more.
        Among equal scores the longest last piece wins.
        """
        get, endings = self.scores.get, self.endings
        self.computed += 1
        start = end - 1
        piece = word[start]
        score, size = get(piece), 1
        if score is None:
            score, size = self.unknown, len(piece.encode("utf-8", "surrogatepass"))
        top, count = best[-1] + score, tokens[-1] + size
        back = 1
        while start and piece in endings:
            start -= 1
            back += 1
            piece = word[start:end]
            score = get(piece)
            if score is not None and (total := best[-back] + score) >= top:
                top, count = total, tokens[-back] + 1
        return top, count

    def count(self, word: str) -> int:
        """Number of tokens of a pre-token."""
        found = self.terminal.get(word)
        if found is not None:
            return found
        if len(word) > LONG:
            return self._alone(word)
        if len(self.best) + len(word) > self.max_nodes or len(self.terminal) > self.max_nodes:
            self._clear()
        child, all_best, all_tokens = self.child, self.best, self.tokens
        node, best, tokens = 0, [0.0], [0]
        for end, char in enumerate(word, 1):
            edge = node << 21 | ord(char)
            step = child.get(edge)
            if step is None:
                score, count = self._forward(word, end, best, tokens)
                step = child[edge] = len(all_best)
                all_best.append(score)
                all_tokens.append(count)
                best.append(score)
                tokens.append(count)
            else:
                best.append(all_best[step])
                tokens.append(all_tokens[step])
            node = step
        self.terminal[word] = tokens[-1]
        return tokens[-1]

    def _alone(self, word: str) -> int:
        best, tokens = deque([0.0], self.longest + 1), deque([0], self.longest + 1)
        for end in range(1, len(word) + 1):
            score, count = self._forward(word, end, best, tokens)
            best.append(score)
            tokens.append(count)
        return tokens[-1]


def count_tokens(docs: DataFrame, scores: dict[str, float], text: str = "text") -> DataFrame:
    """``row`` (the input columns but the text), ``n_tokens`` and ``n_pre_tokens``.

    One output row per input row; 0 for null and empty texts. A vocabulary is a file of
    known size, so its scores are broadcast. A very long pre-token needs memory for its own
    characters only.
    """
    slim = docs.drop(text)
    rest = F.struct(*[F.col(f"`{c}`") for c in slim.columns]) if slim.columns else F.struct(F.lit(0))
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches):
        trie = ForwardTrie(shared.value)
        for batch in batches:
            tokens, parts = [], []
            for text_value in batch.column(1):
                found = Counter(pre_tokens(text_value.as_py()))
                tokens.append(sum(trie.count(w) * n for w, n in found.items()))
                parts.append(sum(found.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(parts, pa.int64())],
                names=["row", "n_tokens", "n_pre_tokens"],
            )

    pairs = docs.select(rest.alias("row"), F.col(f"`{text}`").alias("body"))
    zero = F.lit(None).cast("bigint")
    schema = pairs.select("row", zero.alias("n_tokens"), zero.alias("n_pre_tokens")).schema
    return pairs.mapInArrow(run, schema)
