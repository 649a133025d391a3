"""Token counts by a unigram segmentation, with dynamic programming shared over a trie of pre-tokens.

A text is normalised as piece vocabularies do (a mark in front, spaces turned into marks) and cut into pre-tokens: a run of
newlines, or a run of marks with the word after it. Distinct pre-tokens go into a trie. The best score of a prefix (sum of the log
probabilities of its pieces, ties to fewer pieces) is computed once at its node, from the nodes above it, so words that share a
prefix share the work. The count at the end of a pre-token is stored, and a document's count is the sum over its pre-tokens.
The pieces that end at a node hang on its longest ending with which a piece begins, so only these are tried and no other substring.

The vocabulary is a file of pieces in order of frequency; a piece of rank r has log probability -ln(r + OFFSET), Zipf's law. A
character in no piece costs one token per UTF-8 byte, at a score 10 below the least piece.

No shuffle: counts need only the document itself. A worker's trie is dropped when it has TRIE_NODES nodes and built up again,
which bounds memory and changes no count. A pre-token of more than LONG characters shares no prefix worth keeping: it gets the
same forward scores in a window as wide as the longest piece and isn't stored.

Null texts count as empty, an empty text has 0 tokens, repeated rows give repeated results, a null id stays null, an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField

from tripmarts.llm.common import id_and_text, map_columns

MARK = "▁"
OFFSET = 3.0
TRIE_NODES = 700_000
#: Characters of prefixes for each of these nodes, on average.
NODE_CHARS = 32
LONG = 1024
PRE_TOKEN = re.compile(f"\n+|{MARK}*[^{MARK}\n]+|{MARK}+")


def zipf_scores(model_file: str) -> dict[str, float]:
    """Log probabilities of the pieces of a vocabulary file, by rank; control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ordinary = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): -math.log(rank + OFFSET) for rank, i in enumerate(ordinary)}


class PrefixTrie(dict):
    """Pre-token -> (tokens, score). Nodes are numbered by prefix; above leads from a node to the one a character shorter."""

    def __init__(self, scores: dict[str, float], limit: int = TRIE_NODES, long: int = LONG):
        super().__init__()
        self.scores, self.limit, self.long = scores, limit, long
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.singles = {p for p in scores if len(p) == 1}
        #: Each beginning of a piece -> (length, score) of the pieces that it ends with; filled as they are met.
        self.ends: dict[str, tuple[tuple[int, float], ...] | None] = {p[:n]: None for p in scores for n in range(len(p) + 1)} | {"": ()}
        self.reset()

    def follow(self, state: str) -> str:
        """The longest ending with which a piece begins."""
        while state not in self.ends:
            state = state[1:]
        if self.ends[state] is None:
            self.ends[state] = tuple((len(state) - at, self.scores[state[at:]]) for at in range(len(state)) if state[at:] in self.scores)
        return state

    def reset(self) -> None:
        self.clear()
        self.node: dict[str, int] = {}
        self.moves: dict[str, str] = {}
        self.above, self.state, self.best, self.count = [0], [""], [0.0], [0]
        self.held = 0

    def unstored(self, word: str) -> tuple[int, float]:
        """The same recursion without nodes: the last `longest` prefixes are all it looks back at."""
        width, state = self.longest + 1, ""
        best, count = [0.0] * width, [0] * width
        for end, ch in enumerate(word, 1):
            top, least = -math.inf, 0
            state = self.follow(state + ch)
            for size, s in self.ends[state]:
                at = (end - size) % width
                score, n = best[at] + s, count[at] + 1
                if score > top or (score == top and n < least):
                    top, least = score, n
            if ch not in self.singles:
                at = (end - 1) % width
                score, n = best[at] + self.unknown, count[at] + len(ch.encode("utf-8", "surrogatepass"))
                if score > top or (score == top and n < least):
                    top, least = score, n
            best[end % width], count[end % width] = top, least
        return count[len(word) % width], best[len(word) % width]

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(word) > self.long:
            return self.unstored(word)
        if len(self.best) > self.limit or self.held > NODE_CHARS * self.limit:
            self.reset()
        nodes, above, states, best, count, moves, ends, singles = self.node, self.above, self.state, self.best, self.count, self.moves, self.ends, self.singles
        known = len(word)
        while known and word[:known] not in nodes:
            known -= 1
        node = nodes[word[:known]] if known else 0
        path = [node]
        while node:
            node = above[node]
            path.append(node)
        path.reverse()
        node = path[-1]
        state = states[node]
        self.held += (len(word) - known) * (len(word) + known + 1) // 2
        for end in range(known + 1, len(word) + 1):
            ch = word[end - 1]
            move = state + ch
            state = moves.get(move)
            if state is None:
                state = moves[move] = self.follow(move)
            top, least = -math.inf, 0
            for size, s in ends[state]:
                at = path[end - size]
                score, n = best[at] + s, count[at] + 1
                if score > top or (score == top and n < least):
                    top, least = score, n
            if ch not in singles:
                score, n = best[node] + self.unknown, count[node] + len(ch.encode("utf-8", "surrogatepass"))
                if score > top or (score == top and n < least):
                    top, least = score, n
            above.append(node)
            states.append(state)
            node = nodes[word[:end]] = len(best)
            best.append(top)
            count.append(least)
            path.append(node)
        self[word] = out = (count[node], best[node])
        return out


@lru_cache(maxsize=2)
def _trie(model_file: str) -> PrefixTrie:
    """Kept by the worker from task to task."""
    return PrefixTrie(zipf_scores(model_file))


def pre_tokens(text: str) -> list[str]:
    return PRE_TOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


def _counter(model_file: str) -> Callable[[], Callable[[list[str]], list[pa.Array]]]:
    def make():
        trie = _trie(model_file)

        def work(texts: list[str]) -> list[pa.Array]:
            n, words, scores = [], [], []
            for text in texts:
                counts, logs = zip(*map(trie.__getitem__, pre_tokens(text)), strict=True) if text else ((), ())
                n.append(sum(counts))
                words.append(len(counts))
                scores.append(math.fsum(logs))
            return [pa.array(n, pa.int64()), pa.array(words, pa.int64()), pa.array(scores, pa.float64())]
        return work
    return make


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, n_pre_tokens, log_score of the best segmentation."""
    return map_columns(id_and_text(docs, id_col, text_col), "text_", _counter(model_file),
                       [StructField("n_tokens", LongType()), StructField("n_pre_tokens", LongType()), StructField("log_score", DoubleType())], drop_text=True)
