"""Token counts by a linear longest-match automaton.

A trie over the vocabulary gets failure links and, with each link, the number of tokens that are popped when it is
followed. Reading a word character by character and adding up popped counts gives the length of its greedy
longest-match-first segmentation in time linear in the word, without building a single piece. The arrays are built
once on the driver from a vocabulary whose size is its own bound, and sent with the task; workers read no file.

Word-initial pieces and continuation pieces are two entries into one trie, as in word-piece vocabularies. Words are
cut at ASCII white space; counts of words are kept in a bounded table, as most words are frequent.

Defined results: null and blank texts have no words and no tokens; a word that the vocabulary cannot cover counts as
one unknown token; rows are independent, so repeated rows, ties and other columns need no rule.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlake.llm.common import whole_id

DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose counts a task remembers; the table is emptied when full.
REMEMBERED = 200_000


def read_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Word-initial and continuation pieces of a SentencePiece model, whose initial pieces begin with U+2581."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = [model.id_to_piece(i) for i in ids]
    initial = [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1 and "▁" not in p[1:]]
    return initial, [p for p in pieces if "▁" not in p]


class Automaton:
    """Nodes 0 (word begins) and 1 (word goes on); ``fail`` is -1 where the word cannot go on."""

    def __init__(self, initial: Iterable[str], continuation: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        accepts = [False, False]
        for root, pieces in ((0, initial), (1, continuation)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        accepts.append(False)
                    node = self.next[node][c]
                accepts[node] = accepts[node] or node > 1
        self.fail, self.pops = [-1] * len(accepts), [0] * len(accepts)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                queue.append(child)
                if accepts[child]:
                    self.fail[child], self.pops[child] = 1, 1  # the piece itself
                    continue
                back, popped = self.fail[node], self.pops[node]
                while back != -1 and c not in self.next[back]:
                    popped += self.pops[back]
                    back = self.fail[back]
                if back != -1:
                    self.fail[child], self.pops[child] = self.next[back][c], popped

    def count(self, word: str) -> int:
        """Pieces of the word; -1 if the vocabulary does not cover it."""
        moves, fail, pops = self.next, self.fail, self.pops
        node = total = 0
        for c in word:
            while c not in moves[node]:
                total += pops[node]
                node = fail[node]
                if node == -1:
                    return -1
            node = moves[node][c]
        while node != 1:
            total += pops[node]
            node = fail[node]
            if node == -1:
                return -1
        return total


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.automaton.count(word.decode())
        if len(word) <= 64:
            self[word] = n
        return n


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | tuple[list[str], list[str]] = DEFAULT_VOCABULARY) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_tokens, n_unknown."""
    spark: SparkSession = docs.sparkSession
    pieces = read_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    shared = spark.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(Automaton(*shared.value))
        for batch in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()
                n = [counts[w] for w in words]
                unknown = n.count(-1)
                n_words.append(len(n)), n_tokens.append(sum(n) + 2 * unknown), n_unknown.append(unknown)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], ["id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(whole_id(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)
