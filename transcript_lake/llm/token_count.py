"""Token counts under a unigram vocabulary: a Viterbi search that only counts.

The vocabulary is the pieces and scores of a sentencepiece file; the best
segmentation of a text is the one with the highest sum of scores. An
Aho-Corasick automaton lists all pieces that end at each character, and the
dynamic programme carries the best score and the number of tokens up to it.

Tie rules (those of the ``tokenizers`` library's unigram model, in double
precision): of equally good ways to reach a position the one with the longest
last piece wins; a character that no one-character piece covers may be taken
as unknown at the lowest score less 10, and counts as its UTF-8 bytes (byte
fallback). Control, unknown and byte pieces never match text.

No piece crosses from a letter into a following space mark or holds a
newline (checked when the vocabulary is loaded), so the best path of a text is
the best paths of its chunks one after the other. Counts of chunks are kept in
a bounded cache. The released models here are scored by merge rank: scores are
whole numbers and their sums exact.

Null and empty texts have 0 tokens. Every whole text is read. Rows are judged
one by one, so ties and repeated rows need no rule. Other columns pass.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as T

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 300_000
_loaded: dict[str, "Unigram"] = {}


class Unigram:
    """Counts tokens of texts under (piece, score) pairs."""

    def __init__(self, pieces: list[tuple[str, float]], lowest: float):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = lowest - UNKNOWN_PENALTY
        inside = re.compile(f"[^{SPACE}]{SPACE}")
        self.apart = not any(inside.search(p) for p, _ in pieces)      # pieces never end before a mark
        self.lines = not any("\n" in p for p, _ in pieces)
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.marked = _Cache(lambda w: self.viterbi(SPACE + w))
        self.bare = _Cache(self.viterbi)

    def viterbi(self, text: str) -> int:
        """Tokens of the best segmentation of ``text`` (already with space marks)."""
        n = len(text)
        best, count = [None] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        ends: list[list] = [[] for _ in range(n)]
        for end, hit in self.automaton.iter(text):
            ends[end].append(hit)
        for end in range(n):
            top, c, single = None, 0, False
            for size, score in sorted(ends[end], reverse=True):        # longest first
                single |= size == 1
                s = best[end + 1 - size] + score
                if top is None or s > top:
                    top, c = s, count[end + 1 - size] + 1
            if not single:
                s = best[end] + self.unknown
                if top is None or s > top:
                    top, c = s, count[end] + len(text[end].encode("utf-8", "surrogatepass"))
            best[end + 1], count[end + 1] = top, c
        return count[n]

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        if not (self.apart and self.lines):
            return self.viterbi(SPACE + text.replace(" ", SPACE))
        total = 0
        for i, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if SPACE in line or "" in words:        # several marks in a row: cut by pattern
                line = (SPACE if not i else "") + line.replace(" ", SPACE)
                total += sum(map(self.bare.__getitem__, self.chunks.findall(line)))
            else:
                total += sum(map(self.marked.__getitem__, words[1:]))
                total += (self.bare if i else self.marked)[words[0]]
            total += self.bare["\n"] if i else 0
        return total


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[key] = value
        return value


def load(path: str) -> Unigram:
    """The pieces and scores of a sentencepiece file (read once per worker)."""
    if path not in _loaded:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        normal = [i for i in ids if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        _loaded[path] = Unigram([(p.id_to_piece(i), p.get_score(i)) for i in normal],
                                min(p.get_score(i) for i in ids))
    return _loaded[path]


def count_tokens(docs: DataFrame, model: str, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``n_tokens``."""
    cols = docs.select(*keep, F.col(text).alias("__text"))
    schema = cols.select(*keep).schema.add("n_tokens", "long")

    def run(batch, s):
        unigram = load(model)
        n = [unigram.tokens(t or "") for t in batch.column(len(keep)).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))]
                                          + [pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return T.map_slices(cols, run, schema, "__text")
