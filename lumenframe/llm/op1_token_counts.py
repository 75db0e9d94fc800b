"""Count-only Viterbi token counts for a unigram vocabulary.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at each
character; dynamic programming carries the best score and the number of pieces of that
best path, no ids and no back pointers.  The rules are those of the tokenizers library's
Unigram model: a path replaces another only with a strictly higher score, at equal score
the one whose last piece is longest stays; a character that is no piece of its own may be
unknown at ten below the lowest score; unknown characters become byte pieces if all 256
are in the vocabulary, else a run of them is one unknown piece.

Scores are summed in double precision.  Where no piece has a blank mark after another
character, texts are cut before blanks (and around line ends if they are no part of a
piece) and every distinct cut is scored once; this needs scores whose sums are exact,
integers below 2^53 in all, and is checked when the model is made.  Other vocabularies
are scored over whole texts.

The installed vocabulary files hold no unigram model; the query reads the pieces and
scores of ``piece_bpe_32k.model`` as one.  Control pieces are left out.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_groups

MARK, UNKNOWN_BELOW = "▁", 10.0
SCHEMA = "doc_id long, n_chars long, n_tokens long, score double"


class UnigramCounter:
    """``count(text)`` gives (score, pieces) of the best path of "▁" + text, blanks as "▁"."""

    def __init__(self, pieces: list[tuple[str, float]], most_cuts: int = 200_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_BELOW
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        exact = all(float(s).is_integer() and abs(s) < 1e10 for _, s in pieces)
        self.by_cuts = exact and (self.bytes or MARK in names) and not any(MARK in p.lstrip(MARK) for p in names)
        self.by_lines = self.by_cuts and self.bytes and not any("\n" in p for p in names)
        self.memo: dict[str, tuple[float, int]] = {}
        self.most_cuts = most_cuts

    def path(self, text: str) -> tuple[float, int]:
        """The best path's score and number of pieces over all of ``text``."""
        n, unknown = len(text), self.unknown
        score, count, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(text)
        end, found = next(matches, (n, None))
        for i in range(n):
            best, pieces, run, single = None, 0, False, False
            while end == i:
                length, s = found
                s += score[i + 1 - length]
                if best is None or s > best:
                    best, pieces = s, count[i + 1 - length] + 1
                single = single or length == 1
                end, found = next(matches, (n, None))
            if not single and (best is None or score[i] + unknown > best):
                best, run = score[i] + unknown, True
                pieces = count[i] + (len(text[i].encode("utf-8", "surrogatepass")) if self.bytes else not open_run[i])
            score[i + 1], count[i + 1], open_run[i + 1] = best, pieces, run
        return score[n], count[n]

    def _cut(self, text: str) -> tuple[float, int]:
        if (got := self.memo.get(text)) is None:
            if len(self.memo) >= self.most_cuts:
                self.memo.clear()
            got = self.memo[text] = self.path(text)
        return got

    def count(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        if not self.by_cuts:
            return self.path(MARK + text.replace(" ", MARK))
        total, pieces = 0.0, 0
        if MARK in text:
            text = text.replace(MARK, " ")
        text = " " + text
        lines = text.split("\n") if self.by_lines else [text]
        for i, line in enumerate(lines):
            if i:
                total += self.unknown
                pieces += 1
            if not line:
                continue
            if line[-1] == " " or "  " in line:
                cuts = re.findall(r" *[^ ]+| +", line)
            else:
                head, *tail = line.split(" ")
                cuts = [" " + t for t in tail]
                if head:
                    cuts.append(head)
            for s, c in map(self._cut, [c.replace(" ", MARK) for c in cuts]):
                total += s
                pieces += c
        return total, pieces


def model_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, without control and unknown pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]


_made: dict[str, UnigramCounter] = {}


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_tokens and best score of every whole text; no shuffle.

    Null and empty texts count no tokens and score 0; repeated rows and null ids give a
    row each; an empty table gives none; other columns are ignored.
    """

    def task(batches):
        if model not in _made:
            _made[model] = UnigramCounter(model_pieces(model))
        count = _made[model].count
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            counted = [count(t.decode("utf-8", "replace")) for _, group in text_groups(texts) for t in group]
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array([c for _, c in counted], pa.int64()), pa.array([s for s, _ in counted], pa.float64())], names=["doc_id", "n_chars", "n_tokens", "score"])

    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long"), F.encode(text, "UTF-8"), F.coalesce(F.char_length(text), F.lit(0)).cast("long")).mapInArrow(task, SCHEMA)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE_SQL: dict[str, str] = {}
