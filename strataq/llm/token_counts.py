"""Token counts under a unigram piece model, by dynamic programming over a trie.

A pre-token is a run of non-space characters behind the mark of its space.  The
distinct pre-tokens of a batch are visited as a trie, in sorted order: along the
current branch every node holds the forward score of its prefix (the best
log-probability of any segmentation, and its number of pieces), so a prefix that
thousands of words share is scored once.  Terminal nodes give the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import worker_cache

MARK = "▁"
#: pre-tokens whose counts a worker keeps before it starts anew
CACHE_ENTRIES = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Pieces and log-probabilities of a sentencepiece file.

    The file has ranks and not probabilities, so Zipf's law gives them: the piece
    of rank r has a probability in proportion to 1 / r.  A character that is no
    piece falls back to its UTF-8 bytes, each of which is one piece of the
    probability of a rank ten times the last.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        norm = math.log(sum(1 / r for r in range(1, len(names) + 1)))
        self.score = {p: -math.log(r) - norm for r, p in enumerate(names, 1)}
        self.byte = -math.log(10 * len(names)) - norm
        #: pieces from their last character to their first; None marks a whole piece
        self.back: dict = {}
        for p, s in self.score.items():
            node = self.back
            for ch in reversed(p):
                node = node.setdefault(ch, {})
            node[None] = s

    def counts(self, words: list[str]) -> dict[str, int]:
        """Pieces of the best segmentation of each word; ties go to fewer pieces."""
        out, path, scores, pieces = {}, "", [0.0], [0]
        back, byte = self.back, self.byte
        for word in sorted(words):
            shared, top = 0, min(len(path), len(word))
            while shared < top and path[shared] == word[shared]:
                shared += 1
            del scores[shared + 1 :], pieces[shared + 1 :]
            for j in range(shared, len(word)):
                ch = word[j]
                n = len(ch.encode("utf-8", "replace"))
                # the fallback stands for characters that no piece covers
                best, count = -math.inf, 0
                node, i = back, j
                while i >= 0 and (node := node.get(word[i])) is not None:
                    s = node.get(None)
                    if s is not None:
                        s += scores[i]
                        if s > best or s == best and pieces[i] + 1 < count:
                            best, count = s, pieces[i] + 1
                    i -= 1
                s = scores[j] + n * byte
                if s > best:
                    best, count = s, pieces[j] + n
                scores.append(best)
                pieces.append(count)
            path = word
            out[word] = pieces[-1]
        return out


def counter(path: str) -> tuple[PieceModel, dict[str, int]]:
    """A worker's model of a file, and the counts of pre-tokens by that model."""
    return worker_cache(("pieces", path), lambda: (PieceModel(path), {}))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens, n_bytes`` of every row's whole text.

    Null and empty texts count 0; null ids and repeated rows come back as they
    are; an empty table gives no rows; only the two named columns are read.  No
    shuffle: a task keeps one Arrow batch and a bounded cache of counts.
    """
    path = model_path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()
    kind = kind if kind in ("bigint", "int") else "string"
    schema = pa.schema([("doc_id", {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = counter(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                words = [t.split() for t in texts]
                if len(known) > CACHE_ENTRIES:
                    known.clear()
                fresh = {w for ws in words for w in ws if w not in known}
                if fresh:
                    marked = m.counts([MARK + w for w in fresh])
                    for w in fresh:
                        known[w] = marked[MARK + w]
                get = known.__getitem__
                cols = [part.column(0), [len(w) for w in words], [sum(map(get, w)) for w in words], [len(t.encode("utf-8", "replace")) for t in texts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)

    chosen = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long, n_bytes long")
