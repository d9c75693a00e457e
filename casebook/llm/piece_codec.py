"""Ids of a SentencePiece merge model from a table of prefixes, and texts from ids.

For each prefix of a chunk the table keeps its last token.  It is the one token that matches
there and is compatible with the last token of the prefix before it: merging the two tokens'
characters by the model's order gives the two tokens back.  An automaton lists the matches; walking the
table back from the end gives the ids.  A chunk is a word with the mark of the space before it: no piece
holds that mark but in front, so chunks don't affect each other.  Runs of marks alone, whose merges all
rank alike and last, are merged in order.
"""

from __future__ import annotations

import gc
import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.common import table
from casebook.llm.vocab import gather, slices

MARK = "▁"
#: Chunks and pairs kept between batches in a worker; beyond it the memory is started afresh.
MEMORY, PAIRS = 300_000, 1_000_000


class PieceCodec:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.unknown = model.unk_id()
        self.text = [model.id_to_piece(i) for i in ids]
        self.bytes_from = next(i for i in ids if model.is_byte(i))
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id_of = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        self.bare = self.id_of[MARK]
        #: Stops that no piece has after a letter.
        joined = {piece[i] for piece in self.id_of for i in range(1, len(piece)) if piece[i - 1].isalpha()}
        self.stops = {c: self.id_of[c] for c in ".," if c in self.id_of and c not in joined}
        assert "\n" not in joined and "\n" not in self.id_of
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        self.runs: dict[int, list[int]] = {}
        self.matches = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            # a piece that its own characters don't merge to never occurs
            if set(piece) != {MARK} and (len(piece) == 1 or self.merge(piece) == [piece]):
                self.matches.add_word(piece, i << 8 | len(piece))
        self.matches.add_word(MARK, self.bare << 8 | 1)
        self.matches.make_automaton()
        self.length = [len(x) for x in self.text]
        spelled = [b"" if model.is_control(i) else bytes([i - self.bytes_from]) if model.is_byte(i) else self.text[i].replace(MARK, " ").encode() for i in ids]
        self.spelled_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_length = np.array([len(x) for x in spelled], np.int64)
        self.spelled_start = np.cumsum(self.spelled_length) - self.spelled_length
        self.decimal = [str(i).encode() for i in ids]

    def merge(self, text: str) -> list[str]:
        """The model's order applied step by step: the best-scored neighbours first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = score.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        a, b = self.text[left], self.text[right]
        return self.merge(a + b) == [a, b]

    def chunk(self, text: str) -> list[int]:
        """Ids of a chunk by its prefix table; characters that no piece spells become bytes."""
        last, pairs, unknown = [0] * len(text), self.pairs, self.unknown
        for end, match in self.matches.iter(text):
            if not last[end]:
                begin, token = end - (match & 255), match >> 8
                if begin < 0 or not (before := last[begin]):
                    last[end] = token
                    continue
                key = before << 16 | token
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(before, token)
                if fits:
                    last[end] = token
        out, at, length = [], len(text) - 1, self.length
        while at >= 0:
            token = last[at]
            if token != unknown:
                out.append(token)
                at -= length[token]
            else:
                out.extend(self.bytes_from + b for b in reversed(text[at].encode()))
                at -= 1
        out.reverse()
        return out

    def word(self, word: str) -> list[int]:
        """Ids of a mark and a word; a line break and a stop that no piece joins to a letter cut it first."""
        known = self.known
        if "\n" in word:
            first, *lines = word.split("\n")
            out = list(known.get(first) or self.word(first))
            for line in lines:
                out.append(self.bytes_from + 10)
                out += self.chunk(line)
            return out
        if word[-1:] in self.stops and word[-2:-1].isalpha():
            core = word[:-1]
            if core not in known:
                known[core] = self.chunk(MARK + core)
            return [*known[core], self.stops[word[-1]]]
        return self.chunk(MARK + word)

    def run(self, n: int) -> list[int]:
        """Ids of n marks in a row: all their merges rank alike, so the leftmost goes first."""
        if n not in self.runs:
            done: list[int] = []
            rest = n
            while rest:  # the leftmost part grows by one while a piece of that size exists, then by what grows beside it
                size = next(s for s in range(min(rest, 64), 0, -1) if MARK * s in self.id_of and self._grows(s, rest))
                done.append(self.id_of[MARK * size])
                rest -= size
            self.runs[n] = done
        return self.runs[n]

    @lru_cache(maxsize=100_000)
    def _grows(self, size: int, n: int) -> bool:
        return len(self.merge(MARK * min(n, 64))[0]) == size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids start (one more entry than texts)."""
        if len(self.known) > MEMORY:
            self.known = {}
        if len(self.pairs) > PAIRS:
            self.pairs = {}
        gc.disable()  # many small lists, no cycles
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        chunks, known = coded.dictionary.to_pylist(), self.known
        for word in chunks:
            if word not in known:
                known[word] = self.word(word)
        found = [known[word] for word in chunks]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))
        codes = np.asarray(coded.indices)
        each = lengths[codes]
        each[offsets[:-1][np.asarray(pc.equal(texts, ""), dtype=bool)]] = 0
        ids = gather(flat, (np.cumsum(lengths) - lengths)[codes], each)
        begin = np.concatenate([[0], np.cumsum(each)])[offsets]
        gc.enable()
        double = np.flatnonzero((ids[1:] == self.bare) & (ids[:-1] == self.bare))
        rows = np.unique(np.searchsorted(begin, double, "right") - 1)
        rows = rows[[np.any((ids[begin[r] : begin[r + 1] - 1] == self.bare) & (ids[begin[r] + 1 : begin[r + 1]] == self.bare)) for r in rows]] if len(rows) else rows
        if not len(rows):
            return ids, begin
        parts = [ids[begin[i] : begin[i + 1]] for i in range(len(texts))]
        for r in rows:
            parts[r] = self._merge_runs(parts[r])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _merge_runs(self, ids: np.ndarray) -> np.ndarray:
        edges = np.flatnonzero(np.diff((ids == self.bare).astype(np.int8), prepend=0, append=0))
        out, at = [], 0
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            out += [ids[at:begin], np.asarray(self.run(end - begin), np.int32)]
            at = end
        return np.concatenate([*out, ids[at:]])

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
        """UTF-8 of each text: pieces spelled out, bytes that are no UTF-8 replaced, the first space dropped."""
        sizes = self.spelled_length[ids]
        raw = gather(self.spelled_bytes, self.spelled_start[ids], sizes).tobytes()
        cuts = np.concatenate([[0], np.cumsum(sizes)])[begin].tolist()
        out = []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            text = raw[a + 1 : b] if raw[a : a + 1] == b" " and b > a else raw[a:b]
            if self.bytes_from <= ids[begin[i] : begin[i + 1]].min(initial=1 << 30) < self.bytes_from + 256:
                text = text.decode("utf-8", "replace").encode()
            out.append(text)
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) to doc_id, ids.  A null or empty text has no ids."""
    def run(batches):
        pieces = codec(path)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids, begin = pieces.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) to doc_id, text.  Null ids give an empty text."""
    def run(batches):
        pieces = codec(path)
        for batch in batches:
            for row in range(0, batch.num_rows, 500):
                part = batch.slice(row, 500)
                lists = pc.fill_null(part.column(1), [])
                begin = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
                texts = pieces.decode(np.asarray(lists.flatten()), begin)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes each text in one pass and keeps the digests of both results."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        pieces = codec(path)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids, begin = pieces.encode(texts)
                spelled = list(map(pieces.decimal.__getitem__, ids.tolist()))
                cuts = begin.tolist()
                own = [hashlib.sha256(b",".join(spelled[a:b])).hexdigest() for a, b in zip(cuts, cuts[1:])]
                del spelled
                back = [hashlib.sha256(text).hexdigest() for text in pieces.decode(ids, begin)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(np.diff(begin)), pa.array(own, pa.string()), pa.array(back, pa.string())], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded: one row for each row, so repeated rows give repeated rows.

    A null or empty text has no ids; a text of any length is encoded whole; a null doc_id stays null; other columns don't matter.  An empty table gives an empty
    table."""
    import public_tokenizers as vocabularies

    return digests(table(spark, sf_dir, "documents"), vocabularies.path("piece_bpe_32k.model"))
