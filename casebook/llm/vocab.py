"""Token ids of whole texts by public vocabularies, in Arrow batches.

Both encoders give the ids of the tokenizers library for every text.  ByteEncoder runs the same
vocabulary as byte ranks for Latin-1 texts.  Each distinct chunk of a batch is encoded once; texts
are cut only where the vocabulary always cuts: at white space between two other characters, and
between a letter and a full stop or comma.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from casebook.llm.common import SLICE_BYTES

#: Chunks that aren't safe to cut at: white space, or a character that may be, beside a cut.
EDGE = r"^[ \n]$|^[ \n][\x00-\x20\x7F-\xA0]|[\x00-\x20\x7F-\xA0]$|^[ \n][^\x00-\xFF]|[^\x00-\xFF]$"
#: Words that need no library: letters of Latin-1 with a comma or full stop at most.
SIMPLE = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+[.,]?$"


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(first row, array) slices of at most about `most` bytes; one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    cut, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > cut and size + n > most:
            yield cut, texts.slice(cut, i - cut)
            cut, size = i, 0
        size += n
    if cut < len(texts):
        yield cut, texts.slice(cut)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lengths[i]] for all i, end to end."""
    total = int(lengths.sum())
    out_starts = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - out_starts, lengths) + np.arange(total)]


def _library(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _latin(text: str) -> bool:
    """Only Latin-1 characters, which every Unicode version classes alike."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _expand(lists, coded, simple, flat, counts, rest):
    """From ids of the distinct chunks (flat, counts: simple ones; rest: the others) to those of all chunks:
    where each text's chunks start, all ids, and where each chunk's ids start."""
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    codes = np.asarray(coded.indices)
    lengths, starts = np.empty(len(simple), np.int64), np.empty(len(simple), np.int64)
    lengths[simple] = counts
    lengths[~simple] = np.fromiter(map(len, rest), np.int64, len(rest))
    starts[simple] = np.cumsum(counts) - counts
    starts[~simple] = len(flat) + np.cumsum(lengths[~simple]) - lengths[~simple]
    flat = np.concatenate([flat, np.fromiter(chain.from_iterable(rest), np.uint32, int(lengths[~simple].sum()))])
    each = lengths[codes]
    return offsets - offsets[0], gather(flat, starts[codes], each), np.concatenate([[0], np.cumsum(each)])


class ByteEncoder:
    """Byte-level vocabulary; ranks: the same vocabulary as a rank file."""

    def __init__(self, path: str, ranks: str, pattern: str):
        import tiktoken

        self.library = _library(path)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

        self.starts = np.zeros(max(table.values()) + 1, bool)
        self.starts[[rank for token, rank in table.items() if token[:1] == b" "]] = True

    def _plain(self, texts: list[str]) -> list[list[int]]:
        rare = [i for i, text in enumerate(texts) if not _latin(text)]
        rest = dict(zip(rare, (e.ids for e in self.library.encode_batch_fast([texts[i] for i in rare], add_special_tokens=False))))
        return [rest[i] if i in rest else self.fast.encode_ordinary(text) for i, text in enumerate(texts)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids start (one more entry than texts)."""
        texts = pc.fill_null(texts, "")
        cut = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n")
        lists = pc.split_pattern(cut, "\x00")
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary
        simple = np.asarray(pc.match_substring_regex(chunks, "^ " + SIMPLE[1:]), dtype=bool)
        words = chunks.filter(pa.array(simple))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_py() or ""
        flat = np.asarray(self.fast.encode_ordinary(joined), np.uint32)
        counts = np.diff(np.flatnonzero(self.starts[flat]), append=len(flat)) if len(flat) else np.zeros(0, np.int64)
        others = chunks.filter(pa.array(~simple))
        offsets, ids, ends = _expand(lists, coded, simple, flat, counts, self._plain(others.to_pylist()))
        edge = np.asarray(pc.match_substring_regex(others, EDGE), dtype=bool)
        odd = np.zeros(len(chunks), bool)
        odd[~simple] = edge
        hits = np.concatenate([[0], np.cumsum(odd[np.asarray(coded.indices)])])
        whole = (hits[offsets[1:]] > hits[offsets[:-1]]) | np.asarray(pc.match_substring(texts, "\x00"), dtype=bool)
        begin = ends[offsets]
        if not whole.any():
            return ids, begin
        redo = dict(zip(np.flatnonzero(whole).tolist(), self._plain(texts.filter(pa.array(whole)).to_pylist())))
        parts = [np.asarray(redo[i], np.uint32) if i in redo else ids[begin[i] : begin[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


class WordEncoder:
    """Vocabulary whose pre-tokens are lower-cased words with white space dropped and ends marked."""

    def __init__(self, path: str):
        self.library = _library(path)
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.fast = self._ranks(vocabulary)

    @staticmethod
    def _ranks(vocabulary: dict[str, int]):
        """The merges as byte ranks for lower-case words of Latin-1 letters; byte 1 stands for the end of a word."""
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)}.difference(printable)))}
        table = {}
        for token, i in vocabulary.items():
            body = token.removesuffix("</w>")
            table[bytes(byte_of[c] for c in body) + b"\x01" * (body != token)] = i
        return tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=table, special_tokens={})

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _simple(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for chunks of SIMPLE: one call for all, cut again at the word ends."""
        marked = pc.ends_with(chunks, ",") if not len(chunks) else pc.or_(pc.ends_with(chunks, ","), pc.ends_with(chunks, "."))
        split = pc.replace_substring_regex(pc.utf8_lower(chunks), "([.,])$", "\x01\\1")
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(split)], pa.int32()), split), "\x01")[0].as_py() or ""
        ids = np.asarray(self.fast.encode_ordinary(joined + "\x01") if len(split) else [], np.uint32)
        last = np.cumsum(1 + np.asarray(marked, dtype=np.int64)) - 1
        stops = (np.flatnonzero(self.ends[ids]) + 1)[last]
        return ids, np.diff(stops, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids start (one more entry than texts)."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary
        simple = np.asarray(pc.match_substring_regex(chunks, SIMPLE), dtype=bool)
        flat, counts = self._simple(chunks.filter(pa.array(simple)))
        rest = self._plain(chunks.filter(pa.array(~simple)).to_pylist())
        offsets, ids, ends = _expand(lists, coded, simple, flat, counts, rest)
        return ids, ends[offsets]


@lru_cache(maxsize=4)
def byte_encoder(path: str, ranks: str, pattern: str) -> ByteEncoder:
    return ByteEncoder(path, ranks, pattern)


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
