"""Encoding and decoding with a merge-type (BPE) SentencePiece vocabulary.

A text is a row of symbols, at first its characters with spaces as U+2581. An agenda holds every adjacent pair whose
concatenation is a piece; the pair of the best score, leftmost among equals, is merged, and the pairs it makes with its
neighbours join the agenda, until the agenda is empty. Symbols that are no piece become their UTF-8 bytes.

No piece has a space after another character, and some characters are in no longer piece at all. So a text falls into
chunks no merge can cross, and a chunk's result depends on the chunk alone. The chunks of an Arrow batch are looked up
by vectorised hashes and confirmed byte by byte; each distinct chunk is worked once and remembered within bounds. Short
chunks run their agendas side by side, one merge each in every round; long ones have a heap each.

With check=True every newly worked chunk is compared with the sentencepiece library, batch by batch.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textvec as V
from docloom.llm.common import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Chunks, and bytes of them, that a worker remembers; then it starts anew.
REMEMBERED, REMEMBERED_BYTES = 800_000, 64 << 20
#: Characters up to which chunks run side by side.
SHORT = 64
_FAR = 1 << 21  # symbols of characters that no piece has
_NONE = np.int64(1) << 62


class Vocabulary:
    """What the agenda needs of a model file of type BPE with identity normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only BPE models with identity normalisation and a dummy prefix")
        kinds = type(model).SentencePiece.Type
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces aren't known here")
        self.symbol: dict[str, int] = {}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.byte_fallback = model.trainer_spec.byte_fallback
        self.byte_id = np.full(256, self.unknown)
        self.surface: list[bytes] = []
        score = {}
        for i, p in enumerate(model.pieces):
            if p.type == kinds.NORMAL:
                self.symbol[p.piece] = i
                score[p.piece] = p.score
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
            self.surface.append(p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else " ⁇ ".encode())
        self.n_pieces = len(model.pieces)
        self.eos = next((i for i, p in enumerate(model.pieces) if p.piece == "</s>"), -1)
        inner = {c for p in score if len(p) > 1 for c in p}
        for c in sorted(inner - set(self.symbol)):  # may be merged, but is no piece
            self.symbol[c] = len(model.pieces) + len(self.symbol)
        self.text = {v: k for k, v in self.symbol.items()}
        if any(SPACE in p.lstrip(SPACE) for p in score):
            raise ValueError("a piece has a space inside")
        self.solo = np.zeros(256, bool)
        self.solo[:128] = [chr(b) not in inner and b != 32 for b in range(128)]
        self.of_char = np.arange(0x110000, dtype=np.int64) + _FAR
        for c, s in self.symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = s
        self.of_char[32] = self.of_char[ord(SPACE)]
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rows = []
        for p, s in score.items():
            for cut in range(1, len(p)):
                left, right = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if left is not None and right is not None:
                    rows.append((left << 22 | right, self.symbol[p], ranks[s]))
        rows.sort()
        self.pair, self.merged, self.rank = (np.array(x, np.int64) for x in zip(*rows))
        self.pairs = {k: (r, m) for k, m, r in rows}
        self.shown = [f" {i}".encode() for i in range(len(model.pieces))]
        # the pairs again as a sparse hash table: place in pair by slot, -1: free
        self.slots = np.full(1 << 20, -1, np.int32)
        for k, slot in enumerate(self._slot(self.pair).tolist()):
            while self.slots[slot] >= 0:
                slot = (slot + 1) & (len(self.slots) - 1)
            self.slots[slot] = k

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def place(self, key: np.ndarray) -> np.ndarray:
        """Of each key in pair, or -1."""
        slot = self._slot(key)
        out = self.slots[slot]
        wrong = np.flatnonzero((out >= 0) & (self.pair[out] != key))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.slots) - 1)
            out[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.pair[out[wrong]] != key[wrong])]
        return out

    def ids(self, symbols: list[int]) -> list[int]:
        if max(symbols) < self.n_pieces:
            return symbols
        out: list[int] = []
        for s in symbols:
            if s < self.n_pieces:
                out.append(s)
            else:
                c = chr(s - _FAR) if s >= _FAR else self.text[s]
                out += [int(self.byte_id[b]) for b in c.encode()] if self.byte_fallback else [self.unknown]
        return out

    def by_heap(self, symbols: list[int]) -> list[int]:
        """One chunk's agenda as a heap of (rank, left place, left symbol, right symbol)."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def add(i: int) -> None:
            if i >= 0 and after[i] < n and (found := self.pairs.get(symbols[i] << 22 | symbols[after[i]])):
                heapq.heappush(agenda, (found[0], i, symbols[i], symbols[after[i]]))

        for i in range(n - 1):
            add(i)
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            if symbols[i] != a or (j := after[i]) >= n or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = self.pairs[a << 22 | b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            add(before[i])
            add(i)
        return [s for s in symbols if s >= 0]

    def side_by_side(self, symbols: np.ndarray, word: np.ndarray, n: int) -> list[list[int]]:
        """The agendas of n chunks at once; symbols of all chunks in order, word: each one's chunk."""
        done: list[list[int]] = [[] for _ in range(n)]
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            key = (symbols[:-1] << 22) | symbols[1:]
            at = self.place(key)
            ok = np.flatnonzero((at >= 0) & (word[1:] == word[:-1]))
            best = np.full(len(symbols), _NONE)
            best[ok] = (self.rank[at[ok]] << 32) | ok
            top = np.minimum.reduceat(best, first)
            live = top != _NONE
            ends = np.append(first[1:], len(symbols))
            over = np.flatnonzero(~live)
            if len(over):
                flat, a, b = symbols.tolist(), first[over].tolist(), ends[over].tolist()
                for w, i, j in zip(word[first[over]].tolist(), a, b):
                    done[w] = flat[i:j]
            where = (top[live] & 0xFFFFFFFF).astype(np.int64)
            symbols[where] = self.merged[at[where]]
            keep = np.repeat(live, ends - first)
            keep[where + 1] = False
            symbols, word = symbols[keep], word[keep]
        return done

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in chunks]
        short = [k for k, c in enumerate(chunks) if len(c) <= SHORT]
        if short:
            text = "".join(chunks[k] for k in short)
            cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            word = np.repeat(np.arange(len(short)), [len(chunks[k]) for k in short])
            for k, symbols in zip(short, self.side_by_side(self.of_char[cp], word, len(short))):
                out[k] = self.ids(symbols)
        for k, c in enumerate(chunks):
            if len(c) > SHORT:
                out[k] = self.ids(self.by_heap([int(self.of_char[ord(x)]) for x in c]))
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Encoder:
    """Encodes and decodes batches of texts; remembers chunks with their bytes, and finds them by a 64-bit hash."""

    def __init__(self, path: str, check: bool):
        self.path, self.check, self.vocab = path, check, vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.index = np.zeros(0, np.int64)
        self.odd: dict[bytes, int] = {}  # chunks whose hash is another one's
        self.count: np.ndarray = np.zeros(0, np.int64)
        self.body = np.zeros(0, np.uint8)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.shown: list[bytes] = []
        self.surface: list[bytes] = []

    def learn(self, raw: list[bytes]) -> int:
        """Works these chunks; the index of the first."""
        chunks = [x.decode() for x in raw]
        made = self.vocab.encode_chunks(chunks)
        if self.check:
            self.compare(chunks, made)
        base, shown, surface = len(self.shown), self.vocab.shown.__getitem__, self.vocab.surface.__getitem__
        self.shown += [b"".join(map(shown, ids)) for ids in made]
        self.surface += [b"".join(map(surface, ids)) for ids in made]
        self.count = np.concatenate([self.count, np.fromiter(map(len, made), np.int64, len(made))])
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.begin = np.concatenate([self.begin, len(self.body) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.body = np.concatenate([self.body, np.frombuffer(b"".join(raw), np.uint8)])
        return base

    def enter(self, hashes: np.ndarray, raw: list[bytes]) -> None:
        base = self.learn(raw)
        known, index = np.concatenate([self.known, hashes]), np.concatenate([self.index, np.arange(base, base + len(raw))])
        order = np.argsort(known, kind="stable")
        self.known, self.index = known[order], index[order]

    def compare(self, chunks: list[str], made: list[list[int]]) -> None:
        """The library puts a space before a text; a chunk without one is given after a line feed, which stays alone."""
        spaced = [c[1:] if c[0] == " " else "\n" + c for c in chunks]
        lead = _library(self.path).encode("\n")
        for c, ids, wanted in zip(chunks, made, _library(self.path).encode(spaced, num_threads=1)):
            # a chunk that is one space alone is the library's empty text
            if ids != (wanted if c[0] == " " else wanted[len(lead) :]) and c != " ":
                raise AssertionError(f"{c!r}: {ids} here, {wanted} by the library")

    def same(self, index: np.ndarray, body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the bytes of each chunk are those of the remembered one; the chunks make up the body."""
        if not len(start):
            return np.zeros(0, bool)
        size = end - start
        like = self.size[index] == size
        at = np.repeat(np.where(like, self.begin[index] - start, 0), size) + np.arange(len(body))
        differs = self.body[np.minimum(at, len(self.body) - 1)] != body
        return like & ~np.logical_or.reduceat(differs, start)

    def chunk_index(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, index of each chunk's result, first chunk of each row and the end)."""
        texts = pc.replace_substring(texts, SPACE, " ")
        for lo, hi, body, off in V.slices(pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type))):
            solo = self.vocab.solo[body]
            space = body == 32
            cut = solo.copy()
            cut[1:] |= solo[:-1] | (space[1:] & ~space[:-1])
            cut[off[:-1]] = True
            start = np.flatnonzero(cut)
            end = np.append(start[1:], len(body))
            hashes = V.span_hashes(body, start, end)
            distinct, one, back = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.known) > REMEMBERED or len(self.body) > REMEMBERED_BYTES:
                self.forget()
            at = np.searchsorted(self.known, distinct)
            new = np.ones(len(distinct), bool)
            inside = at < len(self.known)
            new[inside] = self.known[at[inside]] != distinct[inside]
            raw = body.tobytes()
            if new.any():
                self.enter(distinct[new], [raw[start[k] : end[k]] for k in one[new].tolist()])
                at = np.searchsorted(self.known, distinct)
            found = self.index[at][back]
            for k in np.flatnonzero(~self.same(found, body, start, end)).tolist():
                chunk = raw[start[k] : end[k]]
                if chunk not in self.odd:
                    self.odd[chunk] = self.learn([chunk])
                found[k] = self.odd[chunk]
            yield lo, hi, found, np.searchsorted(start, off)


def _encode_batches(path: str, check: bool, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path or model_path(MODEL), check)
        eos = encoder.vocab.eos
        for batch in batches:
            texts = batch.column(1).cast(pa.string()).fill_null("")
            empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            counts, ids_sha, text_sha, ids_out, text_out = [], [], [], [], []
            for lo, hi, index, first in encoder.chunk_index(texts):
                sums = np.concatenate([[0], np.cumsum(encoder.count[index])])
                for row in range(lo, hi):
                    a, b = first[row - lo], first[row - lo + 1]
                    own = [] if empty[row] else index[a:b].tolist()
                    shown = b"".join([encoder.shown[i] for i in own])
                    shown = (shown + f" {eos}".encode())[1:]
                    text = b"".join([encoder.surface[i] for i in own])[1:]  # without the space put before
                    counts.append(1 if empty[row] else int(sums[b] - sums[a]) + 1)
                    ids_sha.append(hashlib.sha256(shown).hexdigest())
                    text_sha.append(hashlib.sha256(text).hexdigest())
                    if full:
                        ids_out.append(np.array(shown.split(), np.int32))
                        text_out.append(text.decode("utf-8", "replace"))
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if full:
                columns |= {"ids": pa.array(ids_out, pa.list_(pa.int32())), "decoded": pa.array(text_out, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def encode_decode(documents: DataFrame, path: str | None = None, check: bool = True, full: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens (with the end id), ids_sha256, decoded_sha256; full=True adds ids
    (array<int>) and decoded.

    path: a model file that every executor has; None: the installed one named MODEL. Null and empty texts give the end
    id alone and an empty text. Literal U+2581 decodes as a space, as the library's does. Repeated rows are encoded
    alike, and rows without an id too; extra columns aren't carried; an empty table gives an empty result.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")
    return docs.mapInArrow(_encode_batches(path, check, full), schema)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
